"""Vector expressions: standardising, targets, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, vector: str, train: Column) -> DataFrame:
    """(x - mean) / (population sd + 1e-6) by component, both over the training rows."""
    parts = df.filter(train).select(F.posexplode(vector).alias("i", "x"))
    stats = parts.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    row = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("stats"))  # one element a component
    scaled = F.zip_with(vector, "stats", lambda x, s: (x - s["m"]) / (s["s"] + 1e-6))
    return df.crossJoin(F.broadcast(row)).withColumn(vector, scaled).drop("stats")


def targets(cls: Column, classes: list[str]) -> Column:
    return F.array(*[F.when(cls == c, 1.0).otherwise(0.0) for c in classes])


def target_mask(masked: Column, classes: list[str]) -> Column:
    return F.array(*[F.when(F.array_contains(masked, c), 0.0).otherwise(1.0) for c in classes])


def pos_weight(pos: Column, neg: Column) -> Column:
    return F.least(F.lit(30.0), F.greatest(F.lit(1.0), F.sqrt(neg / F.greatest(pos, F.lit(1.0)))))


def bce(logit: Column, y: Column, weight: Column) -> Column:
    """Weighted binary cross-entropy from a logit, in the form that doesn't overflow."""
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    return weight * y * soft(-logit) + (1 - y) * soft(logit)


def max_at(values: Column, places: Column) -> Column:
    """Largest of the values at these places (from 0)."""
    return F.array_max(F.transform(places, lambda i: F.get(values, i)))


def rounded(x: Column, digits: int) -> Column:
    """Half away from 0; what becomes 0 keeps its sign, as doubles do elsewhere (round() alone drops it)."""
    near = F.round(x, digits)
    return F.when(near == 0, x * F.lit(0.0)).otherwise(near)
