"""Keeping one row of several, with a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _known(keys: list[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in this order; rows with a null key are all kept, and don't meet in one task."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.filter(_known(keys)).withColumn("__place", place).filter("__place = 1").drop("__place")
    return first.unionByName(df.filter(~_known(keys)))


def merge_labels(df: DataFrame, key: str, label: str, secondary: str, *order: Column | str) -> DataFrame:
    """The first row of each key; its secondary labels become all labels of the key's rows but its own, sorted. Labels are
    made distinct before they meet, so a key with many rows sends few."""
    named = df.filter(_known([key])).select(F.col(key).alias("__key"), F.explode(F.concat(F.array(label), F.coalesce(secondary, F.array().cast("array<string>")))).alias("__label"))
    every = named.groupBy("__key").agg(F.collect_set("__label").alias("__every"))
    first = keep_first(df.filter(_known([key])), [key], *order).join(every, F.col(key) == F.col("__key"))
    merged = first.withColumn(secondary, F.array_sort(F.array_except("__every", F.array(label)))).drop("__key", "__every")
    return merged.unionByName(df.filter(~_known([key])))


def crosspost_key(date: Column, lat: Column, lon: Column, duration: Column) -> Column:
    """Date, place to 3 decimals and whole seconds; null if any is null."""
    return F.concat(date, F.lit("|"), F.bround(lat, 3).cast("string"), F.lit("|"), F.bround(lon, 3).cast("string"), F.lit("|"), F.bround(duration, 0).cast("string"))


def conflicting(df: DataFrame, key: str, label: str) -> DataFrame:
    """df + conflict: whether the key's rows differ in their label."""
    labels = df.filter(_known([key])).groupBy(key).agg((F.count_distinct(label) > 1).alias("conflict"))
    return df.join(labels, key, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
