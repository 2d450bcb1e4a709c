"""Dataset catalogue: conforming tables, inventory, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_KINDS = ["weak", "clip", "box", "negative"]


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """The schema's columns in order: those of df cast, else a default, else null; other columns go."""
    given = defaults or {}
    value = lambda f: F.col(f.name) if f.name in df.columns else F.lit(given.get(f.name))
    return df.select([value(f).cast(f.dataType).alias(f.name) for f in schema])


NEGATIVE = "negative"


def inventory(recordings: DataFrame, windows: DataFrame) -> DataFrame:
    """(class, label_kind) -> recordings, hours, windows, sources, sites, days, site_days, no_site.

    recordings: recording_id, label_kind, exhaustive, dataset, duration_s, site_id, date; windows: recording_id, class (null
    for negative ones). A recording counts once for a class however many windows it has. One that has no window of any
    class, and is exhaustively labelled or negative, counts for the class `negative`; windows of a pair that no recording
    has are left out.
    """
    kinds = windows.select("recording_id", "class").join(recordings.select("recording_id", "label_kind"), "recording_id")
    kinds = kinds.withColumn("label_kind", F.when(F.col("class").isNull(), NEGATIVE).otherwise(F.col("label_kind"))).withColumn("class", F.coalesce("class", F.lit(NEGATIVE)))
    positive = kinds.filter(F.col("class") != NEGATIVE).select("recording_id", "class", "label_kind").distinct()
    silent = recordings.filter(F.col("exhaustive") | (F.col("label_kind") == NEGATIVE)).join(positive, "recording_id", "left_anti")
    pairs = positive.unionByName(silent.select("recording_id", F.lit(NEGATIVE).alias("class"), F.lit(NEGATIVE).alias("label_kind")))
    r = pairs.join(recordings.drop("label_kind"), "recording_id")
    day = F.concat_ws("|", "site_id", "date")
    counted = r.groupBy("class", "label_kind").agg(
        F.count("*").alias("recordings"), (F.sum("duration_s") / 3600).alias("hours"),
        F.array_join(F.array_sort(F.collect_set("dataset")), ", ").alias("sources"),
        F.count_distinct("site_id").alias("sites"), F.count_distinct("date").alias("days"),
        F.count_distinct(F.when(F.col("site_id").isNotNull() & F.col("date").isNotNull(), day)).alias("site_days"),
        F.count_if(F.col("site_id").isNull()).alias("no_site"),
    )
    found = kinds.groupBy("class", "label_kind").agg(F.count("*").alias("windows"))
    return counted.join(found, ["class", "label_kind"], "left").withColumn("windows", F.coalesce("windows", F.lit(0).cast("long")))


def summary(inventory: DataFrame) -> DataFrame:
    """class -> recordings and windows by label kind side by side (<kind>_rec, <kind>_win; 0 where none); hours, sites, days
    and site_days summed over kinds, and all sources."""
    wide = inventory.groupBy("class").pivot("label_kind", LABEL_KINDS).agg(F.sum("recordings").alias("rec"), F.sum("windows").alias("win")).na.fill(0)
    sums = [F.sum(c).alias(c) for c in ("sites", "days", "site_days")]
    sources = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("sources", ", "))))), ", ")
    return wide.join(inventory.groupBy("class").agg(F.round(F.sum("hours"), 2).alias("hours"), *sums, sources.alias("sources")), "class")
