"""Queries: heads on vectors, cross-validation, the learning curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldsense.functions import vectors as V
from fieldsense.operators import splits, training
from fieldsense.plans.registry import query, read

CLASSES, FOLDS, REPEATS = ["c0", "c1", "c2", "c3"], [0, 1, 2], 2


def _windows(spark, sf_dir):
    """Vectors as windows, each a unit: labels above 3 are background, even units recorder clips."""
    e = read(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    group = F.expr("vec_id div 3") % 24
    cls = F.when(F.col("label") <= 3, F.concat(F.lit("c"), "label"))
    masked = F.when(F.col("vec_id") % 11 == 0, F.array(F.lit("c1"))).otherwise(F.array().cast("array<string>"))
    w = e.select(F.col("vec_id").alias("key"), F.col("vec_id").alias("unit_id"), cls.alias("class"), F.concat(F.lit("g"), group).alias("split_group"), (group % len(FOLDS)).cast("int").alias("fold"), F.col("embedding").cast("array<double>").alias("x"), masked.alias("masked"))
    recorder = F.col("unit_id") % 2 == 0
    flags = {"pooled": recorder & F.col("class").isNotNull(), "tested": recorder | F.col("class").isNull(), "eligible": F.col("unit_id") % 13 > 0}
    return w.withColumns({"y": F.transform(V.targets(F.col("class"), CLASSES), lambda v: F.coalesce(v, F.lit(0.0))), "m": V.target_mask(F.col("masked"), CLASSES), **flags}).drop("masked")


@query()
def q_head_cross_validate(spark, sf_dir):
    """Out-of-fold scores by masked multi-label heads, three seeds a fold: (unit_id, fold, scores)."""
    return training.cross_validate(_windows(spark, sf_dir), FOLDS, [0, 1, 2], training.Settings(hidden=64))


POINTS = ", ".join(f"({i}, {g}, {c})" for i, (g, c) in enumerate(splits.curve_points()))


@query(f"""WITH pool AS (SELECT vec_id AS unit_id, 'c' || label AS class, 'g' || ((vec_id // 3) % 24) AS split_group, CAST((vec_id // 3) % 24 % 3 AS INTEGER) AS own_fold FROM embeddings WHERE embedding IS NOT NULL AND label <= 3 AND vec_id % 2 = 0),
  points AS (SELECT * FROM (VALUES {POINTS}) p(point, groups, clips) WHERE groups <> 0),
  rows AS (SELECT p.*, CAST(k AS INTEGER) AS fold, CAST(r AS INTEGER) AS repeat FROM pool p, range({len(FOLDS)}) f(k), range({REPEATS}) t(r) WHERE own_fold <> k),
  placed AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold, class ORDER BY md5('0|' || repeat || '|' || class || '|' || split_group), split_group) AS place FROM (SELECT DISTINCT repeat, fold, class, split_group FROM rows)),
  drawn AS (SELECT r.*, point, clips, row_number() OVER (PARTITION BY r.repeat, r.fold, r.class, point ORDER BY md5('1|' || r.repeat || '|' || unit_id), unit_id) AS nth
    FROM rows r JOIN placed g ON g.repeat = r.repeat AND g.fold = r.fold AND g.class = r.class AND g.split_group = r.split_group JOIN points p ON p.groups < 0 OR g.place <= p.groups)
  SELECT repeat, fold, point, class, count(*) AS clips, count(DISTINCT split_group) AS groups, sum(unit_id) AS units FROM drawn WHERE clips < 0 OR nth <= clips GROUP BY ALL""")
def q_lc_samples(spark, sf_dir):
    """What each point of the learning curve trains on, by repeat, fold and class."""
    pool = _windows(spark, sf_dir).filter("pooled").select("unit_id", "class", "split_group", F.col("fold").alias("own_fold"))
    drawn = training.curve_samples(pool, FOLDS, REPEATS, splits.curve_points())
    return drawn.groupBy("repeat", "fold", "point", "class").agg(F.count("*").alias("clips"), F.count_distinct("split_group").alias("groups"), F.sum("unit_id").alias("units"))


@query()
def q_learning_curve_fits(spark, sf_dir):
    """The learning curve: 18 points, three folds, two repeats, a head fitted for each: (point, macro_ap, sd, detection_ap)."""
    curve = training.learning_curve(_windows(spark, sf_dir), CLASSES, FOLDS, splits.curve_points(), REPEATS, training.Settings(hidden=16, epochs=20))
    return training.curve_summary(curve)
