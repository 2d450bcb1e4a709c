"""The domain's tables, stood in for by the driver's: recordings by documents, units by labelled documents.

Each has a DataFrame form and the same as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.plans.registry import read


def recordings(spark, sf_dir: str) -> DataFrame:
    """recording_id, source, label, caption, n_chars, duration_s, date, lat, lon."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("recording_id"), "source", F.col("lang").alias("label"), F.col("text").alias("caption"), "n_chars",
        (F.col("n_chars") / F.lit(100.0)).alias("duration_s"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("n_chars") % 2000).cast("int")).cast("string").alias("date"),
        (F.lit(32.0) + (F.col("doc_id") % 97) / F.lit(10.0)).alias("lat"), (F.lit(-124.0) + (F.col("n_chars") % 89) / F.lit(10.0)).alias("lon"),
    )


REC = """rec AS (SELECT doc_id AS recording_id, source, lang AS label, text AS caption, n_chars, n_chars / 100.0e0 AS duration_s,
  CAST(CAST(DATE '2019-01-01' + CAST(n_chars % 2000 AS INTEGER) AS DATE) AS VARCHAR) AS date,
  32.0e0 + (doc_id % 97) / 10.0e0 AS lat, -124.0e0 + (n_chars % 89) / 10.0e0 AS lon FROM documents)"""


def units(spark, sf_dir: str) -> DataFrame:
    """unit_id, class, y, split_group, fold, domain, locked, leakage_safe, medium, masked, score_a, score_b."""
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    number = F.substring("source", 4, 10).cast("int")
    return d.join(labels, "doc_id").select(
        F.col("doc_id").alias("unit_id"), F.col("lang").alias("class"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("y"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"), F.col("source").alias("split_group"), (number % 5).alias("fold"),
        F.when(number < 12, "focal").otherwise("aru").alias("domain"), (number % 10 == 9).alias("locked"), (F.col("n_chars") % 3 > 0).alias("leakage_safe"),
        F.when(F.col("n_chars") % 7 == 0, "underwater").otherwise("air").alias("medium"),
        F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("fr"))).otherwise(F.array().cast("array<string>")).alias("masked"),
        ((F.col("doc_id") * 37 + F.col("n_chars")) % 41 / F.lit(41.0)).alias("score_a"), ((F.col("doc_id") * 53 + F.col("n_chars") * 3) % 43 / F.lit(43.0)).alias("score_b"),
    )


UNITS = """units AS (SELECT d.doc_id AS unit_id, d.lang AS class, coalesce(l.quality = 1, false) AS y, coalesce(l.toxic = 1, false) AS toxic,
  d.source AS split_group, CAST(substr(d.source, 4) AS INTEGER) % 5 AS fold,
  CASE WHEN CAST(substr(d.source, 4) AS INTEGER) < 12 THEN 'focal' ELSE 'aru' END AS domain, CAST(substr(d.source, 4) AS INTEGER) % 10 = 9 AS locked,
  d.n_chars % 3 > 0 AS leakage_safe, CASE WHEN d.n_chars % 7 = 0 THEN 'underwater' ELSE 'air' END AS medium,
  CASE WHEN d.doc_id % 11 = 0 THEN ['fr'] ELSE CAST([] AS VARCHAR[]) END AS masked,
  ((d.doc_id * 37 + d.n_chars) % 41) / 41.0e0 AS score_a, ((d.doc_id * 53 + d.n_chars * 3) % 43) / 43.0e0 AS score_b
  FROM documents d JOIN labels l USING (doc_id))"""
