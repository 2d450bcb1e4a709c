"""Runs put together from the operators."""

import pytest
from pyspark.sql import functions as F

from fieldsense.operators import pipelines as R


def test_manifest(spark):
    cols = "recording_id string, source string, label string, path string, recordist string, date string, lat double, lon double, caption string"
    herps = spark.createDataFrame([("h1", "herps", "A", "p1", "x", None, None, None, "in Napa County"), ("h2", "herps", "A", "p2", "x", None, None, None, None)], cols)
    inat = spark.createDataFrame([("i1", "inat", "B", "p3", "Ann ", "2020-01-01", 1.0, 2.0, None), ("i2", "inat", "A", "p4", "Ann", "2020-01-01", 1.0001, 2.0, None), ("i3", "inat", "A", "p5", "Bo", None, None, None, None), ("i4", "inat", "A", "p6", "Bo", None, None, None, None)], cols)
    probes = spark.createDataFrame([("p1", 1.0, None, "m1"), ("p2", 0.1, None, "m2"), ("p3", 5.2, None, "m3"), ("p4", 5.4, None, "m4"), ("p5", 3.0, None, "m1"), ("p6", 3.0, "bad", "m6")], "path string, duration_s double, decode_error string, md5 string")
    classes = spark.createDataFrame([("A", "GA"), ("B", "GB")], "label string, acoustic_class string")
    got = {r["recording_id"]: r for r in R.build_manifest([herps, inat], probes, classes).collect()}
    assert set(got) == {"h1", "i1"}  # short, unreadable, equal and cross-posted ones are gone
    assert (got["h1"]["split_group"], got["i1"]["split_group"]) == ("herps:A:Napa", "inat:ann")
    assert got["i1"]["secondary_species"] == ["A"] and got["h1"]["secondary_species"] == [] and got["i1"]["acoustic_class"] == "GB"
    with pytest.raises(Exception, match="label not in the classes"):
        R.build_manifest([herps, inat], probes, classes.filter("label = 'A'")).collect()


def test_catalog_windows(spark):
    recordings = spark.createDataFrame([("w", "weak", False, 6.0, "d"), ("b", "box", True, 7.0, "d"), ("n", "negative", True, 3.0, "d")], "recording_id string, label_kind string, exhaustive boolean, duration_s double, dataset string")
    spans = spark.createDataFrame([("w", 0.0, 6.0, "A", False), ("b", 1.0, 2.0, "A", False), ("b", 5.0, 6.0, None, True), ("n", 0.0, 3.0, None, False)], "recording_id string, start_s double, end_s double, class string, dropped boolean")
    got = sorted((r["recording_id"], r["start_s"], r["class"] or "", r["state"]) for r in R.catalog_windows(recordings, spans).collect())
    assert got == [("b", 0.0, "A", "box"), ("b", 3.0, "", "negative"), ("b", 4.0, "", "negative"), ("n", 0.0, "", "negative"), ("w", 0.0, "A", "weak"), ("w", 3.0, "A", "weak")]


def test_runs(spark, tmp_path):
    units = spark.createDataFrame([(i, "A" if i % 3 == 0 else "B", f"g{i % 6}", "focal" if i % 2 else "aru", i == 0, []) for i in range(60)], "unit_id int, class string, split_group string, domain string, locked boolean, masked array<string>")
    window_scores = units.select("unit_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("window_idx")).withColumn("class", F.explode(F.array(F.lit("A"), F.lit("B")))).withColumn("score", (F.col("unit_id") * 7 + F.col("window_idx") * 3 + F.ascii("class")) % 13 / F.lit(13.0))
    a = R.unit_scores(window_scores)
    b = a.join(units.select("unit_id", F.col("class").alias("own")), "unit_id").select("unit_id", "class", F.when(F.col("own") == F.col("class"), 1.0).otherwise(0.0).alias("score"))
    table = R.evaluate(b, units).collect()
    assert len(table) == 4 and all(r["ap"] == 1 and r["recall"] == 1 and r["threshold"] == 1 for r in table)
    assert sum(r["n"] for r in table) == 59 * 2
    assert all(r["delta"] > 0 and r["significant"] for r in R.compare_runs(a, b, units, 50).collect())
    with pytest.raises(ValueError):
        R.compare_runs(a, b.filter("unit_id > 3"), units)
    R.record_run(spark, f"{tmp_path}/runs", "one", b, R.evaluate(b, units))
    assert spark.read.parquet(f"{tmp_path}/runs/scores").select("name").distinct().count() == 1
    digest = R.freeze_splits(units.drop("masked"), f"{tmp_path}/splits")
    assert R.load_splits(spark, f"{tmp_path}/splits", digest).count() == 60
    with pytest.raises(ValueError):
        R.load_splits(spark, f"{tmp_path}/splits", "0")
