"""Cases that a review found."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fieldsense.functions import attributes as A
from fieldsense.operators import evaluation, training
from fieldsense.plans.catalogue import ORACLES, QUERIES


def loudness(samples, rate, spans):
    """By NumPy's own percentiles, a recording at a time."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, 1024)[::512] * np.hanning(1024)
    hz = np.fft.rfftfreq(1024, 1 / rate)
    band = (np.abs(np.fft.rfft(frames)) ** 2)[:, (hz >= 100) & (hz <= min(10_000, rate / 2))].sum(axis=1)
    db, at = 10 * np.log10(band + 1e-10), np.arange(len(frames)) * 512 / rate
    return [np.percentile(db[(at >= s) & (at < e)], 95) - np.percentile(db, 20) for s, e in spans]


def test_activity_of_repeated_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=64).astype(np.float32).tolist() for _ in range(5)] + [None]
    pq.write_table(pa.table({"vec_id": pa.array(range(6), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got = {r["vec_id"]: r["db"] for r in QUERIES["q_activity_udf"](spark, str(tmp_path)).collect()}
    assert got.pop(5) == [0.0, 0.0] and len(got) == 5
    for k, db in got.items():
        np.testing.assert_allclose(db, loudness(np.tile(np.float64(vectors[k]), 40), 1024, [(0, 1), (1, 2)]), atol=1e-6)


def test_standardize_keeps_signs_of_zero(spark, tmp_path):
    rows = [[-1e-6] * 32 + [1e-6] * 32] + [[float((-1) ** k)] * 64 for k in range(4)]
    pq.write_table(pa.table({"vec_id": pa.array(range(5), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    theirs = dict(con.sql(ORACLES["q_standardize"]).fetchall())
    ours = {r["vec_id"]: r["embedding"] for r in QUERIES["q_standardize"](spark, str(tmp_path)).collect()}
    signed = lambda v: [(x, math.copysign(1, x)) for x in v]
    assert {k: signed(v) for k, v in ours.items()} == {k: signed(v) for k, v in theirs.items()}
    assert signed(ours[0])[0] == (0.0, -1.0)


def filters(df):
    """Lines of the optimised plan that filter."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in line]


def test_evidence_is_worked_out_once(spark):
    found = QUERIES["q_evidence"](spark, "/root/testdata/sf0.001")
    assert not any("regexp_extract_all" in line or "split" in line for line in filters(found))
    assert found._jdf.queryExecution().toRdd().getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_evidence_of_repeats_and_silence(spark):
    rows = [(1, ["Nothing here.", "It is loud, LOUD and very loud.", "It is loud, LOUD and very loud."]), (2, ["A note of 1/2 - 3 seconds, less than 9 seconds."]), (3, []), (4, None), (5, ["Faintly; a low-volume trill in quiet waters."])]
    df = spark.createDataFrame(rows, "id int, s array<string>")
    got = sorted((r["id"], r["place"], r["field"], r["match"]) for r in A.evidence(df, "id", "s").collect())
    assert got == [(1, 0, "loudness", "loud"), (1, 1, "loudness", "very loud"), (2, 0, "duration_s", "1/2 - 3 seconds"), (5, 0, "loudness", "Faintly"), (5, 1, "loudness", "low-volume"), (5, 2, "structure", "trill")]


def test_words_begin_at_words():
    """What _says() takes for granted: each alternative of these patterns begins with a word boundary."""
    for p in [*A.PITCH.values(), A.QUIET, A.MODERATE, A.LOUD, *A.STRUCTURE.values(), *A.RISING.values(), A.UNDERWATER]:
        depth, starts = 0, [0]
        for i, c in enumerate(p):
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                starts.append(i + 1)
        assert all(p.startswith(r"\b", at) for at in starts), p


def test_group_attributes_splits_texts_once(spark):
    rows = [("a", 1, "This is a trill."), ("a", 2, "Plain words."), ("b", 1, "This is a trill. A release call, loud."), ("c", 2, "Heard. Lasting up to 2 seconds."), ("c", 1, "Odd. Less than 5 seconds!  A Trill"), ("d", 1, None)]
    df = spark.createDataFrame(rows, "g string, m int, t string")
    found = A.group_attributes(df, "g", "m", "t")
    assert not any("split" in line for line in filters(found))
    assert {r["g"]: (r["structure"], r["duration_s"]) for r in found.select("g", "structure", "duration_s").collect()} == {"a": (None, None), "c": (["trill"], [None, 2.0])}
    assert found.filter(F.col("g") == "b").isEmpty()


def test_heads_train_on_all_cores(spark, monkeypatch):
    """A file of vectors is small for the work on it: its rows are dealt over the cores, whatever its partitions."""
    rng, seen = np.random.default_rng(4), []
    rows = [(i, rng.normal(size=3).tolist(), [float(i % 2)], [1.0], [0, 1]) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, x array<double>, y array<double>, m array<double>, trains array<int>").coalesce(1)
    summed = training._summed
    monkeypatch.setattr(training, "_summed", lambda used, *rest: (seen.append(used.rdd.getNumPartitions()), summed(used, *rest))[1])
    heads = training.fit(df, 2, [1, 1], training.Settings(hidden=4, epochs=2))
    assert min(seen) >= spark.sparkContext.defaultParallelism
    assert np.allclose(heads[0].w1, heads[1].w1)


def test_unit_scores_by_arrays(spark):
    rows = [(1, "u", 0, [0.2, 0.9]), (1, "u", 1, [0.4, 0.1]), (2, "u", 0, [0.1, 0.6]), (2, "u", 1, [0.9, 0.2])]
    df = spark.createDataFrame(rows, "key long, unit_id string, head int, scores array<double>")
    assert np.allclose(training.unit_scores(df, ["unit_id"], 2).first()["scores"], [0.5, 0.5])
    assert {r["head"]: r["scores"] for r in training.unit_scores(df, ["unit_id", "head"], 2).collect()} == {0: [0.2, 0.9], 1: [0.9, 0.2]}


def test_comparison_reads_rows_in_one_job(spark):
    """Each of the tiers' branches reads a run's rows once, however many metrics and resamples there are."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda s: (seen.add(1), s)[1], "double").asNondeterministic()
    units = [(i, "AB"[i % 2] if i % 5 else None, "frog" if i % 5 else "background", "focal" if i < 40 else "aru", False, i % 3, [], True, "air", f"g{i % 7}") for i in range(60)]
    u = spark.createDataFrame(units, "unit_id int, own string, kind string, domain string, locked boolean, fold int, masked array<string>, leakage_safe boolean, medium string, split_group string")
    scores = spark.createDataFrame([(i, c, (i * 7 + ord(c)) % 13 / 13) for i in range(60) for c in "AB"], "unit_id int, class string, score double")
    rows = evaluation.judged(scores, u).withColumn("score", count("score"))
    found = evaluation.delta_headline(rows, rows, u, 5)
    assert {r["delta"] for r in found.collect()} == {0.0}
    assert 0 < seen.value <= 3 * 2 * 120
