"""Exact quantiles by selection against sorted values; resamples cut into pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsense.operators import metrics


@pytest.mark.parametrize("bins", [2, 1024])
def test_quantiles_equal_sorted_values(spark, bins):
    rnd = random.Random(bins)
    kinds = {"even": lambda: rnd.random(), "tied": lambda: float(rnd.randrange(3)), "steep": lambda: 10.0 ** rnd.uniform(-20, 20), "wide": lambda: rnd.choice([-1.7e308, 1.7e308]) * rnd.random(), None: lambda: -rnd.random()}
    rows = [(k, f()) for k, f in kinds.items() for _ in range(rnd.choice([40, 301]))] + [("one", 5.0), ("none", None), ("none", float("nan")), ("even", float("inf"))]
    shares = [0.0, 0.025, 0.5, 0.975, 1.0]
    got = {r["k"]: list(r)[1:] for r in metrics.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, bins).collect()}
    assert got.keys() == {*kinds, "one"}
    for k, found in got.items():
        values = sorted(v for x, v in rows if x == k and v is not None and np.isfinite(v))
        for q, f in zip(shares, found, strict=True):
            at = q * (len(values) - 1)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert f == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-12)
    empty = metrics.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", shares)
    assert empty.collect() == [] and empty.columns == ["k", "q0", "q1", "q2", "q3", "q4"]


def test_resamples_in_pieces_equal_whole_ones(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", None]), f"g{rnd.randrange(12)}", rnd.choice([rnd.random(), 0.5, None]), rnd.random() < 0.3) for _ in range(600)]
    df = spark.createDataFrame(rows, "c string, g string, score double, y boolean")
    found = lambda: {(r["boot_id"], r["c"]): r["ap"] for r in metrics.boot_average_precision(df, ["c"], "g", 30).collect()}
    whole = found()
    monkeypatch.setattr(metrics, "TOGETHER", 5)  # slices of five rows, and all keys in pieces
    cut = found()
    assert whole.keys() == cut.keys() and len(whole) == 60
    assert all(whole[k] == pytest.approx(cut[k], abs=1e-12) for k in whole)


def test_pieces_rise_with_scores_and_part_crowded_ones(spark):
    rnd = random.Random(2)
    scores = [-float("inf"), -1e300, -2.0, -1.0, -0.3, -1e-300, -0.0, 0.0, 5e-324, 1e-300, 1e-9, 0.5, 1 - 1e-16, 1.0, 1.5, 1e300, float("inf"), float("nan")] + [rnd.uniform(-2, 2) for _ in range(500)]
    df = spark.createDataFrame([(s,) for s in scores] + [(None,)], "s double")
    pieces = [r["p"] for r in df.orderBy("s").select(metrics.piece(F.col("s")).alias("p")).collect()]
    assert pieces == sorted(pieces)
    for crowd in (lambda: rnd.uniform(0, 1e-3), lambda: 1 - rnd.uniform(0, 1e-4), lambda: rnd.uniform(1e3, 1e5)):
        few = spark.createDataFrame([(crowd(),) for _ in range(2000)], "s double").groupBy(metrics.piece(F.col("s")).alias("p")).count()
        assert few.count() > 100 and few.agg(F.max("count")).first()[0] < 100
