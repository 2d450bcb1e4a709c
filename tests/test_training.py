"""Heads: gradients, fits however rows are dealt, masks, cross-validation, the learning curve."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsense.operators import splits, training
from fieldsense.plans.catalogue import QUERIES

ROWS = "key long, x array<double>, y array<double>, m array<double>, trains array<int>"
SMALL = training.Settings(hidden=8, epochs=12, rate=0.05, dropout=0.0)


def data(n=240, width=6, seed=0):
    """Rows of two classes and background, told apart by the first components."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    kind = rng.integers(0, 3, n)
    x[:, :2] *= 0.3
    x[np.arange(n)[kind < 2], kind[kind < 2]] += 4
    y = np.eye(3)[kind][:, :2]
    return x, y, np.ones_like(y), kind


def frame(spark, x, y, m, trains, parts=3):
    rows = [(i, *(v[i].tolist() for v in (x, y, m)), trains(i)) for i in range(len(x))]
    return spark.createDataFrame(rows, ROWS).repartition(parts)


def test_gradient_is_the_slope_of_the_loss():
    x, y, m, _ = data(40)
    m[::3, 0] = 0
    head = training.first_weights(6, 2, 3, SMALL)
    head = replace(head, mean=x.mean(0), spread=x.std(0), weight=np.array([2.0, 3.0]))
    for dropout in (0.0, 0.3):
        of = lambda h: training.gradient(h, np.arange(40), x, y, m, 5, dropout)  # noqa: B023, E731
        exact = of(head)
        for part, g in zip(("w1", "b1", "w2", "b2"), exact, strict=False):
            at = tuple(s // 2 for s in g.shape)
            low, high = getattr(head, part).copy(), getattr(head, part).copy()
            low[at] -= 1e-5
            high[at] += 1e-5
            slope = (of(replace(head, **{part: high}))[-1][0] - of(replace(head, **{part: low}))[-1][0]) / 2e-5
            assert slope == pytest.approx(g[at], rel=1e-4, abs=1e-6)


def plain_fit(x, y, m, seed, settings):
    """One process, one head: the same steps over all rows at once."""
    head = training.first_weights(x.shape[1], y.shape[1], seed, settings)
    head.mean, head.spread = x.mean(0), x.std(0) + 1e-6
    head.weight = np.clip(np.sqrt(((1 - y) * m).sum(0) / np.maximum((y * m).sum(0), 1)), 1, 30)
    first, second = [0.0] * 4, [0.0] * 4
    for epoch in range(settings.epochs):
        *g, sums = training.gradient(head, np.arange(len(x)), x, y, m, epoch, settings.dropout)
        for i, p in enumerate(head.parts):
            gi = g[i] / max(sums[1], 1)
            first[i], second[i] = 0.9 * first[i] + 0.1 * gi, 0.999 * second[i] + 0.001 * gi**2
            p -= settings.rate * (first[i] / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(second[i] / (1 - 0.999 ** (epoch + 1))) + 1e-8) + settings.decay * p)
    return head


@pytest.mark.parametrize("dropout", [0.0, 0.25])
def test_fit_equals_one_process(spark, dropout):
    x, y, m, _ = data()
    settings = replace(SMALL, dropout=dropout, rows=50)
    heads = training.fit(frame(spark, x, y, m, lambda i: [0] + [1] * (i % 2), 5), 3, [4, 5, 6], settings)
    for head, own, seed in ((heads[0], slice(None), 4), (heads[1], slice(1, None, 2), 5)):
        rows = np.arange(len(x))[own]
        want = plain_fit(x[own], y[own], m[own], seed, replace(settings, dropout=0.0)) if not dropout else None
        if want is not None:
            for a, b in zip(head.parts, want.parts, strict=True):
                np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-8)
        assert np.allclose(head.mean, x[rows].mean(0))
    # A head without rows keeps its first weights; a second deal of the rows gives the same fit.
    assert np.array_equal(heads[2].w1, training.first_weights(6, 2, 6, settings).w1)
    again = training.fit(frame(spark, x, y, m, lambda i: [0], 1), 1, [4], settings)[0]
    np.testing.assert_allclose(again.w1, heads[0].w1, rtol=1e-6, atol=1e-8)


def test_masked_targets_leave_the_fit_alone(spark):
    x, y, m, _ = data()
    m[::4, 1] = 0
    wrong = np.where(m > 0, y, 1 - y)
    fits = [training.fit(frame(spark, x, t, m, lambda i: [0]), 1, [1], SMALL)[0] for t in (y, wrong)]
    for a, b in zip(fits[0].parts, fits[1].parts, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)


def test_separable_data_are_learned(spark):
    x, y, m, kind = data()
    rows = frame(spark, x, y, m, lambda i: [0]).withColumn("scored_by", F.array(F.lit(0)))
    heads = training.fit(rows, 1, [0], replace(SMALL, epochs=60))
    found = {r["key"]: np.array(r["scores"]) for r in training.predict(rows, heads, ["key"]).collect()}
    p = np.array([found[i] for i in range(len(x))])
    assert (p[kind < 2].argmax(1) == kind[kind < 2]).mean() > 0.95 and p[kind == 2].max(1).mean() < 0.3


def test_nothing_to_train_on(spark):
    assert training.fit(spark.createDataFrame([], ROWS), 2, [0, 1]) == []
    rows = spark.createDataFrame([(1, None, [1.0], [1.0], [0]), (2, [1.0], None, [1.0], [0]), (3, [1.0], [1.0], [1.0], [])], ROWS)
    assert training.fit(rows, 1, [0]) == []


def test_cross_validation_averages_seeds_and_never_sees_its_fold(spark):
    x, y, m, _ = data(90)
    rows = frame(spark, x, y, m, lambda i: []).drop("trains").withColumns({"unit_id": F.expr("key div 2"), "fold": (F.expr("key div 2") % 2).cast("int"), "eligible": F.col("key") % 5 > 0})
    got = {r["unit_id"]: r["scores"] for r in training.cross_validate(rows, [0, 1], [7, 8], SMALL).collect()}
    i = np.arange(90)
    for fold in (0, 1):
        train, test = (i // 2 % 2 != fold) & (i % 5 > 0), i // 2 % 2 == fold
        means = sum(training.scores(plain_fit(x[train], y[train], m[train], s, SMALL), x) for s in (7, 8)) / 2
        for u in set(i[test] // 2):
            np.testing.assert_allclose(got[u], means[i // 2 == u].max(0), rtol=1e-5)


def test_curve_samples_are_nested_and_outside_of_the_fold(spark):
    rnd = random.Random(1)
    pool = [(i, rnd.choice("ab"), f"g{rnd.randrange(9)}", rnd.randrange(3)) for i in range(900)]
    points = splits.curve_points()
    assert len(points) == 18 and points[0] == (0, 0)
    df = spark.createDataFrame(pool, "unit_id long, class string, split_group string, own_fold int")
    got = {}
    for r in training.curve_samples(df, [0, 1, 2], 2, points).collect():
        got.setdefault((r["repeat"], r["fold"], r["class"], r["point"]), []).append((r["unit_id"], r["split_group"]))
    fold_of, count = {i: f for i, _, _, f in pool}, {}
    for (repeat, fold, cls, point), rows in got.items():
        groups, clips = points[point]
        units, used = {u for u, _ in rows}, {g for _, g in rows}
        assert len(units) == len(rows) and all(fold_of[u] != fold for u in units)
        assert (groups < 0 or len(used) <= groups) and (clips < 0 or len(units) <= clips)
        count[repeat, fold, cls, groups, clips] = units
    for (repeat, fold, cls, groups, clips), units in count.items():
        for c in (5, 10, 25):
            if 0 < c < clips and (repeat, fold, cls, groups, c) in count:
                assert count[repeat, fold, cls, groups, c] <= units
    assert len(got) == 2 * 3 * 2 * 17


def test_learning_curve_query(spark):
    rows = QUERIES["q_learning_curve_fits"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["point"] for r in rows) == list(range(18)) and all(r["macro_ap"] is None or 0 <= r["macro_ap"] <= 1 for r in rows)
