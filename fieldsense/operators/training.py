"""Multi-label heads on frozen vectors, many at a time: cross-validation and the learning curve.

A head is Linear, GELU (in its tanh form), Linear, with a masked, weighted binary cross-entropy. Every row names the heads
that it trains, so one scan an epoch gives the gradients of all heads: tasks add up their rows' gradients in NumPy, Spark
adds up the tasks', and the driver, which holds nothing but the heads' weights, takes a step of Adam with decoupled weight
decay. Rows may be lost and read again at any time. Dropout is drawn from a row's key, the epoch and the seed, so it doesn't
depend on how rows are dealt.

Defined cases: a row without heads trains none; a head without rows keeps its first weights; null vectors, targets or masks
are left out; an empty table trains nothing and gives no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.operators import metrics, splits
from fieldsense.operators.sizes import spread


@dataclass(frozen=True)
class Settings:
    hidden: int = 256
    epochs: int = 30
    rate: float = 2e-2
    decay: float = 1e-4
    dropout: float = 0.2
    most_weight: float = 30.0
    rows: int = 4096


@dataclass
class Head:
    """Weights of one head and the mean and spread of its training vectors."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray  # of positives, by class
    seed: int = 0

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]


def first_weights(width: int, classes: int, seed: int, settings: Settings) -> Head:
    rng, h = np.random.default_rng(seed), settings.hidden
    drawn = lambda fan, *shape: rng.uniform(-1, 1, shape) / np.sqrt(fan)
    return Head(drawn(width, width, h), drawn(width, h), drawn(h, h, classes), drawn(h, classes), np.zeros(width), np.ones(width), np.ones(classes), seed)


def _gelu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value and its derivative."""
    k = np.sqrt(2 / np.pi)
    square = a * a
    t = np.tanh(k * a * (1 + 0.044715 * square))
    return 0.5 * a * (1 + t), 0.5 * (1 + t) + 0.5 * a * (1 - t * t) * k * (1 + 3 * 0.044715 * square)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _kept(keys: np.ndarray, width: int, salt: int, dropout: float) -> np.ndarray | float:
    """Factors of dropout: 0 or 1 / (1 - dropout), by key, place and salt."""
    if not dropout:
        return 1.0
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(width, dtype=np.uint64) + np.uint64(salt * 7919 + 1)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h >= np.uint64(int(dropout * 2**64))) / (1 - dropout)


def dropped(head: Head, keys: np.ndarray, epoch: int, dropout: float) -> tuple[np.ndarray | float, np.ndarray | float]:
    """Factors of dropout on vectors and on hidden units; those of heads with one seed are the same."""
    salt = 2 * (epoch * 1000 + head.seed)
    return _kept(keys, head.w1.shape[0], salt, dropout), _kept(keys, head.w1.shape[1], salt + 1, dropout)


def gradient(head: Head, keys: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, epoch: int, dropout: float, kept: tuple | None = None) -> list[np.ndarray]:
    """Of the loss summed over the rows: by w1, b1, w2, b2, and the sums of loss and mask. kept: what `dropped` gives."""
    keep_x, keep = dropped(head, keys, epoch, dropout) if kept is None else kept
    x = (x - head.mean) / head.spread * keep_x
    a, slope = _gelu(x @ head.w1 + head.b1)
    z = a * keep
    logit = z @ head.w2 + head.b2
    p = _sigmoid(logit)
    d = m * ((1 - y) * p - head.weight * y * (1 - p))
    soft = np.logaddexp(0, -np.abs(logit))
    loss = m * (head.weight * y * (np.maximum(-logit, 0) + soft) + (1 - y) * (np.maximum(logit, 0) + soft))
    back = d @ head.w2.T * keep * slope
    return [x.T @ back, back.sum(0), z.T @ d, d.sum(0), np.array([loss.sum(), m.sum()])]


def scores(head: Head, x: np.ndarray) -> np.ndarray:
    return _sigmoid(_gelu((x - head.mean) / head.spread @ head.w1 + head.b1)[0] @ head.w2 + head.b2)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1).astype(np.float64)


def _summed(rows: DataFrame, n_heads: int, width: int, values, at_once: int) -> np.ndarray:
    """(heads, width) of values(keys, x, y, m)(head number, rows), added up over all rows that train the head. Tasks give an
    array for each head, and Spark adds these up by head, so the driver gets as many numbers as heads hold."""

    def arrays(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(totals, pa.int64()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], names=["head", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                n = part.num_rows
                of = values(np.asarray(part.column(0)), *(_matrix(part.column(k), n) for k in (1, 2, 3)))
                trains = part.column(4)
                of_row = np.repeat(np.arange(n), np.diff(np.asarray(trains.offsets)))
                head_of = np.asarray(trains.flatten())
                order = np.argsort(head_of, kind="stable")
                starts = np.searchsorted(head_of[order], np.arange(n_heads + 1))
                for k in np.flatnonzero(np.diff(starts)).tolist():
                    totals[k] = totals.get(k, 0) + np.concatenate([np.ravel(v) for v in of(k, of_row[order[starts[k] : starts[k + 1]]])])
        yield arrays(totals)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(v)
        yield arrays(totals)

    kind = "head long, v binary"
    out = np.zeros((n_heads, width))
    for r in rows.mapInArrow(run, kind).repartition("head").mapInArrow(add, kind).collect():
        out[r["head"]] = np.frombuffer(r["v"])
    return out


def _moments(keys: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray):
    return lambda k, own: [[len(own)], x[own].sum(0), (x[own] ** 2).sum(0), (y[own] * m[own]).sum(0), ((1 - y[own]) * m[own]).sum(0)]


def _gradients(heads: list[Head], epoch: int, dropout: float, keys: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray):
    by_seed: dict[int, tuple] = {}

    def of(k: int, own: np.ndarray) -> list[np.ndarray]:
        head = heads[k]
        if head.seed not in by_seed:
            by_seed[head.seed] = dropped(head, keys, epoch, dropout)
        kept = tuple(f[own] if dropout else f for f in by_seed[head.seed])
        return gradient(head, keys[own], x[own], y[own], m[own], epoch, dropout, kept)

    return of


def fit(rows: DataFrame, n_heads: int, seeds: list[int], settings: Settings = Settings()) -> list[Head]:
    """rows: key long, x, y, m arrays of doubles (m: 0 where a target is masked), trains array<int>, the heads that the row
    trains, numbers from 0; seeds: one for each head. Vectors are standardised and positives weighted by sqrt(neg / pos),
    1 to `most_weight`, over each head's own rows."""
    used = rows.select("key", "x", "y", "m", "trains").filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("m").isNotNull() & (F.size("trains") > 0))
    used = spread(used, 2).persist()
    try:
        sizes = used.select(F.size("x"), F.size("y")).first()
        if sizes is None:
            return []
        d, c = sizes
        heads = [first_weights(d, c, s, settings) for s in seeds]
        moments = _summed(used, n_heads, 1 + 2 * d + 2 * c, _moments, settings.rows)
        for head, (n, *sums) in zip(heads, moments, strict=True):
            one, two, pos, neg = np.split(np.array(sums), np.cumsum([d, d, c]))
            head.mean = one / max(n, 1)
            head.spread = np.sqrt(np.maximum(two / max(n, 1) - head.mean**2, 0)) + 1e-6
            head.weight = np.clip(np.sqrt(neg / np.maximum(pos, 1)), 1, settings.most_weight)
        bounds = np.cumsum([p.size for p in heads[0].parts])
        moving = [[np.zeros_like(p) for p in h.parts * 2] for h in heads]  # Adam's first and second moments
        for epoch in range(settings.epochs):
            shared = used.sparkSession.sparkContext.broadcast(heads)
            found = _summed(used, n_heads, bounds[-1] + 2, lambda *part: _gradients(shared.value, epoch, settings.dropout, *part), settings.rows)  # noqa: B023
            shared.destroy()
            for head, own, flat in zip(heads, moving, found, strict=True):
                if flat[-1] <= 0:
                    continue
                for i, (p, g) in enumerate(zip(head.parts, np.split(flat, bounds), strict=False)):
                    g = g.reshape(p.shape) / max(flat[-1], 1)
                    own[i] = 0.9 * own[i] + 0.1 * g
                    own[i + 4] = 0.999 * own[i + 4] + 0.001 * g * g
                    step = own[i] / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(own[i + 4] / (1 - 0.999 ** (epoch + 1))) + 1e-8)
                    p -= settings.rate * (step + settings.decay * p)
        return heads
    finally:
        used.unpersist()


def predict(rows: DataFrame, heads: list[Head], columns: list[str]) -> DataFrame:
    """columns, head, scores for each row and each head of its `scored_by` array."""
    shared = rows.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, by = _matrix(batch.column(0), batch.num_rows), batch.column(1)
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(by.offsets)))
            head_of = np.asarray(by.flatten())
            for k in np.unique(head_of):
                own = of_row[head_of == k]
                found = scores(shared.value[k], x[own])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns[2:]), pa.array(np.full(len(own), k, np.int32)), lists], names=[*columns, "head", "scores"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    used = rows.filter(F.col("x").isNotNull() & (F.size("scored_by") > 0))
    return used.select("x", "scored_by", *columns).mapInArrow(run, f"{kept}, head int, scores array<double>")


def cross_validate(windows: DataFrame, folds: list[int], seeds: list[int], settings: Settings = Settings()) -> DataFrame:
    """(unit_id, fold, scores): each unit by the heads that haven't seen its fold, averaged over seeds, the best of its
    windows in each class. windows: key, unit_id, fold, x, y, m, eligible (for training)."""
    n = len(seeds)
    number = F.element_at(F.create_map(*(F.lit(v) for i, k in enumerate(folds) for v in (k, i))), F.col("fold"))
    every = F.array(*map(F.lit, range(n * len(folds)))).cast("array<int>")
    own = F.transform(F.array(*map(F.lit, range(n))), lambda s: (number * n + s).cast("int"))
    rows = windows.withColumn("scored_by", F.coalesce(own, F.array().cast("array<int>")))
    rows = rows.withColumn("trains", F.when(F.col("eligible"), F.array_except(every, F.col("scored_by"))).otherwise(F.array().cast("array<int>")))
    heads = fit(rows, n * len(folds), [s for _ in folds for s in seeds], settings)
    return unit_scores(predict(rows, heads, ["key", "unit_id", "fold"]), ["unit_id", "fold"], heads[0].b2.size if heads else 0)


def unit_scores(found: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """keys, scores: by class the mean over a window's heads (one of them, if the head is among the keys), then the best window."""
    each = lambda f: F.array(*(f(F.get("scores", F.lit(c))) for c in range(classes))).alias("scores")
    means = found if "head" in keys else found.groupBy("key", *keys).agg(each(F.avg))
    return means.groupBy(*keys).agg(each(F.max))


def curve_samples(pool: DataFrame, folds: list[int], repeats: int, points: list[tuple[int, int]], seed: int = 0) -> DataFrame:
    """(unit_id, class, split_group, repeat, fold, point): the pool's clips that train at each point (groups, clips) of the
    curve; -1: all. pool: unit_id, class, split_group, own_fold.

    Outside of the fold a class's groups are put in an order drawn by hash, then the clips of the first groups in another;
    samples of one repeat are nested. Ranks beyond the largest size aren't needed, so Spark drops them before the shuffle.
    """
    tests = F.explode(F.array(*map(F.lit, folds)))
    turns = F.explode(F.array(*map(F.lit, range(repeats))))
    rows = pool.withColumn("fold", tests).filter("own_fold <> fold").withColumn("repeat", turns)
    cell = ["repeat", "fold", "class"]
    sizes = sorted({g for g, _ in points if g > 0})
    most = max(sizes, default=0)
    order = Window.partitionBy(*cell).orderBy(splits.draw(seed, "repeat", "class", "split_group"), "split_group")
    groups = rows.select(*cell, "split_group").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    few = rows.join(groups, [*cell, "split_group"]).withColumn("of", F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda g: F.col("place") <= g))).drop("place") if sizes else None
    chosen = rows.withColumn("of", F.lit(-1)) if few is None else few.unionByName(rows.withColumn("of", F.lit(-1)))
    at = F.row_number().over(Window.partitionBy(*cell, "of").orderBy(splits.draw(seed + 1, "repeat", "unit_id"), "unit_id"))
    limit = max((c for _, c in points if c > 0), default=0)
    limited = chosen.withColumn("at", at).filter(F.col("at") <= limit)
    hits = [limited.filter((F.col("of") == g) & (F.col("at") <= c)).drop("at").withColumn("point", F.lit(i)) for i, (g, c) in enumerate(points) if g and c > 0]
    hits += [chosen.filter(F.col("of") == g).withColumn("point", F.lit(i)) for i, (g, c) in enumerate(points) if g and c < 0]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.select("unit_id", "class", "split_group", "repeat", "fold", "point")


def learning_curve(windows: DataFrame, classes: list[str], folds: list[int], points: list[tuple[int, int]], repeats: int = 2, settings: Settings = Settings(), seed: int = 0) -> DataFrame:
    """(repeat, fold, point, class, clips, ap, detection_ap) for every point, fold and repeat, point 0 (no clips) once.

    windows: key, unit_id, class (null: background), split_group, fold, x, y, m, pooled (recorder clips with a call, which
    are sampled), tested (recorder clips). All heads are fitted in the same scans.
    """
    jobs = [(r, k, i) for r in range(repeats) for k in folds for i, p in enumerate(points) if r == 0 or p != (0, 0)]
    number = {j: n for n, j in enumerate(jobs)}
    named = F.create_map(*(F.lit(v) for (r, k, i), n in number.items() for v in (f"{r}/{k}/{i}", n)))
    pool = windows.filter("pooled").select("unit_id", "class", "split_group", F.col("fold").alias("own_fold"))
    drawn = curve_samples(pool, folds, repeats, points, seed)
    trained = drawn.groupBy("unit_id").agg(F.collect_list(F.element_at(named, F.concat_ws("/", "repeat", "fold", "point"))).alias("drawn"))  # at most a number for each head
    outside = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for (_, k, _), n in number.items())), lambda j: j["k"] != F.col("fold"))
    inside = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for (_, k, _), n in number.items())), lambda j: j["k"] == F.col("fold"))
    none = F.array().cast("array<int>")
    rows = windows.join(trained, "unit_id", "left")
    rows = rows.withColumn("trains", F.when(F.col("pooled"), F.coalesce("drawn", none)).otherwise(F.transform(outside, lambda j: j["n"])))
    rows = rows.withColumn("scored_by", F.when(F.col("tested"), F.transform(inside, lambda j: j["n"])).otherwise(none))
    heads = fit(rows, len(jobs), [seed] * len(jobs), settings)
    # Predictions are read for classes and for detection; of the curve, some numbers for each head and class are left.
    found = unit_scores(predict(rows, heads, ["key", "unit_id", "class"]), ["unit_id", "class", "head"], len(classes)).withColumnRenamed("class", "own").persist()
    long = found.select("unit_id", "own", "head", F.posexplode("scores").alias("c", "score"))
    long = long.withColumn("class", F.get(F.array(*map(F.lit, classes)), F.col("c"))).withColumn("y", F.coalesce(F.col("own") == F.col("class"), F.lit(False)))
    best = found.groupBy("head", "unit_id").agg(F.max(F.array_max("scores")).alias("score"), F.max(F.col("own").isNotNull()).alias("y"))
    ap = metrics.average_precision(long, ["head", "class"]).join(metrics.average_precision(best, ["head"]).withColumnRenamed("ap", "detection_ap"), "head")
    of = lambda i: F.get(F.array(*(F.lit(j[i]) for j in jobs)), F.col("head"))
    used = drawn.groupBy("repeat", "fold", "point", "class").agg(F.count("*").alias("clips"))
    out = ap.select(of(0).alias("repeat"), of(1).alias("fold"), of(2).alias("point"), "class", "ap", "detection_ap")
    out = out.join(used, ["repeat", "fold", "point", "class"], "left").withColumn("clips", F.coalesce("clips", F.lit(0)))
    try:
        return windows.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        found.unpersist()


def curve_summary(curve: DataFrame) -> DataFrame:
    """(point, macro_ap, sd, detection_ap): mean over folds and repeats by class, then over classes; sd of the mean over
    classes between folds and repeats."""
    macro = curve.groupBy("point", "class").agg(F.avg("ap").alias("ap")).groupBy("point").agg(F.avg("ap").alias("macro_ap"))
    runs = curve.groupBy("point", "repeat", "fold").agg(F.avg("ap").alias("m"), F.first("detection_ap").alias("det"))
    return macro.join(runs.groupBy("point").agg(F.stddev_samp("m").alias("sd"), F.avg("det").alias("detection_ap")), "point")
