"""Ranking metrics over long tables of scores; tied scores form one block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from fieldsense.operators.sizes import small

#: Pieces to a doubling of a score, or of its distance from 1.
FINE = 64


def piece(score: Column) -> Column:
    """A whole number that never falls as the score rises; nulls below all, NaN above.

    Pieces are narrow where probabilities crowd: each doubling of the score has FINE of them up to 1/2 and from 1 up, and
    each halving of its distance from 1 in between; negative scores mirror the positive ones.
    """
    size = F.abs(score.cast("double"))
    steps = lambda x: F.floor(F.log2(x) * FINE)
    # From -70,000 (zero) to 70,000 (infinity).
    grade = F.when(size == 0, -70_000).when(size < 0.5, steps(size)).when(size < 1, -steps(1 - size)).when(size < float("inf"), 4_000 + steps(size)).otherwise(70_000)
    signed = F.when(score < 0, -140_000 - grade).otherwise(grade)
    return F.when(score.isNull(), -300_000).when(F.isnan(score.cast("double")), 300_000).otherwise(signed).cast("int")


def running_sums(rows: DataFrame, keys: list[str], score: str, sums: dict[str, Column], *ties: str) -> DataFrame:
    """rows + for each of sums its running sum by keys from the highest score down, ties in the order given.

    Sums run inside pieces of the scores, and those of whole pieces before are added, so a key's rows are in many tasks.
    """
    cut = rows.withColumns(sums).withColumn("__piece", piece(F.col(score)))
    whole = cut.groupBy(*keys, "__piece").agg(*[F.sum(c).alias(c) for c in sums])
    above = Window.partitionBy(*keys).orderBy(F.desc("__piece")).rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"__key{i}" for i, k in enumerate(keys)}
    before = whole.select(*[F.col(k).alias(n) for k, n in named.items()], F.col("__piece").alias("__of"), *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"__before_{c}") for c in sums])
    same = F.col("__piece") == F.col("__of")
    for k, n in named.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    inside = Window.partitionBy(*keys, "__piece").orderBy(F.desc(score), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(before, same).withColumns({c: F.sum(c).over(inside) + F.col(f"__before_{c}") for c in sums}).drop("__piece", "__of", *named.values(), *[f"__before_{c}" for c in sums])


def score_blocks(scores: DataFrame, keys: list[str], score: str = "score", y: str = "y", weight: Column | None = None) -> DataFrame:
    """keys, score -> positive and total weight of each block of equal scores, and both summed from the top (tp, n).

    The blocks are aggregated before they are ordered, so sums run over distinct scores, not rows.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    blocks = scores.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.when(F.col(y), w).otherwise(0.0)).alias("d_tp"), F.sum(w).alias("d_n"))
    return running_sums(blocks, keys, "score", {"tp": F.col("d_tp"), "n": F.col("d_n")})


def average_precision(scores: DataFrame, keys: list[str], score: str = "score", y: str = "y", weight: Column | None = None) -> DataFrame:
    """keys -> ap: sum over blocks of gained positives times precision at the block's end, over all positives; null
    without positives."""
    return _gained(score_blocks(scores, keys, score, y, weight), keys)


def average_precision_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The same from rows that are summed already: keys, score, pos, every."""
    blocks = sums.groupBy(*keys, "score").agg(F.sum("pos").alias("d_tp"), F.sum("every").alias("d_n"))
    return _gained(running_sums(blocks, keys, "score", {"tp": F.col("d_tp"), "n": F.col("d_n")}), keys)


def _gained(blocks: DataFrame, keys: list[str]) -> DataFrame:
    gained = F.sum(F.col("d_tp") * F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)))
    return blocks.groupBy(*keys).agg(F.try_divide(gained, F.sum("d_tp")).alias("ap"))


def recall_at_precision(scores: DataFrame, keys: list[str], precision: float, score: str = "score", y: str = "y") -> DataFrame:
    """keys -> recall, threshold: the most positives at a block end of at least this precision, and the highest such
    score; (0, infinity) if there is none."""
    blocks = score_blocks(scores, keys, score, y)
    good = F.when((F.col("tp") / F.col("n") >= precision) & (F.col("tp") > 0), F.struct("tp", F.col("score").alias("at")))
    out = blocks.groupBy(*keys).agg(F.max(good).alias("best"), F.max("tp").alias("all"))
    return out.select(*keys, F.coalesce(F.col("best.tp") / F.col("all"), F.lit(0.0)).alias("recall"), F.coalesce("best.at", F.lit(float("inf"))).alias("threshold"))


def review_effort(scores: DataFrame, keys: list[str], recall: float, unit: str = "unit_id", score: str = "score", y: str = "y") -> DataFrame:
    """keys -> effort: share of units looked at, best first and ties by unit, until this recall is reached."""
    ranked = running_sums(scores.select(*keys, unit, score, y), keys, score, {"rank": F.lit(1), "hits": F.when(F.col(y), 1).otherwise(0)}, unit)
    totals = scores.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(F.count("*").alias("__n"), F.count_if(y).alias("__all"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    ranked = ranked.join(totals, same).withColumn("need", F.ceil(F.lit(recall) * F.col("__all")))
    return ranked.groupBy(*keys).agg((F.min(F.when((F.col("hits") >= F.col("need")) & (F.col("need") > 0), F.col("rank"))) / F.max("__n")).alias("effort"))


def boot_weights(groups: DataFrame, group: str, n_boot: int) -> DataFrame:
    """boot_id, group, weight: how often each of G groups is drawn in G draws with replacement.

    Draw j of resample b takes the group at place md5(b-j) mod G among the sorted groups, so draws agree everywhere.
    """
    placed = groups.select(group).distinct().withColumn("place", F.row_number().over(Window.orderBy(group)) - 1)  # a row a group
    size = placed.count()
    draws = groups.sparkSession.range(n_boot * size).select(F.expr(f"id div {max(1, size)}").alias("boot_id"), F.pmod("id", F.lit(max(1, size))).alias("j"))
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", "boot_id", "j")), 1, 8), 16, 10).cast("long"), F.lit(max(1, size)))
    return draws.groupBy("boot_id", at.alias("place")).agg(F.count("*").alias("weight")).join(placed, "place").select("boot_id", group, "weight")


#: Pieces into which a key's scores are cut at quantiles, so that a key is many tasks; rows of weights held at a time.
PIECES, TOGETHER = 16, 1024


def _sums_by_draw(pos: np.ndarray, every: np.ndarray, draws: pa.Array, n_boot: int) -> np.ndarray:
    """(2, rows, resamples): positives and all of each row times its group's draws."""
    of_row = np.repeat(np.arange(len(pos)), np.diff(np.asarray(draws.offsets)))
    drawn = draws.flatten()
    w = np.zeros((len(pos), n_boot))
    w[of_row, np.asarray(drawn.field(0))] = np.asarray(drawn.field(1))
    return np.stack([pos[:, None] * w, every[:, None] * w])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def boot_average_precision(scores: DataFrame, keys: list[str], group: str, n_boot: int, score: str = "score", y: str = "y", weights: DataFrame | None = None) -> DataFrame:
    """boot_id, keys -> ap with group weights, for the resamples in which the key has rows.

    Rows are summed by (keys, group, score) and ranked once; all resamples of a sum are one array, made in the task from its
    group's draws. A key's scores are cut into pieces at quantiles: a first pass sums whole pieces, a second runs through
    each piece in order with what stands above it. So as many rows are shuffled for 1000 resamples as for one, and a task
    holds a few arrays. The driver gets two arrays for each key and piece.
    """
    drawn = boot_weights(scores, group, n_boot) if weights is None else weights
    sums = scores.groupBy(*keys, group, F.col(score).cast("double").alias("score")).agg(F.count_if(y).cast("double").alias("pos"), F.count("*").cast("double").alias("every"))
    return boot_average_precision_of_sums(sums, keys, group, n_boot, drawn)


def boot_average_precision_of_sums(sums: DataFrame, keys: list[str], group: str, n_boot: int, drawn: DataFrame) -> DataFrame:
    """The same from rows that are summed already (keys, group, score, pos, every) and draws (boot_id, group, weight)."""
    drawn = drawn.groupBy(group).agg(F.collect_list(F.struct(F.col("boot_id").cast("int"), F.col("weight").cast("int"))).alias("draws"))  # n_boot at most
    # One text stands for the keys; nulls and values never meet.
    key = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in keys)) if keys else F.lit("")
    sums = sums.withColumn("key", key)
    cuts = sums.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("rows"), F.percentile_approx("score", [k / PIECES for k in range(1, PIECES)], 1000).alias("cuts"))
    # Short keys stay whole; nulls come last.
    cut = F.when(F.col("score").isNull(), PIECES).otherwise(F.size(F.filter("cuts", lambda c: c >= F.col("score"))))
    piece = F.when(F.col("rows") > TOGETHER, cut).otherwise(0)
    rows = sums.join(small(cuts), F.col("key") == F.col("of")).withColumn("piece", piece).join(small(drawn), group)
    rows = rows.select("key", "piece", "score", "pos", "every", "draws")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, np.ndarray] = {}
        for batch in _slices(batches):
            both = _sums_by_draw(*(np.asarray(batch.column(k)) for k in (3, 4)), batch.column(5), n_boot)
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for name in set(names):
                own = [i for i, n in enumerate(names) if n == name]
                found[name] = found.get(name, 0) + both[:, own].sum(1)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([p for _, p in found], pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["key", "piece", "sums"])

    whole: dict[str, dict[int, np.ndarray]] = {}
    for r in rows.mapInArrow(totals, "key string, piece int, sums binary").toLocalIterator():
        own = whole.setdefault(r["key"], {})
        own[r["piece"]] = own.get(r["piece"], 0) + np.frombuffer(r["sums"]).reshape(2, -1)
    above: dict[tuple, np.ndarray] = {}
    for name, pieces in whole.items():
        running = np.zeros((2, n_boot))
        for p in sorted(pieces):
            above[name, p], running = running, running + pieces[p]
    shared = sums.sparkSession.sparkContext.broadcast(above)

    def gained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, run, gain, block, at = [], None, None, None, None, None

        def close() -> None:
            nonlocal run, gain
            run = run + block
            gain = gain + np.stack([block[0] * np.divide(run[0], run[1], out=np.zeros(n_boot), where=run[1] > 0), *block])

        for batch in _slices(batches):
            both = _sums_by_draw(*(np.asarray(batch.column(k)) for k in (3, 4)), batch.column(5), n_boot)
            scored = np.asarray(batch.column(2).fill_null(np.nan))
            for i, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own != name or not (scored[i] == at or (np.isnan(scored[i]) and np.isnan(at))):
                    if name is not None:
                        close()
                    if own != name:
                        if name is not None:
                            out.append((name[0], gain))
                        name, run, gain = own, shared.value[own], np.zeros((3, n_boot))
                    block, at = both[:, i].copy(), scored[i]
                else:
                    block += both[:, i]
        if name is not None:
            close()
            out.append((name[0], gain))
        for k, g in out:
            yield pa.RecordBatch.from_arrays([pa.array([k] * n_boot, pa.string()), pa.array(np.arange(n_boot)), *map(pa.array, g)], names=["key", "boot_id", "gain", "tp", "n"])

    ordered = rows.repartition("key", "piece").sortWithinPartitions("key", "piece", F.desc("score"))
    found = ordered.mapInArrow(gained, "key string, boot_id long, gain double, tp double, n double").groupBy("key", "boot_id").agg(*(F.sum(c).alias(c) for c in ("gain", "tp", "n")))
    found = found.filter("n > 0").select("boot_id", "key", F.try_divide("gain", "tp").alias("ap"))
    names = sums.select("key", *keys).distinct()
    return found.join(small(names), "key").select("boot_id", *keys, "ap")


def interval(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys -> ci_lo, ci_hi: the 2.5 and 97.5 percentiles with linear interpolation; nulls are left out. For resamples, of
    which a key has a bounded number; `quantiles` is for keys of any size."""
    both = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return values.groupBy(*keys).agg(both.alias("ci")).select(*keys, F.col("ci")[0].alias("ci_lo"), F.col("ci")[1].alias("ci_hi"))


def quantiles(values: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 1024) -> DataFrame:
    """keys -> q0, q1, ...: exact quantiles at these shares with linear interpolation, for keys of many rows.

    Selection by histograms: each rank that is asked for has a range of values that holds it; a round counts the range's
    values in `bins` bins of equal width and keeps the bin with the rank, from its least to its greatest value, until that is
    one value. A round is one scan with a map-side sum, and no buffer grows with distinct values. Keys are names: a few
    numbers for each come to the driver. Nulls, NaN and infinities are left out; a key without values has no row.
    """
    number = F.col(value).cast("double")
    finite = values.select(*keys, number.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    spark, kinds = values.sparkSession, [finite.schema[k] for k in keys]
    found = finite.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("n")).collect()
    ranks: dict[tuple, tuple[float, float, int]] = {}  # key number and rank: range, and how many values lie below
    for i, r in enumerate(found):
        for q in shares:
            at = q * (r["n"] - 1)
            for rank in {int(at), min(int(at) + 1, r["n"] - 1)}:
                ranks[i, rank] = (r["lo"], r["hi"], 0)
    names = StructType([StructField(f"__k{j}", k.dataType) for j, k in enumerate(kinds)] + [StructField("__i", LongType())])
    named = spark.createDataFrame([(*(r[k] for k in keys), i) for i, r in enumerate(found)], names)
    same = F.lit(True)
    for j, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{j}"))
    numbered = finite.join(small(named), same).select("__i", "__v")
    while open_ := [(i, rank, lo, hi, below) for (i, rank), (lo, hi, below) in ranks.items() if lo < hi]:
        asked = spark.createDataFrame(open_, "__of long, rank long, lo double, hi double, below long")
        met = numbered.join(small(asked), (F.col("__i") == F.col("__of")) & F.col("__v").between(F.col("lo"), F.col("hi")))
        # Halves keep the width of a range finite.
        place = F.least(F.lit(bins - 1), F.floor((F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))
        counted = met.groupBy("__of", "rank", "below", place.alias("bin")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("__of", "rank").orderBy("bin")) + F.col("below")
        held = counted.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        for r in held.collect():
            ranks[r["__of"], r["rank"]] = (r["lo"], r["hi"], r["upto"] - r["n"])
    rows = []
    for i, r in enumerate(found):
        own = []
        for q in shares:
            at = q * (r["n"] - 1)
            low, high = ranks[i, int(at)][0], ranks[i, min(int(at) + 1, r["n"] - 1)][0]
            own.append(low + (high - low) * (at - int(at)))
        rows.append((*(r[k] for k in keys), *own))
    return spark.createDataFrame(rows, StructType([*kinds, *(StructField(f"q{j}", DoubleType()) for j in range(len(shares)))]))


def paired_delta(scores: DataFrame, keys: list[str], group: str, n_boot: int, a: str, b: str, y: str = "y") -> DataFrame:
    """keys -> delta, ci_lo, ci_hi, significant for run b against run a over the same resamples."""
    base = lambda s: average_precision(scores, keys, s, y).withColumnRenamed("ap", s)
    boot = lambda s: boot_average_precision(scores, keys, group, n_boot, s, y).withColumnRenamed("ap", s)
    drawn = boot(a).join(boot(b), ["boot_id", *keys]).withColumn("delta", F.col(b) - F.col(a))
    point = base(a).join(base(b), keys).select(*keys, (F.col(b) - F.col(a)).alias("delta"))
    return point.join(interval(drawn, keys, "delta"), keys).withColumn("significant", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


def decide(delta: Column, ci_lo: Column, worst: Column) -> Column:
    """Adopt if the primary metric's interval lies above 0 and no class loses more than 0.05."""
    return F.coalesce((ci_lo > 0) & (worst >= -0.05) & delta.isNotNull(), F.lit(False))


def top_class(long_scores: DataFrame, unit: str, cls: str = "class", score: str = "score") -> DataFrame:
    """unit -> top_class, top_score; ties go to the first class by name."""
    order = Window.partitionBy(unit).orderBy(F.desc(score), cls)
    return long_scores.withColumn("place", F.row_number().over(order)).filter("place = 1").select(unit, F.col(cls).alias("top_class"), F.col(score).alias("top_score"))
