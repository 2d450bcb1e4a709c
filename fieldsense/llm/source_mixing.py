"""Mixing sources to target weights by entropy balancing.

For each source the document rates r_i minimise the bounded relative entropy
sum r log r + (cap - r) log(cap - r) subject to one token constraint sum(size_i * r_i) = target. The dual has one
variable per source and is convex; its solution is the exponential tilt r_i = cap / (1 + exp(-lambda * size_i / mean)).
Sizes are aggregated over all documents to a histogram of bounded length for each source, in bins so narrow that a bin's
documents have almost one rate; Newton's iterations run over the histograms, all sources at once. The rates are then
rounded to whole copies. DataFrame operations only.

Defined cases: null text has size 0; null source is a source of its own and sorts last; a document of size 0 is taken
0 times; repeated rows are separate documents; an empty table gives an empty result; other columns are ignored; texts of
any length count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import DOCUMENT_COLUMNS, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
#: Rates are rounded to multiples of 2^-20 so that their running sums are exact integers, whatever the order of adding.
UNIT = 1 << 20
#: Size bins: one for each size up to EXACT, then BINS to a doubling.
EXACT, BINS = 128, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(by_source: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, n) -> + target. Weights repeat over sources in code-point order, nulls last.

    A source stops at cap times its size and what is above goes to the others by weight. With the sources in order of
    cap*size/weight, the ones that stop are a prefix: source s stops if the level reached without its predecessors,
    (rest of the total) / (rest of the weights), is at least its own cap*size/weight.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.lit(cap) * F.col("source_size")
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    return (
        by_source.withColumn("weight", weight)
        .withColumn("full_at", limit / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("stops", F.col("level") >= F.col("full_at"))
        .withColumn("common", F.min(F.when(~F.col("stops"), F.struct("full_at", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("stops"), limit).otherwise(F.least(limit, F.col("weight") * F.col("common"))))
        .select("source", "source_size", "n", "target")
    )


def tilted(x: Column, lam: Column, cap: float) -> Column:
    return F.lit(cap) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))))


def size_bin(size: Column) -> Column:
    return F.when(size <= EXACT, size).otherwise(EXACT + F.ceil(F.log2(size / F.lit(float(EXACT))) * BINS)).cast("long")


def entropy_balance(histogram: DataFrame, targets: DataFrame, cap: float = 2.0, rounds: int = 60) -> DataFrame:
    """(source, size, n) and (source, source_size, n, target) -> targets + lam, mean, full.

    A source's histogram is one array of bins, at most 128 and 64 for each doubling of sizes above, in order, so sums and
    reruns agree. A Newton step that leaves the bracket known so far is replaced by its middle. Sources at their cap or
    with target 0 have no finite dual solution; their lam is +-700, where all rates are cap or 0.
    """
    binned = histogram.groupBy("source", size_bin(F.col("size")).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    bins = binned.groupBy(F.col("source").alias("of")).agg(F.array_sort(F.collect_list(F.struct("bin", "n", "words"))).alias("bins"))
    state = targets.join(bins, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("mean", F.greatest(F.lit(1e-9), F.col("source_size") / F.col("n")))
    scaled = lambda b: F.struct((b["words"] / b["n"] / F.col("mean")).alias("x"), (b["words"] / F.col("mean")).alias("w"))
    state = state.withColumn("bins", F.transform("bins", scaled)).withColumn("goal", F.col("target") / F.col("mean"))

    def add(lam: Column):
        def one(sums: Column, b: Column) -> Column:
            rate = tilted(b["x"], lam, cap)
            return F.struct((sums["g"] + b["w"] * rate).alias("g"), (sums["h"] + b["w"] * b["x"] * rate * (F.lit(1.0) - rate / F.lit(cap))).alias("h"))

        return one

    def step(s: Column, _: Column) -> Column:
        sums = F.aggregate("bins", F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h")), add(s["lam"]))
        # Arguments of lambdas are computed once: sums, then the bracket.
        return F.get(F.transform(F.array(sums), lambda t: moved(s, t)), F.lit(0))

    def moved(s: Column, t: Column) -> Column:
        over = t["g"] - F.col("goal")
        lo, hi = F.when(over <= 0, s["lam"]).otherwise(s["lo"]), F.when(over >= 0, s["lam"]).otherwise(s["hi"])
        bracket = F.array(F.struct(lo.alias("lo"), hi.alias("hi"), (s["lam"] - F.coalesce(F.try_divide(over, t["h"]), F.lit(1e9))).alias("next")))
        inside = lambda b: F.when((b["next"] > b["lo"]) & (b["next"] < b["hi"]), b["next"]).otherwise((b["lo"] + b["hi"]) / 2)
        return F.get(F.transform(bracket, lambda b: F.struct(inside(b).alias("lam"), b["lo"].alias("lo"), b["hi"].alias("hi"))), F.lit(0))

    start = F.struct(F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)["lam"]
    full = F.col("target") >= F.lit(cap) * F.col("source_size")
    lam = F.when(full, F.lit(700.0)).when(F.col("target") <= 0, F.lit(-700.0)).otherwise(F.round(solved, 9))
    return state.select("source", "source_size", "target", "n", "mean", lam.alias("lam"), full.alias("full"))


def mix(
    rows: DataFrame, id_col: str = "doc_id", cap: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, seed: int = 11, together: int = 1_000
) -> DataFrame:
    """rows (id, source, size, tie) -> rows + source_size, target, rate, copies.

    Rounding is systematic: along the rows of a lot in order of size, a row gets as many copies as whole numbers pass in
    the running sum of rates, so neighbours of like size even each other out. A lot is a hashed part, of about `together`
    rows, of the rows of a source whose sizes are within an eighth of a doubling, so no task orders a whole hot source.
    What is left of a source's gap is closed, up to one document, by one copy more or less of its smallest: how many of
    each size in each part is found from counts, so again only parts are put in order.
    """
    units = materialize(rows.select(id_col, "source", "size", "tie"), "mix-sizes")
    histogram = materialize(units.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    by_source = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n"))
    targets = materialize(source_targets(by_source, weights, share, cap), "mix-targets")
    dual = materialize(entropy_balance(histogram, targets, cap), "mix-dual")

    grain = F.floor(F.log2(F.greatest(F.col("size"), F.lit(1))) * 8)
    parts = histogram.groupBy(F.col("source").alias("of_class"), grain.alias("class_grain")).agg(F.ceil(F.sum("n") / together).alias("parts"))
    rate = F.when(F.col("size") == 0, F.lit(0)).when(F.col("full"), F.lit(int(cap * UNIT))).otherwise(F.round(tilted(F.col("size") / F.col("mean"), F.col("lam"), cap) * UNIT)).cast("long")
    rated = (
        units.join(dual.drop("n").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("grain", grain)
        .join(parts, F.col("source").eqNullSafe(F.col("of_class")) & (F.col("grain") == F.col("class_grain")))
        .withColumn("mark", F.xxhash64(F.col(id_col), F.col("tie"), F.lit(seed)))
        .withColumn("part", F.pmod(F.col("mark"), F.col("parts")))
        .withColumn("units", rate)
    )
    lot = ["source", "grain", "part"]
    along = Window.partitionBy(*lot).orderBy("size", "mark", id_col, "tie")
    end = F.sum("units").over(along.rowsBetween(Window.unboundedPreceding, 0)) + F.pmod(F.xxhash64(*lot, F.lit(seed)), F.lit(UNIT))
    rounded = rated.withColumn("end", end).withColumn("copies", F.shiftright("end", 20) - F.shiftright(F.col("end") - F.col("units"), 20))
    rounded = materialize(rounded.select(id_col, "source", "size", "tie", *lot[1:], "mark", "source_size", "target", "units", "copies"), "mix-rounded")

    taken = rounded.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    taken = taken.select(F.col("source").alias("of"), "gap")
    with_gap = rounded.filter("size > 0").join(taken, F.col("source").eqNullSafe(F.col("of")))
    open_to = F.when(F.col("gap") > 0, F.col("copies") < int(cap)).otherwise(F.col("copies") > 0)
    cells = with_gap.filter(open_to).groupBy("source", "size", "part").agg(F.max("gap").alias("gap"), F.count("*").alias("free"))
    before = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    left = F.abs("gap") - F.coalesce(F.sum(F.col("free") * F.col("size")).over(before), F.lit(0))
    change = F.greatest(F.lit(0), F.least(F.col("free"), F.floor(left / F.col("size")))).cast("long")
    cells = cells.withColumn("change", change).filter("change > 0")
    cells = cells.select(*(F.col(c).alias(f"c_{c}") for c in ("source", "size", "part")), "gap", "change")
    in_cell = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("part") == F.col("c_part"))
    place = F.row_number().over(Window.partitionBy(*lot, "size").orderBy(~F.coalesce(open_to, F.lit(False)), "mark", id_col, "tie"))
    placed = rounded.join(cells, in_cell, "left").withColumn("place", F.when(F.col("change").isNotNull(), place))
    step = F.when(F.col("place") <= F.col("change"), F.signum("gap")).otherwise(F.lit(0.0)).cast("long")
    return placed.select(id_col, "source", "size", "tie", "source_size", "target", (F.col("units") / UNIT).alias("rate"), (F.col("copies") + step).alias("copies"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(measured(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Identical rows share their copies."""
    row = ["doc_id", "source", "size", "tie"]
    # Two hashes of a row stand for it; they are never null, so rows are dealt once for the join and the numbering.
    named = lambda df: df.withColumn("r1", F.xxhash64(*row)).withColumn("r2", F.xxhash64(F.lit(3), *row))
    taken = named(mix(measured(docs))).groupBy("r1", "r2").agg(F.sum("copies").alias("all_copies"), F.count("*").alias("alike")).filter("all_copies > 0")
    full = named(docs.select(*DOCUMENT_COLUMNS, word_count(F.col("text")).alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie")))
    place = F.row_number().over(Window.partitionBy("r1", "r2").orderBy("lang", "n_chars"))
    upto = lambda k: F.floor(k * F.col("all_copies") / F.col("alike"))
    one_by_one = full.join(taken, ["r1", "r2"]).withColumn("place", place)
    copies = (upto(F.col("place")) - upto(F.col("place") - 1)).cast("int")
    return one_by_one.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*DOCUMENT_COLUMNS)
