"""Folds, locked test sets and samples. Draws are hashes, so they agree on every run and machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    """A uniform order by md5 of the seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def contiguous_folds(df: DataFrame, cls: str, block: str, folds: int = 5, lock: float = 0.2) -> DataFrame:
    """df + fold, locked: the last blocks of a class, a share rounded half to even but one at least, are locked with
    fold -1; the earlier ones fill the folds in order."""
    rank = F.dense_rank().over(Window.partitionBy(cls).orderBy(block))
    n = F.max("__rank").over(Window.partitionBy(cls))
    n_lock = F.greatest(F.lit(1), F.bround(lock * F.col("__n"), 0).cast("int"))
    out = df.withColumn("__rank", rank).withColumn("__n", n).withColumn("__lock", n_lock)
    locked = F.col("__rank") > F.col("__n") - F.col("__lock")
    fold = F.when(locked, -1).otherwise(F.floor((F.col("__rank") - 1) * folds / F.greatest(F.lit(1), F.col("__n") - F.col("__lock"))))
    return out.withColumn("locked", locked).withColumn("fold", fold.cast("int")).drop("__rank", "__n", "__lock")


def greedy_lock(groups: DataFrame, cls: str, group: str, size: str, order: str, budget: float = 0.15, total: str | None = None) -> DataFrame:
    """(cls, group, locked): groups of a class in order are locked while the class's share stays within the budget; one
    that doesn't fit is passed over and later ones are still tried. groups: one row a group, few to a class; total: a
    class's size if it isn't the sum of these groups."""
    whole = F.sum(size) if total is None else F.max(total)
    rows = groups.groupBy(cls).agg(F.array_sort(F.collect_list(F.struct(order, group, size))).alias("all"), whole.alias("total"))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<string>").alias("taken"))

    def step(s: Column, g: Column) -> Column:
        fits = s["used"] + g[size] <= F.col("total") * budget
        used = F.when(fits, s["used"] + g[size]).otherwise(s["used"])
        return F.struct(used.cast("double").alias("used"), F.when(fits, F.concat(s["taken"], F.array(g[group]))).otherwise(s["taken"]).alias("taken"))

    taken = rows.select(cls, "all", F.aggregate("all", start, step)["taken"].alias("taken"))
    one = taken.select(cls, "taken", F.explode("all").alias("g"))
    return one.select(cls, F.col(f"g.{group}").alias(group), F.array_contains("taken", F.col(f"g.{group}")).alias("locked"))


def stratified_lock(df: DataFrame, category: str, unit: str, share: float, seed: int) -> DataFrame:
    """df + locked: of each category a share, rounded half to even, drawn by hash."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(draw(seed, unit), unit))
    return df.withColumn("locked", place <= F.bround(share * F.count("*").over(Window.partitionBy(category)), 0))


def stratified_folds(df: DataFrame, category: str, unit: str, folds: int, seed: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(category).orderBy(draw(seed, unit), unit))
    return df.withColumn("fold", F.pmod(place - 1, F.lit(folds)).cast("int"))


#: Groups that are dealt to folds one after the other; more are cut into lots by hash, each balanced by itself.
LOT = 2_000


def group_folds(df: DataFrame, group: str, cls: str, folds: int = 5) -> DataFrame:
    """df + fold: no group in two folds, and classes spread evenly.

    Groups come in order of the sum of their squared shares of classes, largest first, ties by name. Each goes to the fold
    whose fullest class, by share, is least full with the group added; ties to the fold of least shares in all, then the
    first. Rows without a group are a group of their own, those without a class a class.
    """
    named = F.coalesce(F.col(cls).cast("string"), F.lit("")).alias("__c")
    counts = df.groupBy(F.col(group).alias("__group"), named).agg(F.count("*").alias("n"))
    classes = [(r["__c"], r["n"]) for r in counts.groupBy("__c").agg(F.sum("n").alias("n")).orderBy("__c").collect()]  # a row a class
    if not classes:
        return df.withColumn("fold", F.lit(None).cast("int"))
    sizes = counts.groupBy("__group").agg(F.map_from_entries(F.collect_list(F.struct("__c", "n"))).alias("m"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    own = F.array(*(F.coalesce(F.element_at("m", F.lit(c)), F.lit(0)) / F.lit(float(n)) for c, n in classes))
    sizes = sizes.select("__group", own.alias("own")).withColumn("order", -total(F.transform("own", lambda x: x * x)))
    lots = max(1, -(-sizes.count() // LOT))
    lot = F.pmod(F.xxhash64("__group"), F.lit(lots))
    entry = F.struct("order", "__group", "own")
    queued = sizes.groupBy(lot.alias("lot")).agg(F.array_sort(F.collect_list(entry)).alias("queue"))
    empty = F.array_repeat(F.array_repeat(F.lit(0.0), len(classes)), folds)
    start = F.struct(empty.alias("loads"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, g: Column) -> Column:
        price = lambda load, i: F.struct(F.array_max(F.zip_with(load, g["own"], lambda n, k: n + k)).alias("p"), total(load).alias("n"), i.alias("i"))
        best = F.array_min(F.transform(state["loads"], price))["i"]
        grown = lambda b: F.transform(state["loads"], lambda load, i: F.when(i == b, F.zip_with(load, g["own"], lambda n, k: n + k)).otherwise(load))
        # The best fold is found once and then used twice.
        return F.get(F.transform(F.array(best), lambda b: F.struct(grown(b).alias("loads"), F.array_append(state["taken"], b).alias("taken"))), F.lit(0))

    dealt = queued.select("queue", F.aggregate("queue", start, step)["taken"].alias("taken"))
    one = dealt.select(F.explode(F.arrays_zip("queue", "taken")).alias("z")).select(F.col("z.queue.__group").alias("__group"), F.col("z.taken").alias("fold"))
    return df.join(one, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")


def group_sample(df: DataFrame, cls: str, group: str, unit: str, groups: int, rows: int, seed: int) -> DataFrame:
    """Of each class `rows` rows at most from `groups` groups at most, both drawn by hash."""
    chosen = df.select(cls, group).distinct().withColumn("__g", F.row_number().over(Window.partitionBy(cls).orderBy(draw(seed, cls, group), group))).filter(F.col("__g") <= groups)
    place = F.row_number().over(Window.partitionBy(cls).orderBy(draw(seed + 1, unit), unit))
    return df.join(chosen.select(cls, group), [cls, group], "left_semi").withColumn("__u", place).filter(F.col("__u") <= rows).drop("__u")


def curve_points(block: int = 50) -> list[tuple[int, int]]:
    """The 18 (groups, clips) sizes of the learning curve; -1 stands for all, groups hold `block` clips."""
    sizes = [(g, c) for g in (1, 3, -1) for c in (5, 10, 25, 50, 100, 200, -1)]
    return [(0, 0)] + [(g, c) for g, c in sizes if not (g > 0 and c > block * g) and (g, c) != (1, -1)]


def learning_curve_points(spark) -> DataFrame:
    return spark.createDataFrame(curve_points(), "groups int, clips int")


def table_digest(df: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """One row, digest: 16 hex digits for the rows as text, whatever their order. For frozen split tables.

    Rows are hashed one by one, hashes are put together in order by their first three digits, and those 4096 at most once
    more, so no task holds more than a few thousandths of the table.
    """
    row = F.sha2(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    lots = df.select(row.alias("row")).groupBy(F.substring("row", 1, 3).alias("lot")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ","), 256).alias("digest"))
    every = lots.agg(F.array_sort(F.collect_list(F.struct("lot", "digest"))).alias("all"))
    return every.select(F.substring(F.sha2(F.array_join(F.col("all.digest"), ","), 256), 1, 16).alias("digest"))


def focal_lock(units: DataFrame, cutoff: str, seed: int = 0, least: int = 30, budget: float = 0.15) -> DataFrame:
    """units (unit_id, acoustic_class, split_group, date) + locked.

    Of each class with `least` units, groups of that class alone whose dates are all known and not before the cutoff are
    candidates, in an order drawn by hash; the first half of them, rounded up, is tried against the budget.
    """
    safe = F.coalesce(F.col("date").try_cast("date") >= F.lit(cutoff).cast("date"), F.lit(False))
    groups = units.groupBy("split_group").agg(F.count_distinct("acoustic_class").alias("classes"), F.min("acoustic_class").alias("cls"), F.count("*").alias("n"), F.bool_and(safe).alias("safe"))
    totals = units.groupBy(F.col("acoustic_class").alias("cls")).agg(F.count("*").alias("total")).filter(F.col("total") >= least)
    eligible = groups.filter("classes = 1 and safe").join(totals, "cls").withColumn("order", draw(seed, "split_group"))
    place = F.row_number().over(Window.partitionBy("cls").orderBy("order", "split_group"))
    half = F.ceil(F.count("*").over(Window.partitionBy("cls")) / 2)
    tried = eligible.withColumn("place", place).withColumn("half", half).filter("place <= half")
    taken = greedy_lock(tried, "cls", "split_group", "n", "order", budget, "total").filter("locked").select("split_group", F.lit(True).alias("__locked"))
    return units.join(taken, "split_group", "left").withColumn("locked", F.coalesce("__locked", F.lit(False))).drop("__locked")


UNIT_COLUMNS = ["unit_id", "kind", "source", "acoustic_class", "split_group", "domain", "fold", "locked"]


def build_splits(manifest: DataFrame, background: DataFrame, focal: list[str], recorder: str, cutoff: str, seed: int = 0, folds: int = 5) -> DataFrame:
    """UNIT_COLUMNS of all units: focal recordings of the manifest (recording_id, source, acoustic_class, split_group, date,
    fold), recorder clips of the source `recorder`, and background clips (clip_id, category).

    Recorder clips get contiguous folds of their blocks, the last ones locked; background is locked and folded within
    categories. A unit that occurs twice, or is neither locked nor in a fold, fails when it is read.
    """
    frogs = manifest.withColumnRenamed("recording_id", "unit_id").withColumn("kind", F.lit("frog"))
    own = focal_lock(frogs.filter(F.col("source").isin(focal)), cutoff, seed).withColumn("domain", F.lit("focal"))
    clips = contiguous_folds(frogs.filter(F.col("source") == recorder).drop("fold"), "acoustic_class", "split_group", folds).withColumn("domain", F.lit("aru"))
    quiet = background_units(background, seed, folds).withColumn("source", F.lit(recorder))
    units = own.select(*UNIT_COLUMNS).unionByName(clips.select(*UNIT_COLUMNS)).unionByName(quiet.select(*UNIT_COLUMNS))
    times = F.count("*").over(Window.partitionBy("unit_id"))
    wrong = F.when(times > 1, F.concat(F.lit("unit occurs twice: "), "unit_id")).when((F.col("fold") < 0) & ~F.col("locked"), F.concat(F.lit("unit without a fold: "), "unit_id"))
    return units.withColumn("fold", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("int")).otherwise(F.col("fold").cast("int")))


def background_units(clips: DataFrame, seed: int = 0, folds: int = 5, lock: float = 0.2) -> DataFrame:
    """Background clips (clip_id, category) as units: each a group of its own, a share of each category locked by a draw,
    folds dealt out within categories by another."""
    held = stratified_lock(clips.select(F.col("clip_id").alias("unit_id"), "category"), "category", "unit_id", lock, seed)
    dealt = stratified_folds(held, "category", "unit_id", folds, seed + 1)
    none = F.lit(None).cast("string")
    return dealt.select("unit_id", F.lit("background").alias("kind"), none.alias("acoustic_class"), F.concat(F.lit("bg:"), "unit_id").alias("split_group"), F.lit("aru").alias("domain"), "fold", "locked")
