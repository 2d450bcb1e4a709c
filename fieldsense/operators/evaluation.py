"""Evaluation of a run: headline metrics, tables by class, thresholds, detection.

Scores are long: one row a unit and class (unit_id, class, score). Units: unit_id, own (its class, null for background),
kind (frog or background), domain (focal or aru), locked, fold, masked, leakage_safe, medium, split_group. Tier A are focal
units, tier B recorder clips; locked units aren't judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsense.operators import metrics

#: Classes with fewer focal units are rare; a score of FIRES or more counts as found; background clips last CLIP_S.
RARE, FIRES, CLIP_S = 30, 0.5, 3.0


def judged(scores: DataFrame, units: DataFrame) -> DataFrame:
    """scores + the units' columns, tier, y (the class is the unit's own) and masked_out, of units that aren't locked."""
    rows = scores.select("unit_id", "class", "score").join(units.filter(~F.col("locked")), "unit_id")
    tier = F.when(F.col("domain") == "focal", "A").when(F.col("domain") == "aru", "B")
    y = F.coalesce(F.col("own") == F.col("class"), F.lit(False))
    return rows.withColumns({"tier": tier, "y": y, "masked_out": F.coalesce(F.array_contains("masked", F.col("class")), F.lit(False))})


def evaluable(units: DataFrame) -> DataFrame:
    """(class, n): classes of focal units that aren't locked in two folds at least, with their units."""
    dev = units.filter("domain = 'focal' and not locked and own is not null")
    counted = dev.groupBy(F.col("own").alias("class")).agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"))
    return counted.filter("folds >= 2").select("class", "n")


def heard_classes(units: DataFrame) -> DataFrame:
    """(class) of frogs in recorder clips that aren't locked."""
    return units.filter("domain = 'aru' and not locked and kind = 'frog'").select(F.col("own").alias("class")).distinct()


def _ranked(rows: DataFrame, ev: DataFrame, heard: DataFrame) -> DataFrame:
    """What the headline ranks, long: (tier, class, part, of_group, score, y) of evaluable classes in tier A and its parts, of
    the classes heard in tier B, and as tier D of tier B's units by their best score. Groups are named with their domain."""
    parts = F.array_compact(F.array(F.lit("all"), F.when(F.col("leakage_safe"), "leakage_safe"), F.when(F.col("medium") == "air", "air")))
    b = rows.filter("tier = 'B'")
    best = b.groupBy("unit_id").agg(F.max("score").alias("score"), F.first(F.col("kind") == "frog").alias("y"), F.first("split_group").alias("split_group"))
    of = lambda df, tier, cls, part, domain: df.select(F.lit(tier).alias("tier"), cls.alias("class"), part.alias("part"), _group(F.lit(domain)).alias("of_group"), F.col("score").cast("double").alias("score"), "y")
    whole, of_class = F.lit("all"), F.col("class")
    ranked = of(rows.filter("tier = 'A' and not masked_out").join(ev.select("class"), "class"), "A", of_class, F.explode(parts), "focal")
    return ranked.union(of(b.filter("not masked_out").join(heard, "class"), "B", of_class, whole, "aru")).union(of(best, "D", F.lit(""), whole, "aru"))


def _group(domain: Column) -> Column:
    return F.concat(domain, F.lit(":"), F.col("split_group").cast("string"))


def _metrics(precise: DataFrame, ev: DataFrame, by: list[str], runs: DataFrame | None) -> DataFrame:
    """(by, metric, value) from (by, tier, class, part, ap); runs: the values of by that have all metrics, those without
    rows too."""
    known = precise.join(F.broadcast(ev), "class", "left")  # a row a class
    a, whole = F.col("tier") == "A", F.col("part") == "all"
    mean = lambda c: F.avg(F.when(c, F.col("ap")))
    macro = {"A_macro_ap": mean(a & whole), "A_macro_ap_rare": mean(a & whole & (F.col("n") < RARE)), "A_macro_ap_common": mean(a & whole & (F.col("n") >= RARE))}
    macro |= {f"A_macro_ap_{p}": mean(a & (F.col("part") == p)) for p in ("leakage_safe", "air")}
    macro |= {"B_macro_ap": mean(F.col("tier") == "B"), "B_detection_ap": F.max(F.when(F.col("tier") == "D", F.col("ap")))}
    # Of resamples, a tier counts in those that drew rows of it.
    present = {"A": F.bool_or(a), "B": F.bool_or(F.col("tier") == "B"), "D": F.bool_or(F.col("tier") == "D")}
    wide = known.groupBy(*by).agg(*[v.alias(k) for k, v in macro.items()], *[v.alias(f"has_{k}") for k, v in present.items()])
    if runs is not None:
        wide = runs.join(wide, by, "left")
    tier_of = lambda k: "D" if k == "B_detection_ap" else k[0]
    listed = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), (F.lit(True) if runs is not None else F.col(f"has_{tier_of(k)}")).alias("there")) for k in macro])
    out = wide.select(*by, F.explode(listed).alias("e")).filter("e.there").select(*by, "e.metric", "e.value")
    sizes = ev.select(F.count_if(F.col("n") < RARE).alias("rare"), F.count_if(F.col("n") >= RARE).alias("common"))
    none = sizes.select(F.explode(F.array_compact(F.array(F.when(F.col("rare") == 0, "A_macro_ap_rare"), F.when(F.col("common") == 0, "A_macro_ap_common")))).alias("metric"))
    out = out.join(F.broadcast(none), "metric", "left_anti").select(*by, "metric", "value")  # two rows at most
    single = precise.filter(whole & F.col("tier").isin("A", "B")).select(*by, F.concat("tier", F.lit("_ap:"), "class").alias("metric"), F.col("ap").alias("value"))
    return out.union(single)


@contextmanager
def _headlines(runs: dict[str, DataFrame], units: DataFrame, n_boot: int) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """(run, metric, value) and, with n_boot, (run, boot_id, metric, value) of judged rows by run.

    Rows are read by one job: all that is ranked is summed by class, part, group and score, for all runs and tiers together, and
    the sums, classes and groups are kept while the block lasts. So the number of jobs doesn't depend on runs and tiers.
    """
    spark = units.sparkSession
    ev, heard = evaluable(units).persist(), heard_classes(units).persist()
    groups = units.filter(~F.col("locked") & F.col("domain").isin("focal", "aru")).select("domain", "split_group").distinct().persist()
    keys = ["run", "tier", "class", "part"]
    every = reduce(lambda x, z: x.union(z), [_ranked(r, ev, heard).select(F.lit(name).alias("run"), "*") for name, r in runs.items()])
    sums = every.groupBy(*keys, "of_group", "score").agg(F.count_if("y").cast("double").alias("pos"), F.count("*").cast("double").alias("every")).persist()
    kept = [ev, heard, groups, sums]
    try:
        table = spark.createDataFrame([(name,) for name in runs], "run string")
        point = _metrics(metrics.average_precision_of_sums(sums, keys), ev, ["run"], table)
        drawn = None
        if n_boot:
            draws = [metrics.boot_weights(groups.filter(F.col("domain") == d), "split_group", n_boot).select("boot_id", _group(F.lit(d)).alias("of_group"), "weight") for d in ("focal", "aru")]
            drawn = _metrics(metrics.boot_average_precision_of_sums(sums, keys, "of_group", n_boot, draws[0].union(draws[1])), ev, ["run", "boot_id"], None)
        yield point, drawn
    finally:
        for table in kept:
            table.unpersist()


def _kept(table: DataFrame) -> DataFrame:
    """A few numbers a metric, read before what they come from is given back."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def headline(rows: DataFrame, units: DataFrame) -> DataFrame:
    """(metric, value) from judged rows.

    A_macro_ap over evaluable classes, also of rare and common ones, of leakage-safe and of air recordings only, and A_ap:c;
    B_macro_ap over the classes heard in clips and B_ap:c; B_detection_ap of frogs against background by the best class
    score. A metric without a class to average has no row, one whose classes all lack positives is null.
    """
    with _headlines({"": rows}, units, 0) as (point, _):
        return _kept(point.select("metric", "value"))


def summarize(rows: DataFrame, units: DataFrame, n_boot: int = 500) -> DataFrame:
    """(metric, value, ci_lo, ci_hi): headline metrics with percentile intervals over resamples of each tier's groups."""
    with _headlines({"": rows}, units, n_boot) as (point, drawn):
        return _kept(point.select("metric", "value").join(metrics.interval(drawn, ["metric"], "value"), "metric", "left"))


def _ap(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return metrics.average_precision(rows, keys).withColumnRenamed("ap", name)


def _recall(rows: DataFrame, precision: float, name: str) -> DataFrame:
    return metrics.recall_at_precision(rows, ["class"], precision).select("class", F.col("recall").alias(name))


def per_class_a(rows: DataFrame, units: DataFrame) -> DataFrame:
    """(class, recordings, evaluable, ap, ap_leakage_safe, ap_air, recall_p90) of tier A's classes, units masked for a class
    left out; metrics are null for classes that aren't evaluable, or without positives in the subset."""
    a = rows.filter("tier = 'A' and not masked_out")
    classes = units.filter("domain = 'focal' and not locked and own is not null").select(F.col("own").alias("class")).distinct()
    counts = a.groupBy("class").agg(F.count_if("y").alias("recordings"))
    ev = evaluable(units).select("class", F.lit(True).alias("evaluable"))
    known = a.join(ev.select("class"), "class")
    parts = [_ap(known, ["class"], "ap"), _ap(known.filter("leakage_safe"), ["class"], "ap_leakage_safe"), _ap(known.filter("medium = 'air'"), ["class"], "ap_air"), _recall(known, 0.9, "recall_p90")]
    out = classes.join(counts, "class", "left").join(ev, "class", "left").withColumns({"recordings": F.coalesce("recordings", F.lit(0)), "evaluable": F.coalesce("evaluable", F.lit(False))})
    return reduce(lambda x, part: x.join(part, "class", "left"), parts, out)


def per_class_b(rows: DataFrame) -> DataFrame:
    """One row a class over recorder clips, masked or not: clips, false finds an hour of background, share of other frogs'
    clips where it fires; of classes with clips also ap, recall at precision 0.9 and 0.95, review effort at recall 0.9,
    recall at 0.5 and ap_block, of presence by group."""
    b = rows.filter("tier = 'B'")
    background, fires = F.col("kind") == "background", F.col("score") >= FIRES
    hours = F.count_if(background) * F.lit(CLIP_S / 3600)
    counts = b.groupBy("class").agg(
        F.count_if("y").alias("clips"),
        F.try_divide(F.count_if(background & fires).cast("double"), hours).alias("fp_per_hour"),
        F.avg(F.when(~background & ~F.col("y"), fires.cast("double"))).alias("fires_on_others"),
        F.avg(F.when(F.col("y"), fires.cast("double"))).alias("recall_at_half"),
    )
    has = b.join(counts.filter("clips > 0").select("class"), "class", "left_semi")
    blocks = has.groupBy("class", "split_group").agg(F.max("score").alias("score"), F.bool_or("y").alias("y"))
    parts = [_ap(has, ["class"], "ap"), _recall(has, 0.9, "recall_p90"), _recall(has, 0.95, "recall_p95"), metrics.review_effort(has, ["class"], 0.9), _ap(blocks, ["class"], "ap_block")]
    return reduce(lambda x, part: x.join(part, "class", "left"), parts, counts)


def thresholds(rows: DataFrame, units: DataFrame, precision: float = 0.9) -> DataFrame:
    """(class, threshold, recall, pool): the score that reaches this precision, over recorder clips for classes heard there,
    else over focal units; masked units are left out, and so are classes without positives."""
    heard = heard_classes(units).withColumn("pool", F.lit("aru"))
    pooled = rows.filter("not masked_out").join(heard, "class", "left").withColumn("pool", F.coalesce("pool", F.lit("focal")))
    pooled = pooled.filter(F.col("domain") == F.col("pool"))
    with_positives = pooled.filter("y").select("class").distinct()
    out = metrics.recall_at_precision(pooled.join(with_positives, "class", "left_semi"), ["class"], precision)
    return out.join(pooled.select("class", "pool").distinct(), "class").select("class", "threshold", "recall", "pool")


def detection(windows: DataFrame) -> DataFrame:
    """(level, ap, fp_share) of frogs against background, from windows (unit_id, kind, state, score): positive frog windows
    and all background windows one by one, then the best window of each clip; fp_share: background that fires."""
    kept = windows.filter("kind = 'background' or state = 'pos'").select("unit_id", "score", (F.col("kind") == "frog").alias("y"))
    clips = windows.groupBy("unit_id").agg(F.max("score").alias("score"), F.max(F.col("kind") == "frog").alias("y"))
    both = kept.withColumn("level", F.lit("window")).unionByName(clips.withColumn("level", F.lit("clip")))
    false = both.groupBy("level").agg(F.avg(F.when(~F.col("y"), (F.col("score") >= FIRES).cast("double"))).alias("fp_share"))
    return metrics.average_precision(both, ["level"]).join(false, "level")


def delta_headline(a: DataFrame, b: DataFrame, units: DataFrame, n_boot: int = 1000) -> DataFrame:
    """(metric, delta, ci_lo, ci_hi, significant) of judged rows b against a over the same resamples; metrics that one run
    lacks are left out."""
    side = lambda table, run, name: table.filter(F.col("run") == run).drop("run").withColumnRenamed("value", name)
    with _headlines({"a": a, "b": b}, units, n_boot) as (points, drawn):
        point = side(points, "a", "before").join(side(points, "b", "after"), "metric")
        both = drawn.groupBy("boot_id", "metric").pivot("run", ["a", "b"]).agg(F.first("value"))
        spread = metrics.interval(both.withColumn("delta", F.col("b") - F.col("a")), ["metric"], "delta")
        out = point.select("metric", (F.col("after") - F.col("before")).alias("delta")).join(spread, "metric", "left")
        return _kept(out.withColumn("significant", F.coalesce((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0), F.lit(False))))


def adopt(deltas: DataFrame) -> DataFrame:
    """One row (primary, delta, adopt): B_macro_ap if it is there, else A_macro_ap_rare decides; no class may lose more than
    0.05."""
    order = F.when(F.col("metric") == "B_macro_ap", 0).when(F.col("metric") == "A_macro_ap_rare", 1)
    worst = F.min(F.when(F.contains("metric", F.lit(":")), F.col("delta")))
    both = deltas.agg(worst.alias("worst"), F.min_by(F.struct("metric", "delta", "ci_lo"), order).alias("best")).filter("best is not null")
    decided = metrics.decide(F.col("best.delta"), F.col("best.ci_lo"), F.coalesce("worst", F.lit(0.0)))
    return both.select(F.col("best.metric").alias("primary"), "best.delta", decided.alias("adopt"))
