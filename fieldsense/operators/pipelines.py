"""Whole runs put together from the operators: manifest, catalogue, splits, evaluation, comparison, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldsense.functions import text as T
from fieldsense.operators import catalog, dedupe, metrics, splits, windows
from fieldsense.operators.sizes import small

#: Of recordings found twice, the one from the earliest source stays.
SOURCES = ["herps", "xc", "inat", "aru"]
FOCAL = SOURCES[:3]
LEAST_SECONDS = 0.2


def build_manifest(sources: list[DataFrame], probes: DataFrame, classes: DataFrame, folds: int = 5) -> DataFrame:
    """One row a usable recording.

    sources: tables of recordings (recording_id, source, label, path, secondary_species, call_types, recordist, date,
    lat, lon, caption, context, block; what a source lacks is null). probes: path, duration_s, decode_error, md5.
    classes: label, acoustic_class; a label that it lacks fails the build. Unreadable and short files go, then equal
    files, then cross-posts; folds keep groups whole and are -1 for recorder clips.
    """
    texts = ["source", "label", "recordist", "caption", "context", "date", "path"]
    wanted = {c: "string" for c in texts} | {"recording_id": "string", "lat": "double", "lon": "double", "block": "int", "secondary_species": "array<string>", "call_types": "array<string>"}
    conformed = [s.select(*((F.col(c) if c in s.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items())) for s in sources]
    every = reduce(lambda a, b: a.unionByName(b), conformed).filter("path is not null")
    for c in ("secondary_species", "call_types"):
        every = every.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    probed = every.join(probes.select("path", "duration_s", "decode_error", "md5"), "path", "left")
    good = probed.filter(F.col("duration_s").isNotNull() & F.col("decode_error").isNull() & (F.col("duration_s") >= LEAST_SECONDS))
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    one = dedupe.merge_labels(good, "md5", "label", "secondary_species", rank, "recording_id")
    posted = one.withColumn("post", dedupe.crosspost_key(F.col("date"), F.col("lat"), F.col("lon"), F.col("duration_s")))
    one = dedupe.merge_labels(posted, "post", "label", "secondary_species", rank, "recording_id").drop("post", "decode_error")
    known = one.join(small(classes.select("label", "acoustic_class")), "label", "left")
    unknown = F.raise_error(F.concat(F.lit("label not in the classes: "), F.coalesce("label", F.lit("null")))).cast("string")
    named = known.withColumn("acoustic_class", F.coalesce("acoustic_class", unknown)).withColumn("medium", T.medium(F.col("call_types"), F.col("caption")))
    group = T.split_group(F.col("source"), F.col("label"), T.county(F.col("caption"), F.col("context")), F.col("block"), F.col("recordist"))
    named = named.withColumn("split_group", group)
    focal = splits.group_folds(named.filter(F.col("source").isin(FOCAL)), "split_group", "acoustic_class", folds)
    return focal.unionByName(named.filter(~F.col("source").isin(FOCAL)).withColumn("fold", F.lit(-1)))


def catalog_windows(recordings: DataFrame, spans: DataFrame, width: float = 3.0, hop: float = 3.0) -> DataFrame:
    """(recording_id, window_idx, start_s, end_s, class, state) by label kind.

    weak and clip: every window for each class of the recording. box: windows that a live box hits; of an exhaustive
    recording, the others as negative. negative: every window. recordings: recording_id, label_kind, exhaustive,
    duration_s; spans: recording_id, start_s, end_s, class, dropped.
    """
    framed = windows.frame(recordings.select("recording_id", "label_kind", "exhaustive", "duration_s"), width, hop)
    live = spans.filter(~F.col("dropped"))
    out = ["recording_id", "window_idx", "start_s", "end_s", "class", "state"]
    whole = framed.filter(F.col("label_kind").isin("weak", "clip")).join(live.filter("class is not null").select("recording_id", "class").distinct(), "recording_id").withColumn("state", F.col("label_kind"))
    boxed = framed.filter("label_kind = 'box'")
    boxes = live.select("recording_id", F.col("start_s").alias("box_start"), F.col("end_s").alias("box_end"), "class")
    hits = windows.box_hits(boxed, boxes, "recording_id", bucket=30.0)
    hit = boxed.join(hits, ["recording_id", "window_idx"]).withColumn("state", F.lit("box"))
    free = boxed.filter("exhaustive").join(hits, ["recording_id", "window_idx"], "left_anti").unionByName(framed.filter("label_kind = 'negative'"))
    negative = free.withColumn("class", F.lit(None).cast("string")).withColumn("state", F.lit("negative"))
    return reduce(lambda a, b: a.unionByName(b), [x.select(*out) for x in (whole, hit, negative)])


def unit_scores(window_scores: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit, class, score): the mean over seeds of each window, then the best window."""
    by_window = window_scores.groupBy(unit, "window_idx", "class").agg(F.avg("score").alias("score"))
    return by_window.groupBy(unit, "class").agg(F.max("score").alias("score"))


def evaluate(scores: DataFrame, units: DataFrame) -> DataFrame:
    """(tier, class, n, positives, ap, recall, threshold) from (unit_id, class, score) and units (unit_id, own class,
    domain, locked, masked). A unit isn't judged for classes in its mask; locked units aren't judged at all."""
    judged = scores.join(units.filter(~F.col("locked")).select("unit_id", F.col("class").alias("own"), "domain", "masked"), "unit_id").filter(~F.array_contains("masked", F.col("class")))
    judged = judged.withColumn("tier", F.when(F.col("domain") == "focal", "A").otherwise("B")).withColumn("y", F.coalesce(F.col("own") == F.col("class"), F.lit(False)))
    keys = ["tier", "class"]
    counts = judged.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("y").alias("positives"))
    return counts.join(metrics.average_precision(judged, keys), keys).join(metrics.recall_at_precision(judged, keys, 0.9), keys)


def compare_runs(a: DataFrame, b: DataFrame, units: DataFrame, n_boot: int = 1000) -> DataFrame:
    """(class, delta, ci_lo, ci_hi, significant) of run b against run a, both (unit_id, class, score); runs over
    different units or classes fail."""
    key = ["unit_id", "class"]
    odd = a.select(*key).exceptAll(b.select(*key)).union(b.select(*key).exceptAll(a.select(*key)))
    if not odd.isEmpty():
        raise ValueError("the runs have scored different units")
    both = a.withColumnRenamed("score", "score_a").join(b.withColumnRenamed("score", "score_b"), key)
    judged = both.join(units.select("unit_id", F.col("class").alias("own"), "split_group"), "unit_id").withColumn("y", F.coalesce(F.col("own") == F.col("class"), F.lit(False)))
    return metrics.paired_delta(judged, ["class"], "split_group", n_boot, "score_a", "score_b")


def record_run(spark: SparkSession, registry: str, name: str, scores: DataFrame, table: DataFrame) -> None:
    """Write a run's scores and table below the registry, one folder a run, and refuse a name that is there."""
    scores.write.mode("errorifexists").parquet(f"{registry}/scores/name={name}")
    table.write.mode("errorifexists").parquet(f"{registry}/tables/name={name}")


def freeze_splits(table: DataFrame, path: str) -> str:
    """Write a split table once and return its digest."""
    table.write.mode("errorifexists").parquet(path)
    return splits.table_digest(table, "unit_id", sorted(table.columns)).first()[0]


def load_splits(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """The frozen table, if its digest is still the same."""
    table = spark.read.parquet(path)
    if splits.table_digest(table, "unit_id", sorted(table.columns)).first()[0] != digest:
        raise ValueError(f"{path} isn't what was frozen")
    return table


def load_windows(labels: DataFrame, background: DataFrame, manifest: DataFrame, units: DataFrame) -> DataFrame:
    """Training windows (unit_id, window_idx, kind, source, acoustic_class, state, masked, fold, locked): labelled windows of
    recordings (recording_id, window_idx, acoustic_class, state, masked) and background windows (clip_id, window_idx). A
    window whose unit isn't in the splits fails when it is read."""
    sources = manifest.select("recording_id", "source")
    frog = labels.join(sources, "recording_id", "left").select(F.col("recording_id").alias("unit_id"), "window_idx", F.lit("frog").alias("kind"), "source", "acoustic_class", "state", "masked")
    none = F.array().cast("array<string>")
    quiet = background.select(F.col("clip_id").alias("unit_id"), "window_idx", F.lit("background").alias("kind"), F.lit("aru").alias("source"), F.lit(None).cast("string").alias("acoustic_class"), F.lit("neg").alias("state"), none.alias("masked"))
    placed = frog.unionByName(quiet).join(units.select("unit_id", "fold", "locked"), "unit_id", "left")
    lost = F.raise_error(F.concat(F.lit("a window's unit isn't in the splits: "), "unit_id")).cast("boolean")
    return placed.withColumn("locked", F.coalesce("locked", lost))


def dev_units(windows: DataFrame, units: DataFrame, manifest: DataFrame, cutoff: str, pretrained: tuple[str, ...] = ("inat", "xc")) -> DataFrame:
    """Units with windows that aren't locked, as evaluation takes them. Recordings of sources that encoders were trained on
    are leakage-safe from the cutoff on."""
    seen = windows.groupBy("unit_id").agg(F.min_by("masked", "window_idx").alias("masked"))
    about = manifest.select(F.col("recording_id").alias("unit_id"), "date", "medium")
    u = units.filter(~F.col("locked")).join(seen, "unit_id").join(about, "unit_id", "left")
    recent = F.coalesce(F.col("date").try_cast("date") >= F.lit(cutoff).cast("date"), F.lit(False))
    safe = ~F.coalesce(F.col("source").isin(*pretrained), F.lit(False)) | recent
    return u.select("unit_id", F.col("acoustic_class").alias("own"), "kind", "domain", "locked", "fold", "masked", safe.alias("leakage_safe"), F.coalesce("medium", F.lit("air")).alias("medium"), "split_group")


def baseline_report(judged: DataFrame) -> DataFrame:
    """(subset, class, n, positives, ap): all units, leakage-safe ones and those in air; ap where a class has both positives
    and others, masked units left out."""
    parts = F.array_compact(F.array(F.lit("all"), F.when(F.col("leakage_safe"), "leakage_safe"), F.when(F.col("medium") == "air", "air")))
    rows = judged.filter(~F.col("masked_out")).withColumn("subset", F.explode(parts))
    counts = rows.groupBy("subset", "class").agg(F.count("*").alias("n"), F.count_if("y").alias("positives"))
    ap = metrics.average_precision(rows, ["subset", "class"])
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return counts.join(ap, ["subset", "class"]).withColumn("ap", F.when(mixed, F.col("ap")))


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Small report tables, one folder each, as CSV with a header or as JSON lines."""
    for name, table in tables.items():
        table.write.mode("errorifexists").format(kind).options(**({"header": True} if kind == "csv" else {})).save(f"{folder}/{name}")


def review_table(found: DataFrame, recordings: DataFrame, per_class: int | None = None) -> DataFrame:
    """Windows to look at, most active first: recordings' path and names beside them; per_class as a top-k report."""
    out = found.join(recordings.select("recording_id", F.col("path").alias("audio_path"), "common_name", "source"), "recording_id")
    if per_class is None:
        return out
    place = F.row_number().over(Window.partitionBy("acoustic_class").orderBy(F.desc("activity_db"), "recording_id", "window_idx"))
    return out.withColumn("place", place).filter(F.col("place") <= per_class).drop("place")
