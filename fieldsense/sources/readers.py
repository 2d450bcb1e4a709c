"""Readers of recordings, boxes, answers, cards and ranges."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys of a dataset card and the values that they may have.
CARD_KEYS = ["name", "kind", "raw_dir", "reader", "label_kind", "license"]
KINDS, CARD_LABEL_KINDS = ["focal", "aru"], ["weak", "clip", "box", "negative"]


def check_card(card: dict) -> dict:
    """The card, if it has all keys and known values; else ValueError."""
    missing = [k for k in CARD_KEYS if k not in card]
    if missing:
        raise ValueError(f"card {card.get('name')} lacks {', '.join(missing)}")
    for key, known in (("kind", KINDS), ("label_kind", CARD_LABEL_KINDS), ("reader", sorted(READERS))):
        if card[key] not in known:
            raise ValueError(f"card {card['name']}: {key} is {card[key]}, not one of {', '.join(known)}")
    return card


def read_cards(folder: str) -> list[dict]:
    """Checked cards of a local folder's YAML files, by file name."""
    import yaml

    return [check_card(yaml.safe_load(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.yaml"))]


def taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(code, scientific, common, acoustic_class) of the vocal species of a local YAML file, and (label, acoustic_class): a
    species stands for its group, or for itself without one; groups stand for themselves."""
    import yaml

    listed = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    species = [(s["code"], s["scientific"], s.get("common"), s.get("acoustic_group", s["code"])) for s in listed["species"] if s.get("vocal", True)]
    classes = {s[0]: s[3] for s in species} | {g["code"]: g["code"] for g in listed.get("groups", [])}
    kind = "code string, scientific string, common string, acoustic_class string"
    return spark.createDataFrame(species, kind), spark.createDataFrame(sorted(classes.items()), "label string, acoustic_class string")


RECORDINGS = ["recording_id", "path", "duration_s", "sample_rate", "label_kind", "exhaustive", "site_id", "date"]
SPANS = ["recording_id", "start_s", "end_s", "acoustic_class", "source_label", "dropped"]


def read_manifest(spark: SparkSession, card: dict) -> tuple[DataFrame, DataFrame]:
    """Recordings of one source of the manifest and a span over each. reader_args: manifest, source, site_from (county,
    latlon or nothing)."""
    args = card["reader_args"]
    m = spark.read.parquet(args["manifest"]).filter(F.col("source") == args["source"])
    county = F.element_at(F.split("split_group", ":"), -1)
    place = F.concat_ws(",", F.bround("lat", 2).cast("string"), F.bround("lon", 2).cast("string"))
    sites = {"county": F.when(county != "unknown", county), "latlon": F.when(F.col("lat").isNotNull(), place)}
    site = sites.get(args.get("site_from"), F.lit(None).cast("string"))
    rec = m.withColumns({"site_id": site, "date": F.date_format(F.col("date").try_cast("date"), "yyyy-MM-dd"), "label_kind": F.lit(card["label_kind"]), "exhaustive": F.lit(bool(card.get("exhaustive", False)))})
    spans = m.select("recording_id", F.lit(0.0).alias("start_s"), F.col("duration_s").alias("end_s"), "acoustic_class", F.col("label").alias("source_label"), F.lit(False).alias("dropped"))
    return rec.select(*[c for c in RECORDINGS if c in rec.columns]), spans


def read_clip_table(spark: SparkSession, card: dict) -> tuple[DataFrame, DataFrame]:
    """Clips of a table that may be used: frog clips, and background clips without a frog as exhaustive negatives.
    reader_args: table (CSV), classes (code -> class)."""
    args = card["reader_args"]
    c = spark.read.option("header", True).csv(args["table"]).filter("use = 'yes'")
    frog = F.col("kind") == "frog"
    classes = F.create_map(*[x for k, v in args["classes"].items() for x in (F.lit(k), F.lit(v))])
    rec = c.select(
        F.col("clip_id").alias("recording_id"), F.col("file").alias("path"), F.col("duration_s").cast("double").alias("duration_s"), F.col("sample_rate").cast("int").alias("sample_rate"),
        F.when(frog, "clip").otherwise("negative").alias("label_kind"), (~frog).alias("exhaustive"), "site_id", "date",
    )
    cls = F.when(frog, F.try_element_at(classes, F.col("code")))
    return rec, c.select(F.col("clip_id").alias("recording_id"), F.lit(0.0).alias("start_s"), F.col("duration_s").cast("double").alias("end_s"), cls.alias("acoustic_class"), F.col("label").alias("source_label"), F.lit(False).alias("dropped"))


def read_boxes(spark: SparkSession, card: dict) -> tuple[DataFrame, DataFrame]:
    """Recordings of selection tables and their boxes. reader_args: tables (path), labels (what annotators wrote -> class or
    None to drop), durations (a table of recording_id, duration_s), filename (a pattern with groups device and date)."""
    args = card["reader_args"]
    boxes = box_tables(spark, args["tables"], args["labels"])
    spans = boxes.select(F.col("recording_id"), F.col("box_start").alias("start_s"), F.col("box_end").alias("end_s"), F.col("class").alias("acoustic_class"), F.lit(None).cast("string").alias("source_label"), "dropped")
    site, date = recorder_names(F.col("recording_id"), args.get("filename"), card.get("sites", []))
    rec = args["durations"].select("recording_id", "duration_s", F.lit(card["label_kind"]).alias("label_kind"), F.lit(bool(card.get("exhaustive", False))).alias("exhaustive"), site.alias("site_id"), date.alias("date"))
    return rec, spans.select(*SPANS)


def recorder_names(stem: Column, pattern: str | None, sites: list[dict]) -> tuple[Column, Column]:
    """Site and ISO date of a recorder's file name by a Java pattern whose groups 1 and 2 are device and date (yyyyMMdd). A
    device that has no site gets the only site, if there is one."""
    only = F.lit(sites[0]["site_id"] if len(sites) == 1 else None).cast("string")
    if not pattern:
        return only, F.lit(None).cast("string")
    device, day = F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2)
    known = F.create_map(*[x for s in sites if s.get("device_id") for x in (F.lit(s["device_id"]), F.lit(s["site_id"]))]) if any(s.get("device_id") for s in sites) else None
    site = only if known is None else F.coalesce(F.try_element_at(known, device), only)
    return site, F.date_format(F.try_to_date(day, "yyyyMMdd"), "yyyy-MM-dd")


#: Readers by the name that cards give: (spark, card) -> recordings, spans.
READERS = {"manifest": read_manifest, "clips": read_clip_table, "raven": read_boxes}


def read_dataset(spark: SparkSession, card: dict) -> tuple[DataFrame, DataFrame]:
    """Recordings and spans of a card's dataset, with its name beside each recording."""
    recordings, spans = READERS[check_card(card)["reader"]](spark, card)
    return recordings.withColumn("dataset", F.lit(card["name"])), spans


def package_ids(name: Column) -> dict[str, Column]:
    """ds_id, map_id (upper case) and is_range of a range map's package name."""
    # How the packages are named.
    found = {"ds_id": F.regexp_extract(name, r"-(ds\d+)$", 1), "map_id": F.upper(F.regexp_extract(name, r"-cwhr-(a\d+[a-z]?)-", 1))}
    return {k: F.nullif(c, F.lit("")) for k, c in found.items()} | {"is_range": F.contains(name, F.lit("-range-")) & ~F.contains(name, F.lit("predicted-habitat"))}


def check_ranges(ranges: dict) -> dict[str, tuple[str, str]]:
    """(source, reference) by code; a package that isn't a range map fails. A bare text names a package of the state's maps,
    {source: reference} another source."""
    out = {}
    for code, entry in ranges.items():
        source, ref = ("cwhr", entry) if isinstance(entry, str) else next(iter(entry.items()))
        if source == "cwhr" and ("-range-" not in ref or "predicted-habitat" in ref):
            raise ValueError(f"{code}: {ref} isn't a range map")
        out[code] = (source, ref)
    return out


def unit_presence(units: DataFrame) -> DataFrame:
    """One row (map_id, season) of a range's watersheds (strUC, Presence, Season); one that isn't known to hold the species
    fails the read."""
    # Presence of a species that is there, and its season all year.
    sure = F.bool_and(F.col("Presence") == "Known/extant")
    seasons = F.array_sort(F.collect_set("Season"))
    one = units.agg(F.min("strUC").alias("map_id"), sure.alias("sure"), seasons.alias("seasons"))
    season = F.when(F.array_join("seasons", ",") == "Year-round", "Y").otherwise(F.array_join("seasons", ","))
    return one.select(F.when(F.col("sure"), F.col("map_id")).otherwise(F.raise_error(F.lit("a range holds watersheds of uncertain presence")).cast("string")).alias("map_id"), season.alias("season"))


def flatten_sounds(records: DataFrame, key: str) -> DataFrame:
    """(key, place, url, extension, license, lat, lon): a row for each licensed sound of records (key, location "lat,lon",
    sounds as JSON)."""
    kinds = "array<struct<file_url: string, file_content_type: string, license_code: string>>"
    # File endings by content type.
    endings = F.create_map(*map(F.lit, ("audio/mpeg", "mp3", "audio/mp3", "mp3", "audio/mp4", "m4a", "audio/x-m4a", "m4a", "audio/wav", "wav", "audio/x-wav", "wav")))
    one = records.select(key, F.split("location", ",").alias("at"), F.posexplode(F.from_json("sounds", kinds)).alias("place", "s")).filter("s.license_code is not null")
    return one.select(key, "place", F.col("s.file_url").alias("url"), F.try_element_at(endings, F.col("s.file_content_type")).alias("extension"), F.col("s.license_code").alias("license"), F.get("at", F.lit(0)).try_cast("double").alias("lat"), F.get("at", F.lit(1)).try_cast("double").alias("lon"))


def check_folder(folder: Column, named: Column, codes: dict[str, str]) -> Column:
    """The folder of a clip; fails if the sheet's name for it stands for another code."""
    code = F.try_element_at(F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]), named)
    return F.when(code.eqNullSafe(folder), folder).otherwise(F.raise_error(F.concat_ws(" ", F.lit("folder"), folder, F.lit("but the sheet says"), named)).cast("string"))


def box_tables(spark: SparkSession, path: str, labels: dict[str, str | None]) -> DataFrame:
    """recording_id, box_start, box_end, class, dropped from tab-separated selection tables, one a recording.

    labels maps what annotators wrote to a class, or to None for boxes that are kept as dropped; a label it lacks
    fails the read.
    """
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)*$", 1)
    known = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.coalesce(F.lit(v), F.lit("")))])
    cls = F.coalesce(known[F.col("annotation")], F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("annotation", F.lit("null")))))
    boxes = raw.select(stem.alias("recording_id"), F.col("Begin Time (s)").cast("double").alias("box_start"), F.col("End Time (s)").cast("double").alias("box_end"), cls.alias("class"))
    return boxes.withColumn("dropped", F.col("class") == "").withColumn("class", F.nullif("class", F.lit("")))


def last_answers(answers: DataFrame, key: str, order: str) -> DataFrame:
    """The last answer to each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return answers.withColumn("__place", place).filter("__place = 1").drop("__place")


def clip_use(sample_rate: Column, answer: Column, least_rate: int = 32_000) -> Column:
    """Why a background clip can't be used, or yes; the first reason counts."""
    return F.when(sample_rate < least_rate, "low_sample_rate").when(answer.isNull(), "not_reviewed").when(answer, "frog_present").otherwise("yes")


def new_rows(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an incremental run still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def range_features(spark: SparkSession, path: str, code: str) -> DataFrame:
    """code, polygons of a GeoJSON file of polygons and multipolygons; all features together are one range."""
    shapes = spark.read.schema("features array<struct<geometry: struct<type: string, coordinates: string>>>").json(path, multiLine=True)
    one = shapes.select(F.explode("features.geometry").alias("g"))
    several = F.from_json("g.coordinates", "array<array<array<array<double>>>>")
    polygon = F.array(F.from_json("g.coordinates", "array<array<array<double>>>"))
    parts = one.select(F.explode(F.when(F.col("g.type") == "MultiPolygon", several).otherwise(polygon)).alias("polygon"))
    return parts.groupBy(F.lit(code).alias("code")).agg(F.collect_list("polygon").alias("polygons"))


def path_parts(path: Column, layouts: list[tuple[str, list[str]]]) -> Column:
    """(site_id, date, recording_id) by the first layout that matches: a pattern and the fields of its groups, in
    order. Without a match: folder and stem as recording_id."""
    fields = ["site_id", "date", "recording_id"]
    stem = F.concat_ws("_", F.element_at(F.split(path, "/"), -2), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))
    out = F.struct(F.lit(None).cast("string").alias("site_id"), F.lit(None).cast("string").alias("date"), stem.alias("recording_id"))
    for pattern, names in reversed(layouts):
        value = lambda f, p=pattern, n=names: F.regexp_extract(path, p, n.index(f) + 1) if f in n else (stem if f == "recording_id" else F.lit(None).cast("string"))
        out = F.when(path.rlike(pattern), F.struct(*[value(f).alias(f) for f in fields])).otherwise(out)
    return out


def range_edges(features: DataFrame) -> DataFrame:
    """code, part, x1, y1, x2, y2 from (code, polygons array<array<array<array<double>>>>): polygons of rings of points."""
    rings = features.select("code", F.posexplode("polygons").alias("part", "rings")).select("code", "part", F.explode("rings").alias("ring"))
    pairs = F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    one = rings.select("code", "part", F.explode(pairs).alias("e"))
    return one.select("code", "part", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"), F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"))


def html_links(html: str) -> list[tuple[str, str]]:
    """(target, text) of each anchor, first of equal targets. A helper for Arrow functions."""
    from html.parser import HTMLParser

    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found, self.target, self.text = {}, None, ""

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.target, self.text = dict(attrs).get("href"), ""

        def handle_data(self, data):
            self.text += data

        def handle_endtag(self, tag):
            if tag == "a" and self.target:
                self.found.setdefault(self.target, " ".join(self.text.split()))
                self.target = None

    parser = Links()
    parser.feed(html or "")
    return list(parser.found.items())
