"""Queries: scans, projections, keys, joins, sets, dedupe, aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldsense.functions import text as T
from fieldsense.operators import catalog, dedupe, splits
from fieldsense.plans.registry import query, read
from fieldsense.plans.stand_ins import REC, UNITS, recordings, units
from fieldsense.sources import readers


@query("SELECT doc_id AS recording_id, source, CAST(NULL AS VARCHAR) AS recordist, 'none' AS license, n_chars / 100.0e0 AS duration_s FROM documents")
def q_conform(spark, sf_dir):
    schema = "recording_id long, source string, recordist string, license string, duration_s double"
    return catalog.conform(recordings(spark, sf_dir), spark.createDataFrame([], schema).schema, {"license": "none"})


@query(f"WITH {REC} SELECT recording_id, duration_s FROM rec WHERE NOT (duration_s IS NULL OR duration_s < 2.5e0)")
def q_validity(spark, sf_dir):
    return recordings(spark, sf_dir).filter(~(F.col("duration_s").isNull() | (F.col("duration_s") < 2.5))).select("recording_id", "duration_s")


@query(f"""WITH {REC} SELECT recording_id, CASE WHEN n_chars % 13 = 0 OR regexp_matches(coalesce(caption, ''), '(?i)underwater|under water|hydrophone')
  THEN 'underwater' ELSE 'air' END AS medium FROM rec""")
def q_medium(spark, sf_dir):
    types = F.when(F.col("n_chars") % 13 == 0, F.array(F.lit("underwater"))).otherwise(F.array(F.lit("call")))
    return recordings(spark, sf_dir).select("recording_id", T.medium(types, F.col("caption")).alias("medium"))


@query(f"""WITH {UNITS} SELECT CASE WHEN domain = 'focal' THEN 'A' ELSE 'B' END AS tier, count(*) AS n FROM units WHERE NOT locked GROUP BY 1""")
def q_tiers(spark, sf_dir):
    return units(spark, sf_dir).filter(~F.col("locked")).groupBy(F.when(F.col("domain") == "focal", "A").otherwise("B").alias("tier")).agg(F.count("*").alias("n"))


@query(f"""WITH {REC} SELECT recording_id, source NOT IN ('src1', 'src2') OR coalesce(TRY_CAST(date AS DATE) >= DATE '2021-01-01', false) AS leakage_safe FROM rec""")
def q_leakage_safe(spark, sf_dir):
    recent = F.coalesce(F.col("date").try_cast("date") >= F.lit("2021-01-01").cast("date"), F.lit(False))
    return recordings(spark, sf_dir).select("recording_id", (~F.col("source").isin("src1", "src2") | recent).alias("leakage_safe"))


@query(f"""WITH {UNITS} SELECT unit_id, ((domain = 'focal' AND y AND split_group IN ('src0', 'src3')) OR domain = 'aru') AND NOT locked AS train FROM units""")
def q_train_mask(spark, sf_dir):
    focal = (F.col("domain") == "focal") & F.col("y") & F.col("split_group").isin("src0", "src3")
    return units(spark, sf_dir).select("unit_id", ((focal | (F.col("domain") == "aru")) & ~F.col("locked")).alias("train"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def q_date_coerce(spark, sf_dir):
    raw = F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return read(spark, sf_dir, "events").select("event_id", F.date_format(raw.try_cast("date"), "yyyy-MM-dd").alias("day"))


@query("""SELECT p_partkey, list_filter(list_transform(string_split(p_name || ', ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS names FROM part""")
def q_split_list(spark, sf_dir):
    names = F.concat(F.col("p_name"), F.lit(", ,"), F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != "").alias("names"))


@query(f"""WITH {REC} SELECT recording_id, CASE WHEN source = 'src0' THEN NULL WHEN source = 'src1' THEN substr(source, 4)
  ELSE format('{{:.1f}}', round(lat, 1)) || ',' || format('{{:.1f}}', round(lon, 1)) END AS site_id FROM rec""")
def q_site_derivation(spark, sf_dir):
    token = F.element_at(F.split(F.concat(F.lit("site:"), F.substring("source", 4, 9)), ":"), -1)
    place = F.concat_ws(",", F.format_string("%.1f", F.bround("lat", 1)), F.format_string("%.1f", F.bround("lon", 1)))
    site = F.when(F.col("source") == "src1", token).otherwise(place)
    return recordings(spark, sf_dir).select("recording_id", F.when(F.col("source") != "src0", site).alias("site_id"))


@query(f"""WITH {UNITS} SELECT unit_id, CASE WHEN domain = 'aru' AND NOT y THEN 'negative' ELSE 'clip' END AS label_kind,
  CASE WHEN domain = 'aru' AND NOT y THEN NULL ELSE class END AS class, NOT y AS exhaustive FROM units""")
def q_reader_casewhen(spark, sf_dir):
    negative = (F.col("domain") == "aru") & ~F.col("y")
    return units(spark, sf_dir).select("unit_id", F.when(negative, "negative").otherwise("clip").alias("label_kind"), F.when(~negative, F.col("class")).alias("class"), (~F.col("y")).alias("exhaustive"))


@query(f"""WITH {REC} SELECT recording_id, CASE WHEN 24000 + (n_chars % 3) * 8000 < 32000 THEN 'low_sample_rate' WHEN toxic IS NULL THEN 'not_reviewed'
  WHEN toxic = 1 THEN 'frog_present' ELSE 'yes' END AS use FROM rec LEFT JOIN labels ON doc_id = recording_id""")
def q_use_cascade(spark, sf_dir):
    r = recordings(spark, sf_dir).join(read(spark, sf_dir, "labels"), F.col("doc_id") == F.col("recording_id"), "left")
    return r.select("recording_id", readers.clip_use(24_000 + F.col("n_chars") % 3 * 8000, F.col("toxic") == 1).alias("use"))


LAYOUTS = [(r"^https?://([a-z]+)\.example\.com/[a-z]+/([0-9]+)$", ["site_id", "recording_id"]), (r"^https?://([a-z]+)\.example\.[a-z]+/([a-z]+)/([0-9]+)", ["site_id", "date", "recording_id"])]


@query(rf"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*', '') AS url FROM pages), p AS (SELECT *, CASE WHEN regexp_matches(url, '{LAYOUTS[0][0]}') THEN 1 WHEN regexp_matches(url, '{LAYOUTS[1][0]}') THEN 2 ELSE 0 END AS k FROM u)
  SELECT page_id, CASE k WHEN 1 THEN regexp_extract(url, '{LAYOUTS[0][0]}', 1) WHEN 2 THEN regexp_extract(url, '{LAYOUTS[1][0]}', 1) END AS site_id, CASE WHEN k = 2 THEN regexp_extract(url, '{LAYOUTS[1][0]}', 2) END AS date,
  CASE k WHEN 1 THEN regexp_extract(url, '{LAYOUTS[0][0]}', 2) WHEN 2 THEN regexp_extract(url, '{LAYOUTS[1][0]}', 3) ELSE string_split(url, '/')[-2] || '_' || regexp_extract(url, '([^/]+?)(?:\.[^./]*)?$', 1) END AS recording_id FROM p""")
def q_path_layouts(spark, sf_dir):
    url = F.regexp_replace("url", "#.*", "")
    return read(spark, sf_dir, "pages").select("page_id", readers.path_parts(url, LAYOUTS).alias("p")).select("page_id", "p.site_id", "p.date", "p.recording_id")


@query(r"""SELECT page_id, 'https://sounds.example' || regexp_extract(url, '^(?:https?://[^/]*)?(/[^?#]*)?', 1) AS url FROM pages""")
def q_norm_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.path_only_url(F.col("url"), "https://sounds.example").alias("url"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'ds' || p_size END AS ds_id, CASE WHEN p_partkey % 3 > 0 THEN 'A' || lpad(CAST(p_partkey AS VARCHAR), 3, '0') || CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE '' END END AS map_id, p_partkey % 3 > 0 AS is_range FROM part""")
def q_id_extract(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 > 0, F.concat(F.lit("frog-range-cwhr-a"), F.lpad(k.cast("string"), 3, "0"), F.when(k % 2 == 0, "b").otherwise(""), F.lit("-ds"), F.col("p_size"))).otherwise("frog-predicted-habitat")
    return read(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in readers.package_ids(name).items()))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def q_content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query(f"""WITH {UNITS}, r AS (SELECT sha256(concat_ws(',', CAST(unit_id AS VARCHAR), class, CAST(fold AS VARCHAR))) AS row FROM units),
  lots AS (SELECT substr(row, 1, 3) AS lot, sha256(string_agg(row, ',' ORDER BY row)) AS digest FROM r GROUP BY 1) SELECT substr(sha256(string_agg(digest, ',' ORDER BY lot)), 1, 16) AS digest FROM lots""")
def q_table_digest(spark, sf_dir):
    return splits.table_digest(units(spark, sf_dir), "unit_id", ["unit_id", "class", "fold"])


@query("""SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def q_lookup_join(spark, sf_dir):
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    o = read(spark, sf_dir, "orders").join(customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return o.join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE 'spa' END AS class FROM documents""")
def q_map_join_with_error(spark, sf_dir):
    names = spark.createDataFrame([("en", "eng"), ("de", "deu"), ("fr", "fra"), ("es", "spa")], "lang string, class string")
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("lang", F.lit("null")))).cast("string")
    return read(spark, sf_dir, "documents").join(F.broadcast(names), "lang", "left").select("doc_id", F.coalesce("class", unknown).alias("class"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_integrity_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def q_incremental_anti(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return readers.new_rows(read(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query(f"""WITH {UNITS}, u AS (SELECT *, class || ':' || split_group AS lot FROM units), g AS (SELECT lot, bool_and(leakage_safe OR y) AS safe, count(DISTINCT class) = 1 AS single, count(*) AS n FROM u GROUP BY 1)
  SELECT unit_id, lot FROM u SEMI JOIN (SELECT lot FROM g WHERE n > 2 AND safe AND single) s USING (lot)""")
def q_group_lock(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("lot", F.concat_ws(":", "class", "split_group"))
    groups = u.groupBy("lot").agg(F.bool_and(F.col("leakage_safe") | F.col("y")).alias("safe"), (F.count_distinct("class") == 1).alias("single"), F.count("*").alias("n"))
    return u.join(groups.filter("n > 2 and safe and single"), "lot", "left_semi").select("unit_id", "lot")


@query("""SELECT e.event_id, max_by(p.event_id, (p.ts, p.event_id)) AS previous FROM events e LEFT JOIN events p
  ON p.user_id = e.user_id AND p.event_type = 'click' AND (p.ts, p.event_id) < (e.ts, e.event_id) GROUP BY 1""")
def q_asof_extra(spark, sf_dir):
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    return read(spark, sf_dir, "events").select("event_id", F.last(click, ignorenulls=True).over(before).alias("previous"))


@query("""SELECT 'customer' AS source, c_custkey AS id, c_name AS name, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, CAST(NULL AS VARCHAR), s_acctbal FROM supplier""")
def q_union_sources(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), "s_acctbal")
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT conv_id, array_to_string(list(role ORDER BY first), ',') AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY 1""")
def q_ordered_distinct(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(turns["role"]), ",").alias("roles"))


@query("""SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents GROUP BY md5(text)""")
def q_dedupe_exact(spark, sf_dir):
    return dedupe.keep_first(read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5")), ["md5"], "doc_id")


@query(f"""WITH {REC}, k AS (SELECT recording_id, CASE WHEN recording_id % 5 > 0 THEN date || '|' || CAST(round_even(lat, 3) AS VARCHAR) || '|' || CAST(round_even(-100.0e0, 3) AS VARCHAR) || '|' || CAST(round_even(duration_s, 0) AS VARCHAR) END AS key FROM rec),
  n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY recording_id) AS n FROM k) SELECT recording_id, key FROM n WHERE n = 1 OR key IS NULL""")
def q_dedupe_crosspost(spark, sf_dir):
    lat = F.when(F.col("recording_id") % 5 > 0, F.col("lat"))
    key = dedupe.crosspost_key(F.col("date"), lat, F.lit(-100.0), F.col("duration_s"))
    return dedupe.keep_first(recordings(spark, sf_dir).select("recording_id", key.alias("key")), ["key"], "recording_id")


@query("""WITH d AS (SELECT doc_id, md5(text) AS md5, source FROM documents), k AS (SELECT md5, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, list_sort(list_distinct(list(source))) AS every FROM d GROUP BY md5)
  SELECT doc_id, source, list_filter(every, lambda x: x <> source) AS secondary FROM k""")
def q_dedupe_merge(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), "source", F.array().cast("array<string>").alias("secondary"))
    return dedupe.merge_labels(d, "md5", "source", "secondary", "doc_id").select("doc_id", "source", "secondary")


@query("""SELECT user_id || '-' || event_type AS clip, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def q_last_wins(spark, sf_dir):
    answers = read(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("clip"), "event_id", "value")
    return readers.last_answers(answers, "clip", "event_id")


@query("""SELECT event_id, i AS place, 'audio/' || 'm4a' AS kind, CAST(event_id % 90 AS DOUBLE) AS lat, CAST(event_id % 180 AS DOUBLE) AS lon, 's' || event_id || '-' || i AS url FROM (SELECT event_id, unnest(range(event_id % 3)) AS i FROM events) WHERE (event_id + i) % 4 > 0""")
def q_json_flatten(spark, sf_dir):
    i = F.col("event_id")
    sound = lambda k: F.struct(F.concat(F.lit("s"), i, F.lit("-"), k).alias("file_url"), F.lit("audio/mp4").alias("file_content_type"), F.when((i + k) % 4 > 0, "cc-by").alias("license_code"))
    sounds = F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda k: k < i % 3), sound)
    records = read(spark, sf_dir, "events").select("event_id", F.concat_ws(",", i % 90, i % 180).alias("location"), F.to_json(sounds).alias("sounds"))
    flat = readers.flatten_sounds(records, "event_id")
    return flat.select("event_id", F.col("place").cast("long").alias("place"), F.concat(F.lit("audio/"), "extension").alias("kind"), "lat", "lon", "url")


@query("""SELECT doc_id, count(DISTINCT source) OVER (PARTITION BY md5(text)) > 1 AS conflict FROM documents""")
def q_conflict_flag(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), "source")
    return dedupe.conflicting(d, "md5", "source").select("doc_id", "conflict")


INVENTORY = f"""WITH {REC}, r AS (SELECT recording_id, n_chars, label, CASE n_chars % 4 WHEN 0 THEN 'weak' WHEN 1 THEN 'clip' WHEN 2 THEN 'box' ELSE 'negative' END AS label_kind, n_chars % 3 = 0 AS exhaustive,
  source AS dataset, duration_s, CASE WHEN recording_id % 9 > 0 THEN CAST(recording_id % 25 AS VARCHAR) END AS site_id, date FROM rec),
  w AS (SELECT recording_id, CASE WHEN label_kind <> 'negative' AND (NOT exhaustive OR n_chars % 5 > 0) THEN label END AS class, unnest(range(1 + n_chars % 3)) AS i FROM r),
  k AS (SELECT recording_id, coalesce(class, 'negative') AS class, CASE WHEN class IS NULL THEN 'negative' ELSE label_kind END AS label_kind FROM w JOIN r USING (recording_id)),
  p AS (SELECT DISTINCT * FROM k WHERE class <> 'negative' UNION ALL SELECT recording_id, 'negative', 'negative' FROM r WHERE (exhaustive OR label_kind = 'negative') AND recording_id NOT IN (SELECT recording_id FROM k WHERE class <> 'negative')),
  inv AS (SELECT p.class, p.label_kind, count(*) AS recordings, sum(duration_s) / 3600 AS hours, array_to_string(list_sort(list_distinct(list(dataset))), ', ') AS sources,
  count(DISTINCT site_id) AS sites, count(DISTINCT date) AS days, count(DISTINCT site_id || '|' || date) AS site_days, CAST(count(*) FILTER (site_id IS NULL) AS BIGINT) AS no_site FROM p JOIN r USING (recording_id) GROUP BY 1, 2),
  full_inv AS (SELECT inv.*, coalesce(windows, 0) AS windows FROM inv LEFT JOIN (SELECT class, label_kind, count(*) AS windows FROM k GROUP BY 1, 2) USING (class, label_kind))"""


def _inventory(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, catalog.LABEL_KINDS)), (F.col("n_chars") % 4 + 1).cast("int"))
    site = F.when(F.col("recording_id") % 9 > 0, (F.col("recording_id") % 25).cast("string"))
    r = recordings(spark, sf_dir).withColumn("label_kind", kind).withColumn("site_id", site).withColumnRenamed("source", "dataset").withColumn("exhaustive", F.col("n_chars") % 3 == 0)
    heard = (F.col("label_kind") != "negative") & (~F.col("exhaustive") | (F.col("n_chars") % 5 > 0))
    w = r.select("recording_id", F.when(heard, F.col("label")).alias("class"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") % 3)))
    return catalog.inventory(r, w.select("recording_id", "class"))


@query(INVENTORY + " SELECT * REPLACE (round(hours, 7) AS hours) FROM full_inv")
def q_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir).withColumn("hours", F.round("hours", 7))


CELLS = ", ".join(f"CAST(coalesce(sum({c}) FILTER (label_kind = '{k}'), 0) AS BIGINT) AS {k}_{n}" for k in catalog.LABEL_KINDS for c, n in (("recordings", "rec"), ("windows", "win")))


@query(INVENTORY + f""" SELECT class, {CELLS}, round(sum(hours), 2) AS hours, CAST(sum(sites) AS BIGINT) AS sites, CAST(sum(days) AS BIGINT) AS days, CAST(sum(site_days) AS BIGINT) AS site_days,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(sources, ', '))))), ', ') AS sources FROM full_inv GROUP BY class""")
def q_summary_pivot(spark, sf_dir):
    return catalog.summary(_inventory(spark, sf_dir))


@query(f"""WITH {UNITS} SELECT class, CAST(count(*) FILTER (domain = 'focal' AND NOT locked) AS BIGINT) AS focal_dev, CAST(count(*) FILTER (domain = 'focal' AND locked) AS BIGINT) AS focal_locked,
  CAST(count(*) FILTER (domain = 'aru' AND NOT locked) AS BIGINT) AS aru_dev, CAST(count(*) FILTER (domain = 'aru' AND locked) AS BIGINT) AS aru_locked FROM units GROUP BY class""")
def q_split_crosstab(spark, sf_dir):
    cell = F.concat_ws("_", "domain", F.when(F.col("locked"), "locked").otherwise("dev"))
    return units(spark, sf_dir).withColumn("cell", cell).groupBy("class").pivot("cell", ["focal_dev", "focal_locked", "aru_dev", "aru_locked"]).count().na.fill(0)


@query(f"WITH {UNITS} SELECT class, round(avg(CAST(y AS INTEGER)), 9) AS pos_share FROM units GROUP BY class")
def q_pos_share(spark, sf_dir):
    return units(spark, sf_dir).groupBy("class").agg(F.round(F.avg(F.col("y").cast("double")), 9).alias("pos_share"))


@query("""SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 4) AS ci_lo, round(quantile_cont(o_totalprice, 0.975), 4) AS ci_hi FROM orders GROUP BY 1""")
def q_quantile_ci(spark, sf_dir):
    from fieldsense.operators.metrics import quantiles

    found = quantiles(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [0.025, 0.975])
    return found.select("o_orderpriority", F.round("q0", 4).alias("ci_lo"), F.round("q1", 4).alias("ci_hi"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def q_rollup_extra(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS quarter, lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS cheaper FROM orders""")
def q_rank_extra(spark, sf_dir):
    w = Window.partitionBy("o_orderstatus").orderBy("o_totalprice", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.lag("o_orderkey").over(w).alias("cheaper"))


@query("SELECT * FROM (VALUES ('a', 'ok'), ('b', 'card b: label_kind is guess, not one of weak, clip, box, negative'), ('c', 'card c lacks license')) t(name, verdict)")
def q_card_validation(spark, sf_dir):
    good = {"name": "a", "kind": "aru", "raw_dir": "x", "reader": "clips", "label_kind": "clip", "license": "open"}
    rows = []
    for card in (good, good | {"name": "b", "label_kind": "guess"}, {k: v for k, v in (good | {"name": "c"}).items() if k != "license"}):
        try:
            readers.check_card(card)
            rows.append((card["name"], "ok"))
        except ValueError as e:
            rows.append((card["name"], str(e)))
    return spark.createDataFrame(rows, "name string, verdict string")


@query("""WITH e AS (SELECT vec_id, 8000 + 1000 * (vec_id % 3) AS rate, vec_id % 10 AS kind, embedding FROM embeddings WHERE embedding IS NOT NULL)
  SELECT vec_id, CASE WHEN kind > 1 THEN CAST(rate AS INTEGER) END AS rate, CASE WHEN kind > 1 THEN round(len(embedding) / CAST(rate AS DOUBLE), 9) END AS duration_s, CASE kind WHEN 0 THEN 'data end early' WHEN 1 THEN 'not a RIFF WAVE file' END AS decode_error,
    CASE WHEN kind > 1 THEN list_sum(list_transform(embedding[5:20], lambda x: CAST(round_even(CAST(x AS DOUBLE) * 10000, 0) AS BIGINT))) END AS total FROM e""")
def q_sound_probe(spark, sf_dir):
    """Vectors written as 16-bit WAVE files, some cut short or with another head: probed, and 16 samples of a window added up."""
    import struct

    import numpy as np
    import pyarrow as pa

    from fieldsense.sources import sound

    def written(batches):
        for batch in batches:
            out = []
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.rint(np.asarray(vector.values, np.float64) * 10_000).astype("<i2").tobytes()
                rate = 8000 + 1000 * (key % 3)
                content = b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data
                out.append(content[:-2] if key % 10 == 0 else b"X" + content if key % 10 == 1 else content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "content"])

    e = read(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", "embedding")
    files = e.mapInArrow(written, "vec_id long, content binary")
    probed = sound.probe(files, "vec_id").select("vec_id", "rate", F.round("duration_s", 9).alias("duration_s"), "decode_error")
    # From the fifth sample on, sixteen at 8 kHz and as many at other rates.
    rate = 8000 + 1000 * (F.col("vec_id") % 3)
    windows = sound.cut(files.withColumn("starts", F.array(4 / rate)), 0.002, "vec_id")
    total = F.round(F.aggregate(F.slice("samples", 1, 16), F.lit(0.0), lambda a, x: a + x * 32768)).cast("long")
    return probed.join(windows.select("vec_id", total.alias("total")), "vec_id", "left")
