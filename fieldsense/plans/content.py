"""Queries: text, geography, vectors, whole pipelines, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldsense.functions import attributes as A
from fieldsense.functions import geo
from fieldsense.functions import text as T
from fieldsense.functions import vectors as V
from fieldsense.operators import captions, metrics, pipelines, splits
from fieldsense.operators.sizes import spread
from fieldsense.plans import evaluation
from fieldsense.plans.registry import query, read
from fieldsense.plans.stand_ins import REC, UNITS, recordings, units
from fieldsense.plans.windows import FOLD_SQL
from fieldsense.sources import pages as page_tables
from fieldsense.sources import readers
from fieldsense.streaming import events as E

PITCH = {"low": "(?i)low|edth", "high": "(?i)high|shth"}
STRUCTURE = {"trill": "(?i)ing", "note": "(?i)ea", "pulse": "(?i)nd"}
HALF, WHOLE = r"(?i)\bmuch\b|\bsome\b", r"(?i)\bthe\b"


def arrays(names) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in names.items()) + "], lambda x: x IS NOT NULL)"


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM documents")
def q_clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1~#~', 'g'), '~#~')) AS n,
  string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1~#~', 'g'), '~#~')[1] AS first FROM documents""")
def q_sentences(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), s[0].alias("first"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1~#~', 'g'), '~#~')) AS s FROM documents),
  f AS (SELECT s FROM (SELECT DISTINCT doc_id, s FROM s) GROUP BY s HAVING count(*) >= 4) SELECT doc_id, count(*) AS kept FROM s WHERE s NOT IN (SELECT s FROM f) GROUP BY doc_id""")
def q_boilerplate(spark, sf_dir):
    s = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    common = s.distinct().groupBy("s").agg(F.count("*").alias("pages")).filter("pages >= 4")
    return s.join(common, "s", "left_anti").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN p_size * 60.0e0 END AS duration_s FROM part")
def q_caption_parse(spark, sf_dir):
    n = F.col("p_size").cast("string")
    caption = F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit(" seconds"))).when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit("-minute clip"))).otherwise("no length")
    return read(spark, sf_dir, "part").select("p_partkey", T.caption_duration(caption).alias("duration_s"))


@query(f"SELECT doc_id, CASE WHEN len({arrays(PITCH)}) = 1 THEN {arrays(PITCH)}[1] END AS pitch FROM documents")
def q_attr_single(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.single_value(F.col("text"), PITCH).alias("pitch"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(regexp_replace(text, '{HALF}', ' ', 'g'), '{WHOLE}') THEN 'loud' WHEN regexp_matches(text, '{HALF}') THEN 'moderate' END AS loudness FROM documents")
def q_attr_loudness(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.loudness(F.col("text"), HALF, WHOLE).alias("loudness"))


@query(r"""SELECT event_id, CASE WHEN regexp_extract(v, '(\d+) to (\d+) s', 2) <> '' THEN CAST(regexp_extract(v, '(\d+) to (\d+) s', 1) AS DOUBLE) END AS lo,
  CASE WHEN regexp_extract(v, '(\d+) to (\d+) s', 2) <> '' THEN CAST(regexp_extract(v, '(\d+) to (\d+) s', 2) AS DOUBLE) WHEN regexp_extract(v, 'up to (\d+)', 1) <> '' THEN CAST(regexp_extract(v, 'up to (\d+)', 1) AS DOUBLE) END AS hi
  FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 7) || ' to ' || (event_id % 11 + 7) || ' s' WHEN 1 THEN 'up to ' || (event_id % 9) ELSE 'brief' END AS v FROM events)""")
def q_attr_duration(spark, sf_dir):
    i = F.col("event_id")
    v = F.when(i % 3 == 0, F.concat(i % 7, F.lit(" to "), i % 11 + 7, F.lit(" s"))).when(i % 3 == 1, F.concat(F.lit("up to "), i % 9)).otherwise("brief")
    return read(spark, sf_dir, "events").select("event_id", T.number_range(v, [r"(\d+) to (\d+) s", r"()up to (\d+)"]).alias("r")).select("event_id", "r.lo", "r.hi")


@query(f"SELECT doc_id, CASE WHEN len({arrays(STRUCTURE)}) > 0 THEN {arrays(STRUCTURE)} END AS structure FROM documents")
def q_attr_structure(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.found_values(F.col("text"), STRUCTURE).alias("structure"))


#: Texts dealt to parts, and the evidence that each holds.
SAID = ["A high-pitched trill lasting up to 2 seconds. It lasts less than 3 seconds.", "It is not very loud. A series of Croaks and croaks.", "This is a loud clip. Weak, under water; heard underwater.", "A moderately loud peep, 3 - 5 notes per second. Very loud at night.", "Nothing of note."]
EVIDENCE = [
    (0, 0, "pitch", "high-pitched", "A high-pitched trill lasting up to 2 seconds."), (0, 1, "duration_s", "lasting up to 2 seconds", "A high-pitched trill lasting up to 2 seconds."), (0, 2, "structure", "trill", "A high-pitched trill lasting up to 2 seconds."),
    (1, 0, "loudness", "not very loud", "It is not very loud."), (1, 1, "structure", "series of", "A series of Croaks and croaks."), (1, 2, "structure", "Croaks", "A series of Croaks and croaks."),
    (2, 0, "loudness", "Weak", "Weak, under water; heard underwater."), (2, 1, "underwater", "under water", "Weak, under water; heard underwater."),
    (3, 0, "loudness", "moderately loud", "A moderately loud peep, 3 - 5 notes per second."), (3, 1, "loudness", "Very loud", "Very loud at night."), (3, 2, "notes_per_s", "3 - 5 notes per second", "A moderately loud peep, 3 - 5 notes per second."), (3, 3, "structure", "peep", "A moderately loud peep, 3 - 5 notes per second."),
]  # fmt: skip


def _said(key: str):
    return F.element_at(F.array(*map(F.lit, SAID)), (F.col(key) % len(SAID) + 1).cast("int"))


@query("SELECT p_partkey, CAST(place AS INTEGER) AS place, field, match, sentence FROM part JOIN (VALUES " + ", ".join(map(str, EVIDENCE)) + ") e(k, place, field, match, sentence) ON p_partkey % 5 = k")
def q_evidence(spark, sf_dir):
    texts = spread(read(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", A.described(_said("p_partkey")).alias("s"))
    return A.evidence(texts, "p_partkey", "s")


@query("SELECT p_partkey, (p_size, p_type) IS NOT DISTINCT FROM (CASE WHEN p_partkey % 2 = 0 THEN p_size END, p_type) AS reviewed FROM part")
def q_review_staleness(spark, sf_dir):
    now, approved = F.struct("p_size", "p_type"), F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("p_size"), "p_type")
    return read(spark, sf_dir, "part").select("p_partkey", A.reviewed(now, approved).alias("reviewed"))


@query(f"""WITH {REC} SELECT recording_id, CASE recording_id % 3 WHEN 0 THEN 'herps:' || label || ':' || CASE WHEN n_chars % 2 = 0 THEN source ELSE 'unknown' END
  WHEN 1 THEN 'aru:' || label || ':b' || lpad(CAST(n_chars % 90 AS VARCHAR), 2, '0') ELSE 'inat:' || lower(trim(source)) END AS split_group FROM rec""")
def q_split_groups(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("herps"), F.lit("aru"), F.lit("inat")), (F.col("recording_id") % 3 + 1).cast("int"))
    county = F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise("unknown")
    return recordings(spark, sf_dir).select("recording_id", T.split_group(kind, F.col("label"), county, F.col("n_chars") % 90, F.col("source")).alias("split_group"))


#: Nations as species: genus by region, one in four with its nominate subspecies.
SPECIES = """sp AS (SELECT 'N' || n_nationkey AS code, ['Rana', 'Bufo', 'Hyla', 'Ascaphus', 'Spea'][n_regionkey + 1] AS genus, 'n' || n_nationkey AS epithet, n_nationkey FROM nation)"""


def _species(spark, sf_dir):
    genus = F.element_at(F.array(*map(F.lit, ("Rana", "Bufo", "Hyla", "Ascaphus", "Spea"))), (F.col("n_regionkey") + 1).cast("int"))
    epithet = F.concat(F.lit("n"), "n_nationkey")
    short = F.concat_ws(" ", genus, epithet)
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), genus.alias("genus"), F.when(F.col("n_nationkey") % 4 == 0, F.concat_ws(" ", short, epithet)).otherwise(short).alias("scientific"), "n_nationkey")


@query(f"""WITH {SPECIES}, names AS (SELECT lower(g || ' ' || epithet || CASE WHEN n_nationkey % 4 = 0 THEN ' ' || epithet ELSE '' END) AS name, code, 1 AS first FROM (SELECT *, unnest(CASE WHEN genus = 'Rana' THEN ['Rana', 'Lithobates'] ELSE [genus] END) AS g FROM sp)
    UNION ALL SELECT lower(g || ' ' || epithet), code, 2 FROM (SELECT *, unnest(CASE WHEN genus = 'Rana' THEN ['Rana', 'Lithobates'] ELSE [genus] END) AS g FROM sp) WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'bufo n1', 'TOADS', 0),
  best AS (SELECT name, first(code ORDER BY first, code) AS label, min(first) AS f FROM names GROUP BY 1),
  r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND genus = 'Rana' THEN 'Lithobates' ELSE genus END AS gen, CASE WHEN s_suppkey % 7 = 0 THEN 'sp' ELSE epithet END AS sp, CASE WHEN s_suppkey % 2 = 0 THEN epithet END AS ssp FROM supplier JOIN sp ON n_nationkey = s_nationkey)
  SELECT s_suppkey, coalesce(l.label, s.label) AS label, CASE coalesce(l.f, s.f) WHEN 0 THEN 'group' WHEN 1 THEN 'species' WHEN 2 THEN 'species' END AS rank FROM r LEFT JOIN best l ON l.name = lower(gen || ' ' || sp || ' ' || ssp) LEFT JOIN best s ON s.name = lower(gen || ' ' || sp)""")
def q_classify(spark, sf_dir):
    species = _species(spark, sf_dir)
    names = T.taxon_names(species.select("code", "scientific"), {"Rana": ["Lithobates"]}, {"bufo n1": "TOADS"})
    k = F.col("s_suppkey")
    gen = F.when((k % 3 == 0) & (F.col("genus") == "Rana"), "Lithobates").otherwise(F.col("genus"))
    epithet = F.concat(F.lit("n"), "n_nationkey")
    records = read(spark, sf_dir, "supplier").join(F.broadcast(species), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    records = records.select("s_suppkey", gen.alias("gen"), F.when(k % 7 == 0, "sp").otherwise(epithet).alias("sp"), F.when(k % 2 == 0, epithet).alias("ssp"))
    return T.classify(records, names).select("s_suppkey", "label", "rank")


@query(f"""WITH {SPECIES}, labels AS (SELECT n_nationkey AS place, upper(CASE WHEN n_nationkey % 2 = 0 AND genus = 'Rana' THEN 'Lithobates' ELSE genus END) || ' ' || epithet AS label FROM sp WHERE n_nationkey % 6 > 0),
  names AS (SELECT genus AS class, g || ' ' || epithet AS name FROM (SELECT *, unnest(CASE WHEN genus = 'Rana' THEN ['Rana', 'Lithobates'] ELSE [genus] END) AS g FROM sp) UNION ALL SELECT 'Hyla', 'Bufo n1' UNION ALL SELECT 'Bufo', 'nothing')
  SELECT class, list_sort(list_distinct(list(place))) AS places FROM labels JOIN names ON lower(label) = lower(name) GROUP BY 1""")
def q_label_index(spark, sf_dir):
    species = _species(spark, sf_dir)
    genus = F.when((F.col("n_nationkey") % 2 == 0) & (F.col("genus") == "Rana"), "Lithobates").otherwise(F.col("genus"))
    labels = species.filter("n_nationkey % 6 > 0").select(F.col("n_nationkey").alias("place"), F.concat_ws(" ", F.upper(genus), F.concat(F.lit("n"), "n_nationkey")).alias("label"))
    names = T.species_names(species.select(F.col("genus").alias("class"), "scientific"), {"Rana": "Lithobates"}, {"Hyla": ["Bufo n1"], "Bufo": ["nothing"]})
    return T.label_positions(labels, names)


@query(r"""WITH t AS (SELECT doc_id, text FROM documents), a AS (SELECT doc_id, regexp_matches(text, '(?i)\bthe[\s-]+ands?\b') AS both_, regexp_replace(text, '(?i)\bthe[\s-]+ands?\b', ' ', 'g') AS l1 FROM t), b AS (SELECT *, regexp_matches(l1, '(?i)\bthes?\b') AS the_, regexp_replace(l1, '(?i)\bthes?\b', ' ', 'g') AS l2 FROM a)
  SELECT doc_id, list_filter([CASE WHEN both_ THEN 'TA' END, CASE WHEN the_ THEN 'T' END, CASE WHEN regexp_matches(l2, '(?i)\bofs?\b') THEN 'O' END], lambda x: x IS NOT NULL) AS codes FROM b""")
def q_name_match(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.named_codes(F.col("text"), {"the": "T", "the and": "TA", "of": "O"}).alias("codes"))


#: Captions dealt to parts, the page's species is R; what each is taken for.
CAPTIONS = ["A red frog in rain. Blue frogs answer.", "This is a blue-frog call.", "Blue frogs and green frogs call. Red frogs too.", "Similar to a blue frog. Green frog!", "No name here."]
TAKEN = [(0, "R", "page", False, "['B']"), (1, "B", "caption", True, "[]"), (2, "R", "page", True, "['G', 'B']"), (3, "G", "caption", True, "[]"), (4, "R", "page", False, "[]")]
OVERRIDE = ("7.mp3", "X", ["R"])


@query(f"""SELECT p_partkey AS recording_id, CASE WHEN p_partkey = 7 THEN 'X' ELSE label END AS label, CASE WHEN p_partkey = 7 THEN 'override' ELSE label_source END AS label_source, CASE WHEN p_partkey = 7 THEN false ELSE needs_review END AS needs_review,
  CASE WHEN p_partkey = 7 THEN ['R'] ELSE secondary END AS secondary FROM part JOIN (SELECT k, label, label_source, needs_review, CAST(secondary AS VARCHAR[]) AS secondary FROM (VALUES {', '.join(f"({k}, '{a}', '{b}', {c}, {d}::VARCHAR[])" for k, a, b, c, d in TAKEN)}) t(k, label, label_source, needs_review, secondary)) t ON p_partkey % 5 = k""")
def q_assign_labels(spark, sf_dir):
    caption = F.element_at(F.array(*map(F.lit, CAPTIONS)), (F.col("p_partkey") % len(CAPTIONS) + 1).cast("int"))
    pages = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("recording_id"), F.lit("R").alias("code"), F.concat(F.lit("u/"), "p_partkey", F.lit(".mp3")).alias("url"), caption.alias("caption"))
    overrides = spark.createDataFrame([OVERRIDE], "file string, label string, secondary array<string>")
    return captions.assign_labels(pages, {"red frog": "R", "blue frog": "B", "green frog": "G"}, overrides).drop("url")


@query()
def q_html_links(spark, sf_dir):
    def run(batches):
        for pdf in batches:
            pdf["links"] = [[{"target": a, "text": b} for a, b in readers.html_links(h)] for h in pdf["html"]]
            yield pdf[["page_id", "links"]]

    return read(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, links array<struct<target:string,text:string>>")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages")
def q_html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.clean(F.regexp_replace("html", "<[^>]*>", " ")).alias("text"))


PAGE_TOKENS = r"""shown AS (SELECT page_id, url, regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>|[^<]+') AS t FROM pages),
  each AS (SELECT page_id, url, i - 1 AS pos, t[i] AS token FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM shown)),
  toks AS (SELECT *, CASE WHEN token LIKE '<%' THEN lower(regexp_extract(token, '^<(/?[a-zA-Z0-9]+)', 1)) END AS name,
    CASE WHEN token NOT LIKE '<%' THEN trim(regexp_replace(replace(replace(replace(replace(replace(replace(token, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) END AS text FROM each)"""


@query(rf"""WITH {PAGE_TOKENS}, placed AS (SELECT *, sum(CAST(coalesce(name = 'a', false) AS INTEGER)) OVER w AS anchor, sum(CASE WHEN name = 'a' THEN 1 WHEN name = '/a' THEN -1 ELSE 0 END) OVER w AS inside,
    last_value(CASE WHEN regexp_matches(text, '^[A-Z]') THEN text END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN regexp_matches(text, '[.]$') THEN text END IGNORE NULLS) OVER w AS context FROM toks WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  own AS (SELECT page_id, anchor, trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), '[ 	

]+', ' ', 'g')) AS caption FROM placed WHERE inside > 0 AND text <> '' GROUP BY 1, 2),
  links AS (SELECT *, trim(regexp_extract(token, '(?i)\shref\s*=\s*"([^"]*)"', 1)) AS target FROM placed WHERE name = 'a' AND regexp_matches(token, '(?i)\shref\s*=\s*"')),
  whole AS (SELECT *, CASE WHEN regexp_matches(target, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN target WHEN target LIKE '/%' THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || target
    ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/(?:[^?#]*/)?)', 1), ''), '/') || target END AS link FROM links)
  SELECT page_id, CAST(pos AS INTEGER) AS pos, link, coalesce(caption, '') AS caption, section, context FROM whole LEFT JOIN own USING (page_id, anchor) QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY pos) = 1""")
def q_page_links(spark, sf_dir):
    """Links of pages, resolved, first of equal ones, with their text and the last capitalised and last whole sentence before."""
    return page_tables.page_links(read(spark, sf_dir, "pages"), "page_id", "", {"section": "^[A-Z]", "context": r"[.]$"})


@query(rf"""WITH {PAGE_TOKENS} SELECT page_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), '[ 	

]+', ' ', 'g')) AS text FROM toks WHERE text <> '' GROUP BY 1""")
def q_page_text(spark, sf_dir):
    """The shown text of pages, without scripts, styles and comments, entities undone."""
    return page_tables.page_text(read(spark, sf_dir, "pages"), "page_id")


def _occurs_sql(pattern: str, of: str = "s") -> str:
    return f"len(list_filter({of}, lambda x: regexp_matches(x, '(?i){pattern}'))) > 0"


def _one_sql(values: dict[str, str], of: str = "s") -> str:
    hits = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in values.items()) + "], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({hits}) = 1 THEN {hits}[1] END"


# RE2 has no look-ahead: quiet waters are taken out before.
QUIET_SQL = A.QUIET.replace(r"(?! waters?\b)", "")
DRY = "list_transform(s, lambda x: regexp_replace(x, '(?i)quiet waters?', '~', 'g'))"
BARE = f"list_transform({DRY}, lambda x: regexp_replace(x, '(?i){A.MODERATE}|{QUIET_SQL}', ' ', 'g'))"
NOTES_SQL = f"list_filter(s, lambda x: regexp_matches(x, '(?i){A.NOTES_PER_SECOND}'))[1]"
STRUCTURES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_occurs_sql(p)} THEN '{k}' END" for k, p in A.STRUCTURE.items()) + "], lambda x: x IS NOT NULL)"


@query(rf"""WITH t AS (SELECT source, doc_id, text || ' ' || list_extract({SAID}, CAST(doc_id % 5 AS INTEGER) + 1) AS t FROM documents), p AS (SELECT source, unnest(list_transform(string_split(regexp_replace(t, '([.!?])[ \t\n\r\f\v]+', '\1~#~', 'g'), '~#~'), lambda x: trim(x))) AS x FROM t),
  g AS (SELECT source, list_distinct(list(x)) AS s FROM p WHERE x <> '' AND NOT starts_with(x, '{A.CAPTION_START}') AND NOT regexp_matches(x, '(?i){A.RELEASE}') GROUP BY 1)
  SELECT source, {_one_sql({k: _occurs_sql(v) for k, v in A.PITCH.items()})} AS pitch, {_one_sql({"moderate": _occurs_sql(A.MODERATE), "quiet": _occurs_sql(QUIET_SQL, DRY), "loud": _occurs_sql(A.LOUD, BARE)})} AS loudness,
  CASE WHEN len({STRUCTURES_SQL}) > 0 THEN {STRUCTURES_SQL} END AS structure, CASE WHEN {_occurs_sql(A.UNDERWATER)} THEN true END AS underwater,
  CASE WHEN {NOTES_SQL} IS NOT NULL THEN [CAST(regexp_extract({NOTES_SQL}, '(?i){A.NOTES_PER_SECOND}', 1) AS DOUBLE), CAST(regexp_extract({NOTES_SQL}, '(?i){A.NOTES_PER_SECOND}', 2) AS DOUBLE)] END AS notes_per_s FROM g""")
def q_attributes_e2e(spark, sf_dir):
    """Attributes of groups of documents, by what all their whole texts say."""
    texts = read(spark, sf_dir, "documents").select("source", "doc_id", F.concat_ws(" ", "text", _said("doc_id")).alias("text"))
    found = A.group_attributes(texts, "source", "doc_id", "text")
    return found.select("source", "pitch", "loudness", "structure", "underwater", "notes_per_s")


def _points(spark, sf_dir):
    return recordings(spark, sf_dir).select("recording_id", *(c.alias(n) for c, n in zip(geo.project(F.col("lat"), F.col("lon")), ("x", "y"), strict=True)), "lat", "lon")


@query(f"""WITH {REC}, a AS (SELECT recording_id, sin(radians(lat)) AS s, radians(lon - {geo.ORIGIN[1]}e0) AS l, {geo.constants()["e"]!r}e0 AS e, {geo.constants()["n"]!r}e0 AS n, {geo.constants()["c"]!r}e0 AS c, {geo.constants()["rho0"]!r}e0 AS rho0 FROM rec),
  b AS (SELECT *, {geo.SEMI_MAJOR}e0 * sqrt(c - n * (1 - e * e) * (s / (1 - (e * s) * (e * s)) - ln((1 - e * s) / (1 + e * s)) / (2 * e))) / n AS rho FROM a)
  SELECT recording_id, round(rho * sin(n * l), 2) AS x, round({geo.FALSE_NORTHING}e0 + rho0 - rho * cos(n * l), 2) AS y FROM b""")
def q_project(spark, sf_dir):
    return _points(spark, sf_dir).select("recording_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


SQUARES = [(c, [[[[a, b], [a + 2.0, b], [a + 2.0, b + 3.0], [a, b + 3.0], [a, b]]]]) for c, a, b in (("en", -123.0, 33.0), ("de", -121.0, 36.0), ("fr", -119.0, 39.0))]
EDGES = "edges(code, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{c}', {p[0]}e0, {p[1]}e0, {q[0]}e0, {q[1]}e0)" for c, polygons in SQUARES for p, q in zip(polygons[0][0], polygons[0][0][1:], strict=False)) + ")"
DISTANCE = f"""{REC}, {EDGES}, e AS (SELECT recording_id, label, code, lon AS x, lat AS y, x1, y1, x2, y2, greatest(0e0, least(1e0, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM rec, edges),
  dist AS (SELECT recording_id, label, code, CASE WHEN count(*) FILTER ((y1 > y) <> (y2 > y) AND x < x1 + (x2 - x1) * (y - y1) / nullif(y2 - y1, 0)) % 2 = 1 THEN 0e0
  ELSE min(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)) END AS distance FROM e GROUP BY 1, 2, 3)"""


def _distances(spark, sf_dir):
    edges = readers.range_edges(spark.createDataFrame(SQUARES, "code string, polygons array<array<array<array<double>>>>"))
    points = recordings(spark, sf_dir).select("recording_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return geo.distances(points, edges, "recording_id")


@query(f"WITH {DISTANCE} SELECT recording_id, code, round(distance, 6) AS distance FROM dist")
def q_range_distance(spark, sf_dir):
    return _distances(spark, sf_dir).withColumn("distance", F.round("distance", 6))


MEMBERS = [("en", "A"), ("de", "A"), ("fr", "B"), ("es", "C")]
MEMBERS_SQL = "members(code, class) AS (VALUES " + ", ".join(map(str, MEMBERS)) + ")"


def _members(spark):
    return spark.createDataFrame(MEMBERS, "code string, class string")


@query(f"""WITH {DISTANCE}, {MEMBERS_SQL}, w AS (SELECT recording_id, code, greatest(exp(-distance * 100 / 20), 0.02e0) AS weight FROM dist)
  SELECT r.recording_id, m.class, round(max(coalesce(weight, 1)), 6) AS weight FROM (SELECT DISTINCT recording_id FROM w) r CROSS JOIN members m LEFT JOIN w ON w.recording_id = r.recording_id AND w.code = m.code GROUP BY 1, 2""")
def q_range_prior(spark, sf_dir):
    weights = _distances(spark, sf_dir).select("recording_id", "code", geo.range_weight(F.col("distance") * 100).alias("weight"))
    return geo.class_weights(weights, _members(spark), "recording_id").withColumn("weight", F.round("weight", 6))


@query(f"WITH {UNITS}, p AS (SELECT unit_id, greatest(1e-7, least(1 - 1e-7, score_a)) AS p, CASE WHEN unit_id % 3 > 0 THEN 0.25e0 ELSE 1e0 END AS w FROM units) SELECT unit_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + ln(w)))), 9) AS p FROM p")
def q_logit_adjust(spark, sf_dir):
    return units(spark, sf_dir).select("unit_id", F.round(geo.adjust(F.col("score_a"), F.when(F.col("unit_id") % 3 > 0, 0.25)), 9).alias("p"))


@query(f"""WITH {DISTANCE}, {MEMBERS_SQL}, there AS (SELECT recording_id FROM dist WHERE code IN ('en', 'de') GROUP BY 1 HAVING min(distance) = 0), pts AS (SELECT r.recording_id, m.class FROM rec r JOIN there USING (recording_id) JOIN members m ON m.code = r.label),
  near AS (SELECT p.recording_id, p.class, min(distance) AS d FROM pts p JOIN members m USING (class) JOIN dist ON dist.code = m.code AND dist.recording_id = p.recording_id GROUP BY 1, 2)
  SELECT l.class, members, mapped, unmapped, coalesce(n, 0) AS n, inside, median_out, max_out FROM (SELECT class, string_agg(code, ' ' ORDER BY code) AS members, coalesce(string_agg(code, ' ' ORDER BY code) FILTER (code <> 'es'), '') AS mapped, coalesce(string_agg(code, ' ' ORDER BY code) FILTER (code = 'es'), '') AS unmapped FROM members GROUP BY 1) l
  LEFT JOIN (SELECT class, count(*) AS n FROM pts GROUP BY 1) USING (class) LEFT JOIN (SELECT class, round(avg(CAST(d = 0 AS INTEGER)), 9) AS inside, round(median(d) FILTER (d > 0), 6) AS median_out, round(max(d) FILTER (d > 0), 6) AS max_out FROM near GROUP BY 1) USING (class)""")
def q_range_check(spark, sf_dir):
    members = _members(spark)
    classes = recordings(spark, sf_dir).select("recording_id", F.col("label").alias("code")).join(members, "code").select("recording_id", "class")
    out = geo.range_check(_distances(spark, sf_dir), classes, members, ["en", "de"], "recording_id")
    return out.withColumns({"inside": F.round("inside", 9), "median_out": F.round("median_out", 6), "max_out": F.round("max_out", 6)})


@query("SELECT vec_id, list_max([embedding[label + 1], embedding[11], embedding[21]]) AS logit FROM embeddings")
def q_max_logit(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", V.max_at(F.col("embedding"), F.array("label", F.lit(10), F.lit(20))).alias("logit"))


@query("""WITH z AS (SELECT label % 3 AS class, embedding[1] AS s, label % 2 = 0 AS y FROM embeddings), b AS (SELECT class, s, count(*) FILTER (y) AS p, count(*) AS n FROM z GROUP BY 1, 2),
  c AS (SELECT class, p, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS m FROM b WINDOW w AS (PARTITION BY class ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
  SELECT class, round(sum(p * tp / m) / sum(p), 9) AS ap FROM c GROUP BY 1""")
def q_zero_shot(spark, sf_dir):
    z = read(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("class"), F.col("embedding")[0].alias("score"), (F.col("label") % 2 == 0).alias("y"))
    return metrics.average_precision(z, ["class"]).withColumn("ap", F.round("ap", 9))


@query("""WITH x AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM embeddings), s AS (SELECT i, avg(CAST(v AS DOUBLE)) AS m, stddev_pop(CAST(v AS DOUBLE)) AS sd FROM x WHERE vec_id % 5 > 0 GROUP BY i)
  SELECT vec_id, list(round((v - m) / (sd + 1e-6), 5) ORDER BY i) AS embedding FROM x JOIN s USING (i) GROUP BY vec_id""")
def q_standardize(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return V.standardize(e, "embedding", F.col("vec_id") % 5 > 0).select("vec_id", F.transform("embedding", lambda x: V.rounded(x, 5)).alias("embedding"))


CLASSES = ["de", "en", "es", "fr"]


@query(f"WITH {UNITS} SELECT unit_id, list_transform(['de', 'en', 'es', 'fr'], lambda c: CASE WHEN c = class THEN 1e0 ELSE 0e0 END) AS y, list_transform(['de', 'en', 'es', 'fr'], lambda c: CASE WHEN list_contains(masked, c) THEN 0e0 ELSE 1e0 END) AS m FROM units")
def q_targets(spark, sf_dir):
    return units(spark, sf_dir).select("unit_id", V.targets(F.col("class"), CLASSES).alias("y"), V.target_mask(F.col("masked"), CLASSES).alias("m"))


@query(f"WITH {UNITS}, u AS (SELECT * FROM units WHERE NOT list_contains(masked, class)) SELECT class, round(least(30, greatest(1, sqrt(count(*) FILTER (NOT y) / CAST(greatest(count(*) FILTER (y), 1) AS DOUBLE)))), 9) AS weight FROM u GROUP BY class")
def q_pos_weights(spark, sf_dir):
    """Weights of positives by class, over targets that aren't masked."""
    pos, neg = F.count_if("y").cast("double"), F.count_if(~F.col("y")).cast("double")
    open_ = units(spark, sf_dir).filter(~F.array_contains("masked", F.col("class")))
    return open_.groupBy("class").agg(F.round(V.pos_weight(pos, neg), 9).alias("weight"))


@query(f"""WITH {UNITS}, l AS (SELECT class, 4 * score_a - 2 AS z, CAST(y AS INTEGER) AS y, CASE WHEN list_contains(masked, class) THEN 0 ELSE 1 END AS m FROM units)
  SELECT class, round(sum(m * (3 * y * (greatest(-z, 0) + ln(1 + exp(-abs(z)))) + (1 - y) * (greatest(z, 0) + ln(1 + exp(-abs(z)))))) / greatest(sum(m), 1), 8) AS loss FROM l GROUP BY class""")
def q_masked_bce(spark, sf_dir):
    m = F.when(F.array_contains("masked", F.col("class")), 0.0).otherwise(1.0)
    loss = V.bce(F.col("score_a") * 4 - 2, F.col("y").cast("double"), F.lit(3.0))
    return units(spark, sf_dir).groupBy("class").agg(F.round(F.sum(loss * m) / F.greatest(F.sum(m), F.lit(1.0)), 8).alias("loss"))


@query(f"""WITH RECURSIVE {REC}, src AS (SELECT CAST(recording_id AS VARCHAR) AS recording_id, CASE WHEN recording_id % 5 = 0 THEN 'aru' WHEN recording_id % 2 = 0 THEN 'herps' ELSE 'inat' END AS kind, label, source AS recordist, n_chars % 90 AS block, date, CASE WHEN recording_id % 3 = 0 THEN lat END AS lat, -100.0e0 AS lon,
    recording_id % 4 = 0 AS napa, duration_s, md5(caption) AS md5 FROM rec WHERE n_chars % 17 > 0 AND duration_s >= 0.2e0),
  ranked AS (SELECT *, list_position(['herps', 'xc', 'inat', 'aru'], kind) AS rank FROM src), one AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY rank, recording_id) AS k FROM ranked),
  keyed AS (SELECT *, date || '|' || CAST(round_even(lat, 3) AS VARCHAR) || '|' || CAST(round_even(lon, 3) AS VARCHAR) || '|' || CAST(round_even(duration_s, 0) AS VARCHAR) AS post FROM one WHERE k = 1 OR md5 IS NULL),
  two AS (SELECT *, row_number() OVER (PARTITION BY post ORDER BY rank, recording_id) AS k2 FROM keyed),
  named AS (SELECT recording_id, kind, label, upper(label) AS acoustic_class, CASE WHEN kind = 'herps' THEN 'herps:' || label || ':' || CASE WHEN napa THEN 'Napa' ELSE 'unknown' END WHEN kind = 'aru' THEN 'aru:' || label || ':b' || lpad(CAST(block AS VARCHAR), 2, '0') ELSE 'inat:' || lower(trim(recordist)) END AS split_group
    FROM two WHERE k2 = 1 OR post IS NULL), dealt AS (SELECT * FROM named WHERE kind <> 'aru'), {FOLD_SQL}
  SELECT recording_id, label, acoustic_class, n.split_group, CASE WHEN kind = 'aru' THEN -1 ELSE fold END AS fold FROM named n LEFT JOIN folds f ON f.split_group = n.split_group""")
def q_manifest_e2e(spark, sf_dir):
    i = F.col("recording_id")
    kind = F.when(i % 5 == 0, "aru").when(i % 2 == 0, "herps").otherwise("inat")
    path = F.concat(F.lit("p/"), i)
    r = recordings(spark, sf_dir)
    src = r.select(i.cast("string").alias("recording_id"), kind.alias("source"), "label", path.alias("path"), F.col("source").alias("recordist"), (F.col("n_chars") % 90).cast("int").alias("block"), "date", F.when(i % 3 == 0, F.col("lat")).alias("lat"), F.lit(-100.0).alias("lon"), F.when(i % 4 == 0, "in Napa County").alias("caption"))
    probes = r.select(path.alias("path"), "duration_s", F.when(F.col("n_chars") % 17 == 0, "bad").alias("decode_error"), F.md5("caption").alias("md5"))
    classes = r.select("label").distinct().select("label", F.upper("label").alias("acoustic_class"))
    built = pipelines.build_manifest([src.filter(F.col("source") == s) for s in ("herps", "inat", "aru")], probes, classes)
    return built.select("recording_id", "label", "acoustic_class", "split_group", "fold")


MANIFEST = f"""{UNITS}, man AS (SELECT CAST(unit_id AS VARCHAR) AS unit_id, CASE WHEN domain = 'focal' THEN 'herps' ELSE 'aru' END AS source, class AS acoustic_class, class || ':b' || lpad(CAST(unit_id % 40 AS VARCHAR), 2, '0') AS split_group,
    CAST(CAST(DATE '2023-01-01' + CAST(unit_id % 40 * 20 AS INTEGER) AS DATE) AS VARCHAR) AS date, fold, domain FROM units),
  el AS (SELECT split_group, min(acoustic_class) AS cls, count(*) AS n FROM man WHERE domain = 'focal' GROUP BY 1 HAVING count(DISTINCT acoustic_class) = 1 AND bool_and(date >= '2024-01-01')),
  ranked AS (SELECT cls, split_group, n, total, row_number() OVER (PARTITION BY cls ORDER BY md5('0|' || split_group), split_group) AS place, ceil(count(*) OVER (PARTITION BY cls) / 2.0) AS half FROM el JOIN (SELECT acoustic_class AS cls, count(*) AS total FROM man WHERE domain = 'focal' GROUP BY 1 HAVING count(*) >= 30) USING (cls)),
  cand AS (SELECT * FROM ranked WHERE place <= half),
  walk AS (SELECT DISTINCT cls, CAST(0 AS BIGINT) AS place, 0e0 AS used, CAST(NULL AS VARCHAR) AS taken FROM cand UNION ALL
    SELECT c.cls, c.place, CASE WHEN used + n <= total * 0.15e0 THEN used + n ELSE used END, CASE WHEN used + n <= total * 0.15e0 THEN split_group END FROM walk w JOIN cand c ON c.cls = w.cls AND c.place = w.place + 1),
  focal AS (SELECT unit_id, 'frog' AS kind, source, acoustic_class, split_group, domain, fold, split_group IN (SELECT taken FROM walk WHERE taken IS NOT NULL) AS locked FROM man WHERE domain = 'focal'),
  rk AS (SELECT *, dense_rank() OVER (PARTITION BY acoustic_class ORDER BY split_group) AS rk FROM man WHERE domain = 'aru'), rn AS (SELECT *, max(rk) OVER (PARTITION BY acoustic_class) AS n FROM rk), lk AS (SELECT *, greatest(1, CAST(round_even(0.2e0 * n, 0) AS INTEGER)) AS nl FROM rn),
  aru AS (SELECT unit_id, 'frog' AS kind, source, acoustic_class, split_group, domain, CAST(CASE WHEN rk > n - nl THEN -1 ELSE ((rk - 1) * 5) // greatest(1, n - nl) END AS INTEGER) AS fold, rk > n - nl AS locked FROM lk),
  quiet AS (SELECT 'c' || c_custkey AS unit_id, 'background' AS kind, 'aru' AS source, CAST(NULL AS VARCHAR) AS acoustic_class, 'bg:c' || c_custkey AS split_group, 'aru' AS domain, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1|c' || c_custkey), 'c' || c_custkey) - 1) % 5 AS INTEGER) AS fold,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0|c' || c_custkey), 'c' || c_custkey) <= round_even(0.2e0 * count(*) OVER (PARTITION BY c_mktsegment), 0) AS locked FROM customer),
  splits AS (SELECT * FROM focal UNION ALL SELECT * FROM aru UNION ALL SELECT * FROM quiet)"""


def _manifest(spark, sf_dir):
    i = F.col("unit_id")
    return units(spark, sf_dir).select(
        i.cast("string").alias("recording_id"), F.when(F.col("domain") == "focal", "herps").otherwise("aru").alias("source"), F.col("class").alias("acoustic_class"), "medium", "masked",
        F.concat(F.col("class"), F.lit(":b"), F.lpad((i % 40).cast("string"), 2, "0")).alias("split_group"), F.date_add(F.lit("2023-01-01").cast("date"), (i % 40 * 20).cast("int")).cast("string").alias("date"), "fold",
    )  # fmt: skip


def _splits(spark, sf_dir):
    background = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("clip_id"), F.col("c_mktsegment").alias("category"))
    return splits.build_splits(_manifest(spark, sf_dir), background, ["herps"], "aru", "2024-01-01")


@query(f"WITH RECURSIVE {MANIFEST} SELECT * FROM splits")
def q_splits_e2e(spark, sf_dir):
    return _splits(spark, sf_dir)


def _windows(spark, sf_dir):
    i = F.col("recording_id").cast("long")
    two = F.explode(F.sequence(F.lit(0), (i % 2).cast("int"))).alias("window_idx")
    labels = _manifest(spark, sf_dir).select("recording_id", two, "acoustic_class", F.when(i % 3 > 0, "pos").otherwise("uncertain").alias("state"), "masked")
    background = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("clip_id"), F.lit(0).alias("window_idx"))
    return pipelines.load_windows(labels, background, _manifest(spark, sf_dir), _splits(spark, sf_dir))


@query(f"""WITH RECURSIVE {MANIFEST}, w AS (SELECT unit_id, unnest(range(CAST(CAST(unit_id AS BIGINT) % 2 + 1 AS INTEGER))) AS window_idx, 'frog' AS kind, source, acoustic_class, CASE WHEN CAST(unit_id AS BIGINT) % 3 > 0 THEN 'pos' ELSE 'uncertain' END AS state FROM man
    UNION ALL SELECT 'c' || c_custkey, 0, 'background', 'aru', NULL, 'neg' FROM customer WHERE c_custkey % 2 = 0)
  SELECT w.unit_id, CAST(window_idx AS INTEGER) AS window_idx, w.kind, w.source, w.acoustic_class, state, fold, locked FROM w JOIN splits USING (unit_id)""")
def q_load_data(spark, sf_dir):
    return _windows(spark, sf_dir).drop("masked")


@query(f"""WITH RECURSIVE {MANIFEST} SELECT s.unit_id, s.acoustic_class AS own, s.kind, s.fold, coalesce(u.medium, 'air') AS medium, s.source <> 'herps' OR coalesce(man.date >= '2023-09-01', false) AS leakage_safe FROM splits s LEFT JOIN man USING (unit_id) LEFT JOIN units u ON CAST(u.unit_id AS VARCHAR) = s.unit_id
  WHERE NOT s.locked AND (s.kind = 'frog' OR CAST(substr(s.unit_id, 2) AS BIGINT) % 2 = 0)""")
def q_dev_units(spark, sf_dir):
    dev = pipelines.dev_units(_windows(spark, sf_dir), _splits(spark, sf_dir), _manifest(spark, sf_dir), "2023-09-01", ("herps",))
    return dev.select("unit_id", "own", "kind", "fold", "medium", "leakage_safe")


REPORT = "(SELECT *, unnest(list_filter(['all', CASE WHEN leakage_safe THEN 'leakage_safe' END, CASE WHEN medium = 'air' THEN 'air' END], lambda x: x IS NOT NULL)) AS subset FROM j WHERE NOT masked_out)"


@query(f"""WITH {evaluation.JUDGED}, r AS {REPORT}, c AS (SELECT subset, class, count(*) AS n, CAST(count(*) FILTER (y) AS BIGINT) AS positives FROM r GROUP BY 1, 2)
  SELECT c.*, CASE WHEN positives BETWEEN 1 AND n - 1 THEN round(ap, 7) END AS ap FROM c JOIN {evaluation.ap_sql('r', 'subset, class', 'score')} USING (subset, class)""")
def q_report_tables(spark, sf_dir):
    return pipelines.baseline_report(evaluation._judged(spark, sf_dir)[0]).withColumn("ap", F.round("ap", 7))


@query(f"""WITH {REC}, w AS (SELECT recording_id, unnest(range(1 + n_chars % 3)) AS window_idx, label, n_chars, source FROM rec), s AS (SELECT *, CAST((recording_id * 7 + window_idx * 3) % 40 AS DOUBLE) AS activity_db, row_number() OVER (PARTITION BY label ORDER BY (recording_id * 7 + window_idx * 3) % 40 DESC, recording_id, window_idx) AS k FROM w)
  SELECT recording_id, window_idx, label AS acoustic_class, activity_db, 'audio/' || recording_id || '.wav' AS audio_path, upper(label) AS common_name, source FROM s WHERE k <= 20""")
def q_review_export(spark, sf_dir):
    r = recordings(spark, sf_dir)
    found = r.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") % 3)).alias("window_idx"), F.col("label").alias("acoustic_class"))
    found = found.withColumn("activity_db", ((F.col("recording_id") * 7 + F.col("window_idx") * 3) % 40).cast("double"))
    about = r.select("recording_id", F.concat(F.lit("audio/"), F.col("recording_id").cast("string"), F.lit(".wav")).alias("path"), F.upper("label").alias("common_name"), "source")
    return pipelines.review_table(found, about, 20)


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_daily(spark, sf_dir):
    counted = E.run_to_end(E.daily_counts(E.read_events(spark, sf_dir, stream=True)))
    return counted.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def q_stream_sessions(spark, sf_dir):
    found = E.run_to_end(E.sessions(E.read_events(spark, sf_dir, stream=True)))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")  # noqa: E731
    return found.select("user_id", text("start").alias("first_ts"), text("end").alias("last_ts"), "n")
