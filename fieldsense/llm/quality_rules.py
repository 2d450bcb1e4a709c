"""Quality rules with thresholds that follow the data: quantile sketches by language and source in place of fixed cutoffs.

Every text is measured once. The measures of documents that pass the base rule go into sketches: counts of integer
buckets, exact below 128 and 64 to a doubling above, so a bucket is at most a 64th wide. Sketches merge by adding counts,
in any order and with the same result; (language, source) sketches are added up to those of a language and of all
documents. A fence lies `reach` interquartile ranges and a margin outside of the middle half; a group of fewer than
`least` documents takes the fence of its language, a language of fewer that of all. A document outside of a fence of its
group goes. The margins keep groups without any spread from losing every document that differs at all.

Measures, in integers: symbols, repeated lines, repeated words and words equal to the one before, for 1,000 words or lines
(upper fences), and the mean length of words in thousandths (both fences).

Defined cases: null and empty texts have no words and fail the base rule; null languages and sources are groups of their
own; rows that repeat an id are judged each; an empty table gives an empty result; texts of any length are read whole;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import in_slices, materialize, releasing

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters"]
#: At most this many groups, a few numbers each, are broadcast; beyond it the join is by shuffle.
BROADCAST_GROUPS = 200_000
#: Buckets to a doubling, as a power of two.
GRAIN = 6


@dataclass(frozen=True)
class Rule:
    """1000 * part / whole must lie inside the fence; margin: added outside of it; low: whether there is a lower one."""

    name: str
    part: str
    whole: str
    margin: int
    low: bool = False


RULES = (
    Rule("symbols", "n_symbols", "n_words", 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 500),
    Rule("repeated_words", "n_repeat_words", "n_words", 150),
    Rule("stutters", "n_stutters", "n_words", 100),
    Rule("word_length", "word_chars", "n_words", 1000, low=True),
)


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window seen twice or more. Windows are compared exactly: the numbers of their words are packed
    into one integer, and made dense whenever another word wouldn't fit."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    base, keys, most = len(numbers), ids[:n], len(numbers)
    for j in range(1, window):
        if most * base >= 1 << 62:
            values, keys = np.unique(keys, return_inverse=True)
            most = len(values)
        keys = keys * base + ids[j : j + n]
        most *= base
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    # +1 where a repeated window begins, -1 behind its end: words inside of any have a positive sum.
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:n] += again
    steps[window : window + n] -= again
    return int((np.cumsum(steps)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    # A code point begins at each byte that doesn't continue one.
    inside = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((inside & 0xC0) != 0x80).sum())
    return len(words), chars, sum(raw.count(s) for s in SYMBOLS), len(lines), len(lines) - len(set(lines)), repeat_words(words), sum(map(eq, words[1:], words))


def measure(docs: DataFrame, carried: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The carried columns and COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t) for t in in_slices(batch.column(0))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[*carried, *COUNTS])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select("text", *carried).mapInArrow(releasing(run), f"{kept}, " + ", ".join(f"{c} long" for c in COUNTS))


def fails_base(least_words: int = 10, percent: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > percent * F.col("n_words"))


def value(rule: Rule) -> Column:
    return F.when(F.col(rule.whole) > 0, F.floor(1000 * F.col(rule.part) / F.col(rule.whole))).otherwise(0).cast("long")


def bucket(v: Column) -> Column:
    """Values below 2^(GRAIN+1) are buckets of their own; above, the first GRAIN + 1 bits and their place name one."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - (GRAIN + 1))
    return F.call_function("shiftright", v, shift) + F.call_function("shiftleft", shift.cast("long"), F.lit(GRAIN))


def bounds(b: Column) -> tuple[Column, Column]:
    """Least and greatest value of a bucket."""
    shift = F.greatest(F.lit(0), F.call_function("shiftright", b, F.lit(GRAIN)) - 1).cast("int")
    low = F.call_function("shiftleft", b - F.call_function("shiftleft", shift.cast("long"), F.lit(GRAIN)), shift)
    return low, low + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1


def sketches(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(lang, source, rule, bucket, n) over the rows; as many rows as there are buckets, however many documents."""
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), bucket(value(r)).alias("bucket")) for r in rules)))
    return rows.select("lang", "source", each.alias("e")).groupBy("lang", "source", "e.rule", "e.bucket").agg(F.count("*").alias("n"))


def merged(found: DataFrame) -> DataFrame:
    """The sketches of (lang, source), of languages and of all: (level, lang, source, rule, bucket, n), levels 0, 1, 2."""
    own = found.select(F.lit(0).alias("level"), "lang", "source", "rule", "bucket", "n")
    null = F.lit(None).cast("string")
    by_lang = found.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n")).select(F.lit(1).alias("level"), "lang", null.alias("source"), "rule", "bucket", "n")
    everything = found.groupBy("rule", "bucket").agg(F.sum("n").alias("n")).select(F.lit(2).alias("level"), null.alias("lang"), null.alias("source"), "rule", "bucket", "n")
    return own.union(by_lang).union(everything)


def fences(found: DataFrame, rules: tuple[Rule, ...] = RULES, reach: int = 3, least: int = 100) -> DataFrame:
    """(lang, source, low_<rule>, high_<rule>) for every group that has a sketch or shares a language with one."""
    key = ["level", "lang", "source", "rule"]
    along = Window.partitionBy(*key).orderBy("bucket")
    all_of = Window.partitionBy(*key)
    ranked = merged(found).withColumn("upto", F.sum("n").over(along)).withColumn("total", F.sum("n").over(all_of))
    at = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    quartiles = ranked.groupBy(*key).agg(F.max("total").alias("total"), at(25).alias("q1"), at(75).alias("q3"))
    low, high = bounds(F.col("q1"))[0], bounds(F.col("q3"))[1]
    margin = F.element_at(F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.margin))), F.col("rule"))
    spread = reach * (high - low) + margin
    fenced = quartiles.select(*key, "total", (low - spread).alias("low"), (high + spread).alias("high"))
    per_rule = [F.max(F.when(F.col("rule") == r.name, F.col(side))).alias(f"{side}_{r.name}") for r in rules for side in ("low", "high")]
    wide = materialize(fenced.groupBy(*key[:3]).agg(F.max("total").alias("total"), *per_rule), "fences")
    numbers = [c for c in wide.columns if c not in key]
    level = lambda k, keys: wide.filter(F.col("level") == k).select(*(F.col(c).alias(f"{c}_{k}") for c in keys), F.struct(*numbers).alias(f"f{k}"))
    groups = wide.filter("level = 0").select("lang", "source", F.struct(*numbers).alias("f0"))
    joined = groups.join(level(1, ["lang"]), F.col("lang").eqNullSafe(F.col("lang_1")))
    # One row, of as many numbers as there are fences.
    overall = wide.filter("level = 2").first()
    f2 = F.struct(*(F.lit(overall[c] if overall else None).cast("long").alias(c) for c in numbers))
    chosen = F.when(F.col("f0.total") >= least, F.col("f0")).when(F.col("f1.total") >= least, F.col("f1")).otherwise(f2)
    return joined.select("lang", "source", chosen.alias("f")).select("lang", "source", *(F.col(f"f.{c}").alias(c) for c in numbers if c != "total"))


def judge(measured: DataFrame, base: Column | None = None, rules: tuple[Rule, ...] = RULES, reach: int = 3, least: int = 100) -> DataFrame:
    """measured + base_failed, kept and `broken`, the first rule that a document breaks. All rules hold where a group has
    no fence, which is so if none of its documents pass the base rule."""
    rows = measured.withColumn("base_failed", fails_base() if base is None else base)
    limits = fences(sketches(rows.filter(~F.col("base_failed")), rules), rules, reach, least)
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_GROUPS else limits
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    joined = rows.join(limits, same, "left")
    out = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        over = value(r) > F.col(f"high_{r.name}")
        out = out.when(over | (value(r) < F.col(f"low_{r.name}")) if r.low else over, F.lit(r.name))
    return joined.withColumn("broken", out).withColumn("kept", F.col("broken").isNull()).select(*rows.columns, "kept", "broken")


def quality(docs: DataFrame) -> DataFrame:
    """The docs' (doc_id, text, lang, source) rows measured, written and judged."""
    return judge(materialize(measure(docs), "quality-counts"))


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality(docs).select("doc_id", *(c for c in COUNTS if c != "n_lines"), "base_failed", "kept", "broken")


_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, base_failed, {k} AS k, '{r.name}' AS rule, {r.margin} AS margin, {str(r.low).lower()} AS two_sided, CASE WHEN {r.whole} > 0 THEN 1000 * {r.part} // {r.whole} ELSE 0 END AS v FROM judged"
    for k, r in enumerate(RULES)
)
SQL = rf"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS five
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
inside AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(5) t(j) GROUP BY doc_id),
split AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
counted AS (
  SELECT w.doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutters
  FROM words w JOIN split USING (doc_id) LEFT JOIN inside USING (doc_id)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
measures AS ({_VALUES}),
buckets AS (
  SELECT lang, source, rule, margin, greatest(0, length(bin(v)) - 7) AS s, (v >> s) + (s << 6) AS b, count(*) AS n FROM measures WHERE NOT base_failed GROUP BY ALL),
levels AS (
  SELECT 0 AS level, lang, source, rule, margin, b, sum(n) AS n FROM buckets GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rule, margin, b, sum(n) FROM buckets GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rule, margin, b, sum(n) FROM buckets GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY b) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM levels),
quartiles AS (
  SELECT level, lang, source, rule, margin, total, min(b) FILTER (100 * upto >= 25 * total) AS b1, min(b) FILTER (100 * upto >= 75 * total) AS b3
  FROM ranked GROUP BY ALL),
edges AS (
  SELECT *, greatest(0, (b1 >> 6) - 1) AS s1, greatest(0, (b3 >> 6) - 1) AS s3, (b1 - (s1 << 6)) << s1 AS q1, ((b3 - (s3 << 6)) << s3) + (1 << s3) - 1 AS q3 FROM quartiles),
fences AS (SELECT level, lang, source, rule, total, q1 - 3 * (q3 - q1) - margin AS low, q3 + 3 * (q3 - q1) + margin AS high FROM edges),
tested AS (
  SELECT m.doc_id, m.k, m.rule, m.v > f.high OR (m.two_sided AND m.v < f.low) AS breaks
  FROM measures m
  JOIN fences g ON g.level = 0 AND g.lang IS NOT DISTINCT FROM m.lang AND g.source IS NOT DISTINCT FROM m.source AND g.rule = m.rule
  JOIN fences l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM m.lang AND l.rule = m.rule
  JOIN fences f ON f.rule = m.rule AND f.level = CASE WHEN g.total >= 100 THEN 0 WHEN l.total >= 100 THEN 1 ELSE 2 END
    AND (f.level = 2 OR f.lang IS NOT DISTINCT FROM m.lang) AND (f.level > 0 OR f.source IS NOT DISTINCT FROM m.source)),
firsts AS (SELECT doc_id, arg_min(rule, k) AS rule FROM tested WHERE breaks GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutters, base_failed, NOT base_failed AND rule IS NULL AS kept,
  CASE WHEN base_failed THEN 'base' ELSE rule END AS broken
FROM judged LEFT JOIN firsts USING (doc_id)
"""
