"""Line dedup by a segment-partition edit join, with DataFrame operations only.

A line goes when an earlier line (by doc_id, then line number) is equal to it or within a few edits. Equal lines are
collapsed first. The rest are joined by segments: of two lines within t edits, the shorter one cut into t + 1 even
segments has a segment that occurs unchanged in the longer one, at one of few places that its length allows. Lines put
their own segments into an index and probe it with those substrings, for each length that a partner can have;
candidates are verified by a banded bit-parallel edit distance.

Edits allowed: one for every `per_edit` characters of the shorter line, `edits` at most. Lines of fewer than `least`
characters take no part and stay.

Defined cases: null text has no lines; a null doc_id takes no part, its lines stay; rows that repeat an id count as one
document whose lines at one place, if equal, are one line; an empty table gives an empty result; lines and texts of
any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import DOCUMENT_COLUMNS, materialize

#: At most this many line hashes (8 bytes each) are broadcast to pick lines; beyond it the join is by shuffle.
BROADCAST_KEYS = 1_000_000
#: Repeated lines that are broadcast at most, 48 bytes each.
COMMON = 10_000
_PLACE = 1 << 32
#: Characters whose counts a candidate's two lines must about share (any choice finds the same lines).
LETTERS = "etanorishdlucm"


@dataclass(frozen=True)
class Settings:
    edits: int = 2
    per_edit: int = 20
    least: int = 20


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line); line_no from 0."""
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def allowed(length: Column, settings: Settings) -> Column:
    return F.least(F.lit(settings.edits), F.floor(length / settings.per_edit)).cast("int")


def segment(length: Column, i: int, count: int) -> tuple[Column, Column]:
    """First character (from 1) and length of segment i (from 0) of count; the longer ones come last."""
    base, longer = F.floor(length / count).cast("int"), F.pmod(length, F.lit(count)).cast("int")
    extra = F.greatest(F.lit(0), longer + (i - count))
    return base * i + extra + 1, base + F.when(longer >= count - i, 1).otherwise(0)


def characters(wide: Column, start: Column, size: Column) -> Column:
    """Part of a line in four bytes a character, where any place is found at once."""
    return wide.substr((start - 1) * 4 + 1, size * 4)


def index_keys(line: Column, length: Column, t: int) -> list[Column]:
    return [F.xxhash64(length, F.lit(i), characters(line, *segment(length, i, t + 1))) for i in range(t + 1)]


def probe_keys(line: Column, length: Column, shorter: int, t: int) -> list[Column]:
    """Keys of a line's substrings that can equal a segment of a line `shorter` characters shorter, t edits away. Those
    that the line has as index keys are left out.

    If segment i is the first that matches, at most i edits lie left of it and t - i right of it, which bounds how far
    it can have moved.
    """
    other, keys = length - shorter, []
    for i in range(t + 1):
        start, size = segment(other, i, t + 1)
        for moved in range(max(-i, shorter - (t - i)), min(i, shorter + (t - i)) + 1):
            if shorter or moved:
                keys.append(F.xxhash64(other, F.lit(i), characters(line, start + moved, size)))
    return keys


def key_columns(line: Column, length: Column, settings: Settings) -> list[Column]:
    """All keys of a line, edits + 1 index keys first; null where a line has fewer."""

    def for_each(other: Column, by_t: dict[int, list[Column]]) -> list[Column]:
        if not by_t:
            return []
        fits = lambda t: (other >= settings.least) & (allowed(other, settings) == t)
        return [F.coalesce(*(F.when(fits(t), keys[n]) for t, keys in by_t.items() if n < len(keys))) for n in range(max(map(len, by_t.values())))]

    out = for_each(length, {t: index_keys(line, length, t) for t in range(1, settings.edits + 1)})
    for shorter in range(settings.edits + 1):
        out += for_each(length - shorter, {t: probe_keys(line, length, shorter, t) for t in range(max(1, shorter), settings.edits + 1)})
    return out


def compiled_apart(value: Column) -> Column:
    """The value. Spark compiles a projection that holds a lambda by itself, in many short methods; else it becomes a part
    of its stage's one method, which the JVM only interprets once it passes 8,000 bytes of code."""
    return F.get(F.transform(F.array(value), lambda x: x), F.lit(0))


def distance_within(a: Column, b: Column, k: int) -> Column:
    """Edit distance of a and b if it is at most k, else something above k; lengths differ by k at most, a has over k
    characters.

    Bit p of the band at place j of b stands for character j - k + p of a. Each place takes a constant number of word
    operations on 2k + 1 bits (Hyyro's diagonal form): the band moves down a's characters with b, the distance
    is followed along its lower edge to the end of a, then along a's last row. Most of what both lines begin and end
    with is left out before; that doesn't change their distance.
    """
    # Arguments of lambdas are computed once; expressions inside one would be again for each character.
    pair = F.array(F.struct(a.alias("a"), b.alias("b"), (F.least(F.char_length(a), F.char_length(b)) - (k + 1)).alias("room")))
    pair = F.transform(pair, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["room"].alias("room"), _common_head(s).alias("head")))
    pair = F.transform(pair, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["head"].alias("head"), _common_tail(s).alias("tail")))
    middle = lambda s, c: s[c].substr(s["head"] + 1, F.char_length(s[c]) - s["head"] - s["tail"])
    pair = F.transform(pair, lambda s: F.struct(F.split(middle(s, "a"), "").alias("x"), F.split(middle(s, "b"), "").alias("y")))
    return F.get(F.transform(pair, lambda s: _banded(s["x"], s["y"], F.size(s["x"]), k)), F.lit(0))


#: Halving steps in which the common ends of two lines are measured, to 16 characters.
_STEPS = (4096, 2048, 1024, 512, 256, 128, 64, 32, 16)


def _common_head(s: Column) -> Column:
    same = lambda p, n: s["a"].substr(p + 1, n) == s["b"].substr(p + 1, n)
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda p, n: F.when((p + n <= s["room"]) & same(p, n), p + n).otherwise(p))


def _common_tail(s: Column) -> Column:
    piece = lambda c, p, n: s[c].substr(F.char_length(s[c]) - p - n + 1, n)
    fits = lambda p, n: s["head"] + p + n <= s["room"]
    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), lambda p, n: F.when(fits(p, n) & (piece("a", p, n) == piece("b", p, n)), p + n).otherwise(p))


def _banded(x: Column, y: Column, n: Column, k: int) -> Column:
    mask, top = (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    wide = lambda v: F.lit(v).cast("long")

    def matches(c: Column, j: Column) -> Column:
        out = wide(0)
        for p in range(2 * k + 1):
            out = out + F.when(F.get(x, j - k + p) == c, wide(1 << p)).otherwise(wide(0))
        return F.struct(out.alias("m"), j.alias("j"))

    def step(s: Column, at: Column) -> Column:
        m, vp, vn = at["m"], s["vp"], s["vn"]
        diagonal = ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(wide(mask))
        return F.aggregate(F.array(diagonal), s, lambda old, d: after(old, d, at["j"]))

    def after(s: Column, d: Column, j: Column) -> Column:
        flip = lambda v: F.bitwise_not(v).bitwiseAND(wide(mask))
        hp = s["vn"].bitwiseOR(flip(d.bitwiseOR(s["vp"])))
        hn = d.bitwiseAND(s["vp"])
        row = F.call_function("shiftright", wide(top), (j - n + k + 1).cast("int"))  # of a's last character
        edge = F.when(d.bitwiseAND(wide(top)) == 0, 1).otherwise(0)
        along = F.when(hp.bitwiseAND(row) != 0, 1).when(hn.bitwiseAND(row) != 0, -1).otherwise(0)
        down = F.shiftright(d, 1)
        return F.struct(
            hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (s["dist"] + F.when(j < n - k, edge).otherwise(along)).cast("int").alias("dist"),
        )

    start = F.struct(wide((mask >> k) << k).alias("vp"), wide(0).alias("vn"), F.lit(k).cast("int").alias("dist"))
    return F.aggregate(F.transform(y, matches), start, step)["dist"]


def places() -> Column:
    """The place of a line as one number in document order."""
    return (F.col("doc_id").cast("decimal(20,0)") * _PLACE + F.col("line_no")).cast("decimal(32,0)")


def line_names() -> tuple[Column, Column]:
    """Two hashes that name a line among all."""
    return F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(5), F.col("line")).alias("h2")


def short_name(h1: Column) -> Column:
    """40 bits of a name; lines may share one, whole lines are compared in the end."""
    return h1.bitwiseAND(F.lit((1 << 40) - 1))


def letter_counts(line: Column) -> Column:
    """Counts of some characters, modulo 16, in one number."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)).cast("long"), 4 * k))
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """At most the sum of the differences of letter counts, which an edit changes by 2 at most."""
    out = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        d = F.shiftright(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * k).bitwiseAND(F.lit(15))
        out = out + F.least(d.bitwiseAND(F.lit(15)), (-d).bitwiseAND(F.lit(15)))
    return out


def candidates(docs: DataFrame, settings: Settings) -> DataFrame:
    """(a, b), a < b: hashes of different lines that share a segment where it may stand and have about the same letters."""
    # Keys are computed where lines are read: they are shorter than most lines, and only they are shuffled. A line is
    # named by 128 bits of hash here. Both sides use the same columns, so Spark shuffles them once.
    length = F.char_length("line")
    long_enough = lines(docs).filter(length >= settings.least).select(F.encode("line", "UTF-32").alias("wide"), *line_names(), letter_counts(F.col("line")).alias("letters"), length.alias("length"))
    keys = {f"k{n}": key for n, key in enumerate(key_columns(F.col("wide"), F.col("length"), settings))}
    keyed = long_enough.select(compiled_apart(F.col("h1")).alias("h1"), "h2", "letters", *(key.alias(name) for name, key in keys.items()))
    # Equal lines have equal keys. Numbers are grouped by hashing, arrays would be by sorting.
    different = keyed.groupBy("h1", "h2").agg(*(F.max(name).alias(name) for name in ("letters", *keys)))
    different = different.select(F.array(*keys).alias("keys"), "letters", short_name(F.col("h1")).alias("h"))
    alike = (F.col("h_i") != F.col("h_p")) & (counts_apart(F.col("letters_i"), F.col("letters_p")) <= 2 * settings.edits)
    # From explode() Spark would infer a filter on the arrays and push it, with all it takes to compute them, below
    # the shuffle; from explode_outer() it doesn't. Missing keys are null, which joins nothing.
    index = different.select(F.explode_outer(F.slice("keys", 1, settings.edits + 1)).alias("key"), F.col("letters").alias("letters_i"), F.col("h").alias("h_i"))
    probe = different.select(F.explode_outer("keys").alias("key"), F.col("letters").alias("letters_p"), F.col("h").alias("h_p"))
    pairs = index.join(probe, "key").filter(alike)
    return pairs.select(F.least("h_i", "h_p").alias("a"), F.greatest("h_i", "h_p").alias("b")).distinct()


def near_lines(docs: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """(place) of the first occurrence of each line that has an earlier line within the allowed edits."""
    keys = materialize(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "line-keys")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = lines(docs).filter(F.char_length("line") >= settings.least).join(keys, short_name(F.xxhash64("line")) == F.col("key"))
    texts = materialize(texts.groupBy("key", "line").agg(F.min(places()).alias("place")), "lines")
    side = lambda s: texts.select(F.col("key").alias(s), F.col("line").alias(f"line_{s}"), F.col("place").alias(f"place_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    t = allowed(F.least(F.char_length("line_a"), F.char_length("line_b")), settings)
    close = F.abs(F.char_length("line_a") - F.char_length("line_b")) <= settings.edits
    near = both.filter(close).filter(distance_within(F.col("line_a"), F.col("line_b"), settings.edits) <= t)
    return near.select(F.greatest("place_a", "place_b").alias("place")).distinct()


def dropped_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, dropped): the sorted numbers of the lines that go, of each document that loses some."""
    docs = docs.select("doc_id", "text")
    pairs = materialize(candidates(docs, settings), "line-pairs")
    near = materialize(near_lines(docs, pairs, settings), "near-lines")

    held = lines(docs).filter(F.char_length("line") >= settings.least).select("doc_id", "line_no", *line_names())
    first = held.groupBy("h1", "h2").agg(F.min(places()).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialize(first, "repeated-lines")
    # Lines that hold more than 1 / COMMON of all repeats are at most COMMON: they are broadcast, and their rows aren't
    # dealt by line. Every other line is a small share of the rows.
    total = first.agg(F.sum("n")).first()[0] or 0
    is_common = F.col("n") * COMMON > total
    common = first.filter(is_common).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("first").alias("first_common"))
    held = held.join(F.broadcast(common), (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    scattered = held.withColumn("h1", F.when(F.col("c1").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "line_no")))
    repeats = scattered.join(first.filter(~is_common).select("h1", "h2", "first"), ["h1", "h2"], "left")
    repeats = repeats.filter(places() > F.coalesce("first_common", "first")).select("doc_id", "line_no")
    line_no = F.expr(f"pmod(place, {_PLACE}BD)")
    near = near.select(((F.col("place") - line_no) / _PLACE).cast("long").alias("doc_id"), line_no.cast("int").alias("line_no"))
    gone = repeats.union(near).distinct()
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_list("line_no")).alias("dropped"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = dropped_lines(docs).withColumnRenamed("doc_id", "of")
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1, F.lit(0))
    counted = docs.select("doc_id", n_lines.cast("long").alias("n_lines")).join(gone, F.col("doc_id") == F.col("of"), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return counted.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that go; n_chars follows. A document that loses all its text goes as well."""
    gone = dropped_lines(docs).withColumnRenamed("doc_id", "of")
    joined = docs.select(*DOCUMENT_COLUMNS).join(gone, F.col("doc_id") == F.col("of"), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    cleaned = joined.withColumn("text", text).filter(F.col("dropped").isNull() | (F.trim("text") != ""))
    return cleaned.withColumn("n_chars", F.when(F.col("dropped").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*DOCUMENT_COLUMNS)
