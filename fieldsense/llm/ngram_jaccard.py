"""N-gram Jaccard join by grouped prefixes.

Two shingle sets with Jaccard similarity of at least t share an element of their prefixes: the first n - ceil(t n) + 1
elements in any common order. Documents are collapsed twice: equal sets into one class, classes with equal prefix and
size into one group. Groups that share a prefix element are the candidates; they are expanded to their members and
members are compared by their whole sets.

Only components are asked for, so candidates come in two passes. The first links every holder of a prefix element to
its smallest holder, and every member of a group to the group's smallest: as many pairs as there are holders. The second
takes the pairs of holders, and of members of one group, that the first left in different components. So a group of
thousands of near copies costs no pairs, and no link between components is lost, whatever the common order is: it puts
rare shingles first and decides how many candidates there are, not which links are found. Of an element with more than
`many` holders left, candidates must share a second element as well: two sets that are similar enough share two of the
first n - ceil(t n) + 2, of which members of a group have all but the last in common; each brings its own. Before whole texts are compared, candidates must pass a bound on their intersection from parity
bitmaps: two sets whose bitmaps differ in x bits differ in x elements at least.

Defined cases: null and empty texts have no shingles and link with nothing; rows that repeat an id are one document,
which links as any of its texts does, so all documents linked with one of its texts share its component; a null id takes
no part and gets a null component; an empty table gives an empty result; texts of any length are read whole; other
columns are ignored. Sets are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import DOCUMENT_COLUMNS, discard, in_slices, materialize, releasing
from fieldsense.llm.components import connected_components
from fieldsense.llm.shingles import Shingler, mixed

#: At most this many ids (8 bytes each) are broadcast to pick texts; beyond it the join is by shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs of one id that are compared in one task; the rows of an id with more are dealt over several.
PAIRS_TOGETHER = 1_000


@dataclass(frozen=True)
class Settings:
    """Sets link when 100 * intersection >= percent * union. The frequent shingles, at most `frequent`, come last in
    the common order; they are those seen in at least `noted` texts among about `chunk` shingles read together. Elements
    with more than `many` holders left after the first pass need a second element in common."""

    words: int = 3
    percent: int = 90
    frequent: int = 400_000
    noted: int = 3
    chunk: int = 1_000_000
    many: int = 64


def frequent_shingles(docs: DataFrame, settings: Settings) -> np.ndarray:
    """The most frequent shingles, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held, n = Shingler(settings.words), [], 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= settings.noted
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often], pa.int64())], names=["h", "n"])

        for batch in batches:
            for text in in_slices(batch.column(0)):
                held.append(shingle(text))
                n += len(held[-1])
                if n >= settings.chunk:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    seen = docs.select("text").mapInArrow(releasing(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "h").limit(settings.frequent).toPandas()
    return top["h"].to_numpy(np.int64)[::-1].view(np.uint64)


def prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int, more: int = 0) -> np.ndarray:
    """First n - ceil(t n) + 1 of the sorted hashes in the common order, and as many more; frequent: sorted, rank: their
    places in it."""
    n = len(hashes)
    most = min(n, n + (-percent * n) // 100 + 1 + more)
    if not len(frequent):
        return hashes[:most]
    for upto in (min(n, 2 * most + 16), n):
        head = hashes[:upto]
        at = np.minimum(np.searchsorted(frequent, head), len(frequent) - 1)
        often = frequent[at] == head
        rare = head[~often]
        if len(rare) >= most:
            return rare[:most]
    late = at[often]
    return np.concatenate([rare, head[often][np.argsort(rank[late])]])[:most]


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """Bit i is set if an odd number of hashes falls on i; at least as many bits as hashes, a power of two."""
    size = max(64, 1 << (len(hashes) - 1).bit_length())
    at = (mixed(hashes + np.uint64(191)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Elements in which the sets of two bitmaps differ at least. The larger bitmap is folded: bit i of the smaller
    one is the parity over i, i + size, ... of the larger."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    # Bits are numbered through the bytes, and only the low bits of a hash tell its place, so halves fold together.
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def fingerprints(docs: DataFrame, settings: Settings, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, f1, f2, prefix, bits): size, 128-bit fingerprint, prefix and one element more, and parity bitmap of each
    row's set; columns of longs to be carried along follow."""
    ordered = frequent_shingles(docs, settings)
    by_value = np.argsort(ordered)
    shared = docs.sparkSession.sparkContext.broadcast((ordered[by_value], by_value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(settings.words)
        for batch in batches:
            n, f1, f2, prefixes, bits = [], [], [], [], []
            for text in in_slices(batch.column(1)):
                h = shingle(text)
                n.append(len(h))
                f1.append(int(mixed(h).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
                f2.append(int(np.bitwise_xor.reduce(mixed(h + np.uint64(77))).view(np.int64)) if len(h) else 0)
                prefixes.append(prefix(h, *shared.value, settings.percent, 1).view(np.int64) if len(h) else [])
                bits.append(parity_bitmap(h) if len(h) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary()), *batch.columns[2:]],
                names=["doc_id", "n", "f1", "f2", "prefix", "bits", *carried],
            )

    schema = "doc_id long, n long, f1 long, f2 long, prefix array<long>, bits binary" + "".join(f", {c} long" for c in carried)
    return docs.select("doc_id", "text", *carried).mapInArrow(releasing(run), schema)


def dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) with a part of a, and (id, parts) of all ids in them: an id that is `a` of many pairs has several
    parts, so that no task gets all its pairs."""
    sides = pairs.select(F.col("a").alias("id"), F.lit(1).alias("n")).union(pairs.select("b", F.lit(0)))
    ids = sides.groupBy("id").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / PAIRS_TOGETHER)).cast("int").alias("parts"))
    ids = materialize(ids, "candidate-ids")
    # Ids of several parts are fewer than pairs / PAIRS_TOGETHER, and counted before they are broadcast.
    hubs = ids.filter("parts > 1").select(F.col("id").alias("a"), "parts")
    hubs = F.broadcast(hubs) if hubs.count() <= BROADCAST_IDS else hubs
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    return pairs.join(hubs, "a", "left").select("a", "b", part.alias("part")), ids


def beside(pairs: DataFrame, ids: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """dealt() pairs (a, b, part) + columns_a, columns_b of the table's rows of these ids."""
    named = lambda s: [F.col(c).alias(f"{c}_{s}") for c in columns]
    a = table.join(ids, F.col(key) == F.col("id")).select(F.col(key).alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *named("a"))
    return pairs.join(a, ["a", "part"]).join(table.select(F.col(key).alias("b"), *named("b")), "b")


def possible(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps leave room for enough similarity."""
    pairs, ids = dealt(pairs)
    both = beside(pairs, ids, classes, "cid", ["n", "bits"]).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[2:]]
            keep = []
            for n_a, n_b, x, y in zip(*columns, strict=True):
                shared = -(-settings.percent * (n_a + n_b) // (100 + settings.percent))  # at least, if similar enough
                keep.append(n_a + n_b - 2 * shared >= least_difference(x, y))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(releasing(run), "a long, b long").distinct()


def verify(docs: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """Those of the pairs (a, b) of ids whose whole sets are similar enough."""
    pairs, ids = dealt(pairs)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids.select(F.col("id").alias("wanted")), F.col("doc_id") == F.col("wanted"), "left_semi")
    both = beside(pairs, ids, texts, "doc_id", ["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(settings.words)
        for batch in batches:
            similar, last = [], {}
            for x, y in zip(in_slices(batch.column(2)), in_slices(batch.column(3)), strict=True):
                last = {t: last[t] if t in last else shingle(t) for t in (x, y)}
                shared = len(np.intersect1d(last[x], last[y], assume_unique=True))
                similar.append(100 * shared >= settings.percent * (len(last[x]) + len(last[y]) - shared) > 0)
            keep = pa.array(similar, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(releasing(run), "a long, b long")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, settings: Settings) -> DataFrame:
    """Links among the pairs, written."""
    near = materialize(possible(pairs, classes, settings), "pairs")
    links = materialize(verify(docs, near, settings), "links")
    discard(near)
    return links


def crossing(opened: DataFrame, placed: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """(gid_a, component_a, gid_b, component_b) of groups in different components that share an element where it can
    matter. opened: token, gid, n, pos, component; placed: gid, component, cid of a group's members; classes: cid, longer, the
    prefix and the one element more: members share the prefix only, so second elements come from each of them."""
    t = settings.percent / 100
    side = lambda df, s: df.select(*(F.col(c) if c in ("token", "other") else F.col(c).alias(f"{c}_{s}") for c in df.columns))
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    near = (
        (F.col("component_a") < F.col("component_b"))
        & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (t - 1e-9))
        & (rest >= (F.col("n_a") + F.col("n_b")) * (t / (1 + t)) - 1e-6)
    )
    pair = ["gid_a", "component_a", "gid_b", "component_b"]
    crowded = opened.groupBy("token").agg(F.count("*").alias("left")).filter(F.col("left") > settings.many).select("token")
    if crowded.isEmpty():
        return side(opened, "a").join(side(opened, "b"), "token").filter(near).select(*pair)
    few = opened.join(crowded, "token", "left_anti")
    lots = opened.join(crowded, "token", "left_semi")
    holders = placed.join(lots.select("gid", "component").distinct(), ["gid", "component"], "left_semi")
    seconds = holders.join(classes.select("cid", "longer"), "cid").select("gid", "component", F.explode("longer").alias("other")).distinct()
    lots = lots.join(seconds, ["gid", "component"]).filter("other <> token")
    found = side(few, "a").join(side(few, "b"), "token").filter(near)
    twice = side(lots, "a").join(side(lots, "b"), ["token", "other"]).filter(near)
    return found.select(*pair).union(twice.select(*pair))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id) and the carried columns for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    rows = materialize(fingerprints(docs, settings, carried), "fingerprints")
    usable = rows.filter("n > 0 and doc_id is not null")
    t = settings.percent / 100

    classes = usable.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("cid"), F.any_value("prefix").alias("longer"), F.any_value("bits").alias("bits"))
    own = F.slice("longer", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(settings.percent) / 100) + 1).cast("int"))
    classes = materialize(classes.withColumn("prefix", own).withColumn("group", F.xxhash64("prefix")), "classes")
    groups = classes.groupBy("n", "group").agg(F.min("cid").alias("gid"), F.min_by("prefix", "cid").alias("prefix"))
    members = classes.select("cid", "n", "group").join(groups.select("n", "group", "gid"), ["n", "group"]).select("gid", "cid", "n")
    members = materialize(members, "members")
    # An id with several texts is a document of several classes, which join each other's components.
    texts = usable.select("doc_id", "n", "f1", "f2").distinct()
    several_texts = texts.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    one_id = texts.join(several_texts, "doc_id", "left_semi").join(classes.select("n", "f1", "f2", "cid"), ["n", "f1", "f2"])
    one_id = materialize(one_id.select(F.col("cid").alias("a"), F.col("doc_id").alias("b")), "one-id")

    held = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = held.groupBy("token").agg(F.count("*").alias("holders"), F.min("gid").alias("star")).filter("holders > 1")
    held = materialize(held.join(shared, "token"), "holders")

    star = held.filter("gid <> star").select(F.col("star").alias("a"), F.col("gid").alias("b"), F.col("n").alias("n_b")).distinct()
    star_sizes = held.filter("gid = star").select(F.col("gid").alias("a"), F.col("n").alias("n_a")).distinct()
    star = star.join(star_sizes, "a").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (t - 1e-9)).select("a", "b")
    inside = members.filter("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
    first = materialize(star.union(inside).distinct(), "pairs")
    links = confirmed(docs, classes, first, settings)
    found = materialize(connected_components(links.union(one_id)), "components")

    placed = members.join(found, F.col("cid") == F.col("id"), "left").select("gid", "cid", F.coalesce("component", "cid").alias("component"))
    placed = materialize(placed, "placed")
    units = placed.select("gid", "component").distinct()
    # An element with two holders has been dealt with, unless a holder is a group of several members.
    several = placed.filter("cid <> gid").select("gid").distinct()
    again = held.join(several, "gid", "left_semi").select("token").distinct().withColumn("again", F.lit(True))
    left = held.join(again, "token", "left").filter("holders > 2 or again")
    open_tokens = left.select("token", "gid").join(units, "gid").groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_tokens = open_tokens.filter("low <> high").select("token")
    opened = left.join(open_tokens, "token").join(units, "gid").select("token", "gid", "n", "pos", "component")
    opened = materialize(opened, "open")
    # Members of one group share its whole prefix, also where no other group holds any of it.
    unit = lambda s: units.join(several, "gid", "left_semi").select("gid", F.col("component").alias(f"component_{s}"))
    within = unit("a").join(unit("b"), "gid").filter("component_a < component_b")
    between = crossing(opened, placed, classes, settings).union(within.select(F.col("gid").alias("gid_a"), "component_a", F.col("gid").alias("gid_b"), "component_b")).distinct()
    side = lambda s, c: placed.select(F.col("gid").alias(f"gid_{s}"), F.col("component").alias(f"component_{s}"), F.col("cid").alias(c))
    second = between.join(side("a", "a"), ["gid_a", "component_a"]).join(side("b", "b"), ["gid_b", "component_b"])
    second = second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = materialize(second, "pairs")
    more = confirmed(docs, classes, second, settings)
    if not more.isEmpty():
        found = materialize(connected_components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "components")
    discard(members, one_id, held, first, links, placed, opened, second, more)

    of_class = classes.select("n", "f1", "f2", "cid").join(found, F.col("cid") == F.col("id"), "left").select("n", "f1", "f2", F.coalesce("component", "cid").alias("component"))
    joined = rows.select("doc_id", "n", "f1", "f2", *carried).join(of_class, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), *carried)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Settings(words=3, percent=90))


def near_duplicates_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, by shingles of five words and a similarity of 0.8: the one of smallest id and, where
    that id has several rows in the group, of smallest text hash and other columns.

    Rows are documents of their own here: one that goes takes no other text of its id along. Rows without words or id
    stay, and so do their repeats.
    """
    names = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(5), F.col("text"))}
    row = ["doc_id", *names]
    docs = docs.select(*DOCUMENT_COLUMNS)
    # Rows equal in id and text share a number, which stands for the document while groups are found.
    numbered = docs.filter("doc_id is not null").withColumns(names).select(F.xxhash64("doc_id", "t1", "t2").alias("doc_id"), F.col("doc_id").alias("of"), "text", *names)
    groups = near_duplicates(numbered, Settings(words=5, percent=80), ("of", *names)).filter("n_shingles > 0")
    rows = groups.groupBy("component_id", F.col("of").alias("doc_id"), *names).agg(F.count("*").alias("alike"))
    chosen = rows.groupBy("component_id").agg(F.min(F.struct(*row)).alias("best"))
    judged = materialize(rows.join(chosen, "component_id").select(*row, "alike", (F.struct(*row) == F.col("best")).alias("is_best")), "judged-rows")
    # Of rows equal in id and text one stays; there are few such rows.
    repeated = judged.filter("is_best and alike > 1").select(*row)
    gone = judged.filter("not is_best").select(*row).union(repeated)
    named = docs.withColumns({"t1": F.coalesce(names["t1"], F.lit(0)), "t2": F.coalesce(names["t2"], F.lit(0))})
    one = named.join(repeated, row, "left_semi").groupBy(*row).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    return named.join(gone, row, "left_anti").select(*DOCUMENT_COLUMNS).union(one.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 AND w[1] = '' THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * n_both >= 90 * (p.n + q.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION
  SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.id WHERE r.root < e.b),
components AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN components c ON c.id = d.doc_id
"""
