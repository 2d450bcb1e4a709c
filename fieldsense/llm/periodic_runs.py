"""Runs of repeated words by Crochemore's partition refinement.

Positions of a text are split into classes of equal factors, by words first and then one word longer at each level. Level
l + 1 splits a class of level l by the classes that its members' right neighbours are in; of a class that was split before,
all parts but the largest suffice for that, so a position takes part in a logarithmic number of levels. Two neighbours of
a class of level l that are l words apart are a square with a primitive root: l words, at once repeated. Squares that begin
at neighbouring words are one run, a stretch of words with smallest period l.

Texts of a batch are refined together, as one sequence of numbers in which words of different texts differ and a word of
its own ends each text; a level is a few array operations over the positions that take part. Only runs of `exponent`
periods and `least` words are asked for, so levels beyond a text's length / exponent aren't needed.

Defined cases: null and empty texts have no words, no runs and the hashes of nothing; a null id is never made periodic;
rows that repeat an id are separate texts; an empty table gives an empty result; texts of any length are read whole, one
longer than a batch by itself; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import in_slices, releasing


@dataclass(frozen=True)
class Settings:
    """A run has `least` words and `exponent` periods at least; about `together` words are refined at a time."""

    least: int = 6
    exponent: int = 4
    together: int = 200_000


class Squares:
    """Positions by the distance to the next member of their class. Distances only grow, so each is asked for once; small
    lots of changes go to a list for each distance, large ones are kept sorted."""

    def __init__(self, bulk: int = 256):
        self.bulk, self.few, self.sorted = bulk, defaultdict(list), []

    def add(self, at: np.ndarray, distance: np.ndarray) -> None:
        if len(at) <= self.bulk:
            for i, d in zip(at.tolist(), distance.tolist(), strict=True):
                self.few[d].append(i)
        else:
            order = np.argsort(distance, kind="stable")
            self.sorted.append((distance[order], at[order]))

    def take(self, distance: int) -> np.ndarray:
        parts = []
        for k, (d, at) in enumerate(self.sorted):
            a, b = np.searchsorted(d, (distance, distance + 1))
            if b > a:
                parts.append(at[a:b])
            if b:
                self.sorted[k] = (d[b:], at[b:])
        self.sorted = [x for x in self.sorted if len(x[0])]
        if own := self.few.pop(distance, None):
            parts.append(np.array(own, np.int64))
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    def __bool__(self) -> bool:
        return bool(self.few or self.sorted)


class Partition:
    """Classes of positions, as segments of one array of places, and links from each position to its class neighbours."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.places = np.argsort(numbers, kind="stable")
        self.at = np.empty(n, np.int64)
        self.at[self.places] = np.arange(n)
        first = np.ones(n, bool)
        first[1:] = numbers[self.places][1:] != numbers[self.places][:-1]
        starts = np.flatnonzero(first)
        # A class that is split gives its name to what rests or to its largest part, so there are n names at most.
        self.of = np.empty(n, np.int64)
        self.of[self.places] = np.cumsum(first) - 1
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: len(starts)] = starts
        self.size[: len(starts)] = np.diff(np.append(starts, n))
        self.classes = len(starts)
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        self._link(self.places, ~first)
        self.moving = np.zeros(n, bool)

    def _link(self, ordered: np.ndarray, follows: np.ndarray) -> None:
        """follows[k]: ordered[k] comes next to ordered[k - 1] in one class."""
        k = np.flatnonzero(follows)
        self.next[ordered[k - 1]] = ordered[k]
        self.before[ordered[k]] = ordered[k - 1]

    def refine(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Splits classes by the classes of the active positions to the right; gives the positions that are active on the
        next level, and those whose next neighbour has changed."""
        none = np.zeros(0, np.int64)
        left = active - 1
        keep = left >= 0
        keep[keep] = self.size[self.of[left[keep]]] > 1
        left, right = left[keep], self.of[active[keep]]
        if not len(left):
            return none, none
        order = np.lexsort((left, right, self.of[left]))
        left, right = left[order], right[order]
        own = self.of[left]
        new_class = np.ones(len(left), bool)
        new_class[1:] = own[1:] != own[:-1]
        new_part = new_class.copy()
        new_part[1:] |= right[1:] != right[:-1]
        parts = np.flatnonzero(new_part)
        counts = np.diff(np.append(parts, len(left)))
        class_at = np.flatnonzero(new_class[parts])  # of each class, its first part
        class_of_part = np.cumsum(new_class[parts]) - 1
        moved = np.add.reduceat(counts, class_at)
        rest = self.size[own[parts[class_at]]] - moved
        # A class that one part takes whole isn't split.
        split = (rest > 0) | (np.diff(np.append(class_at, len(parts))) > 1)
        if not split.any():
            return none, none
        if not split.all():
            in_split = split[class_of_part]
            take = np.repeat(in_split, counts)
            left, counts = left[take], counts[in_split]
            class_of_part = np.cumsum(split)[class_of_part[in_split]] - 1
            rest, moved = rest[split], moved[split]
            parts = np.append(0, np.cumsum(counts)[:-1])
            class_at = np.flatnonzero(np.diff(class_of_part, prepend=-1))
        old = self.of[left[parts[class_at]]]
        largest = np.lexsort((-counts, class_of_part))[class_at]  # of each class, its largest part
        # Nothing rests where all members move; the largest part then keeps the class and its name.
        keeps = np.zeros(len(parts), bool)
        keeps[largest[rest == 0]] = True

        self._unlink(left)
        follows = np.ones(len(left), bool)
        follows[parts] = False
        self.next[left], self.before[left] = -1, -1
        self._link(left, follows)

        # What moves goes to the end of its class's segment, part by part; what is there and stays fills the gaps.
        class_sizes = rest + moved
        ends = self.start[old] + class_sizes
        tail = np.repeat(ends - moved - np.append(0, np.cumsum(moved)[:-1]), moved) + np.arange(len(left))
        self.moving[left] = True
        there = self.places[tail]
        staying = there[~self.moving[there]]
        gaps = self.at[left]
        gaps = gaps[gaps < np.repeat(ends - moved, moved)]
        self.places[gaps], self.at[staying] = staying, gaps
        self.places[tail], self.at[left] = left, tail
        self.moving[left] = False

        fresh = np.flatnonzero(~keeps)
        names = np.empty(len(parts), np.int64)
        names[fresh] = self.classes + np.arange(len(fresh))
        names[keeps] = old[class_of_part[keeps]]
        self.classes += len(fresh)
        self.size[old] = rest
        self.size[names], self.start[names] = counts, tail[parts]
        self.of[left] = np.repeat(names, counts)

        # The largest of a class's parts, the rest among them, isn't needed on the next level.
        rest_is_largest = rest >= counts[largest]
        needed = np.ones(len(parts), bool)
        needed[largest[~rest_is_largest]] = False
        rests = old[~rest_is_largest & (rest > 0)]
        n_rest = self.size[rests]
        of_rests = np.repeat(self.start[rests] - np.append(0, np.cumsum(n_rest)[:-1]), n_rest) + np.arange(n_rest.sum()) if len(rests) else none
        return np.concatenate([left[np.repeat(needed, counts)], self.places[of_rests]]), np.concatenate([left, self.widened])

    def _unlink(self, left: np.ndarray) -> None:
        """Takes the positions, in order by class, part and place, out of their classes' links."""
        self.moving[left] = True
        before, after = self.before[left], self.next[left]
        # A block of neighbours that all move begins where the one before stays, and ends where the next one stays.
        begins = left[(before < 0) | ~self.moving[before]]
        ends = left[(after < 0) | ~self.moving[after]]
        begins, ends = self._by_class(begins), self._by_class(ends)
        a, b = self.before[begins], self.next[ends]
        has_a, has_b = a >= 0, b >= 0
        self.next[a[has_a]] = b[has_a]
        self.before[b[has_b]] = a[has_b]
        self.widened = a[has_a & has_b]
        self.moving[left] = False

    def _by_class(self, at: np.ndarray) -> np.ndarray:
        return at[np.lexsort((at, self.of[at]))]


def runs_together(texts: list[list], settings: Settings = Settings()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, a list of words, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # A text with too few words, or without any word twice, has none.
    used = [k for k, words in enumerate(texts) if len(words) >= max(settings.least, settings.exponent) and len(set(words)) < len(words)]
    if not used:
        return found
    numbers, starts, last, total = [], [], 0, 0
    for k in used:
        own: dict = {}
        numbers.append(np.fromiter((own.setdefault(w, len(own)) for w in texts[k]), np.int64, len(texts[k])) + last)
        last += len(own)
        numbers.append(np.array([last]))
        last += 1
        starts.append(total)
        total += len(texts[k]) + 1
    starts = np.array(starts)
    lengths = np.diff(np.append(starts, total)) - 1
    longest = np.repeat(lengths // settings.exponent, lengths + 1)  # of each position, the greatest period of its text
    classes = Partition(np.concatenate(numbers))
    squares = Squares()
    level, active, changed = 1, np.arange(total), np.arange(total)
    while True:
        distance = classes.next[changed] - changed
        wanted = (classes.next[changed] >= 0) & (distance >= level) & (distance <= longest[changed])
        squares.add(changed[wanted], distance[wanted])
        at = squares.take(level)
        at = at[classes.next[at] - at == level]
        least = max(settings.least, settings.exponent * level) - 2 * level
        if len(at) > least:
            breaks = np.flatnonzero(np.diff(at) != 1)
            first, end = np.append(0, breaks + 1), np.append(breaks, len(at) - 1)
            long = end - first >= least
            for a, n in zip(at[first[long]].tolist(), (end - first)[long].tolist(), strict=True):
                k = int(np.searchsorted(starts, a, "right")) - 1
                found[used[k]].append((a - int(starts[k]), n + 2 * level, level))
        active = active[longest[active] > level]
        if not len(active) and not squares:
            break
        active, changed = classes.refine(active) if len(active) else (active, active)
        level += 1
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def tiled(words: list, h: int | None) -> list:
    """The words, every tenth text's made periodic from a word on, as its number h says."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(steps)[:-1].tolist(), strict=True) if not gone]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; of equal ones the first, then the one of smaller period."""
    best = None
    for run in runs:  # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def find_runs(docs: DataFrame, settings: Settings = Settings(), prepared=lambda words, doc_id: words) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_runs, runs, and the collapsed text; prepared(words, doc_id): the words to be searched.

    runs: array of (start, length, period). Words are joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def done(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = runs_together(texts, settings)
            named = [[{"start": a, "length": n, "period": p} for a, n, p in own] for own in runs]
            shorter = [b" ".join(collapsed(words, own)).decode() for words, own in zip(texts, runs, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(map(len, runs), pa.int64()), pa.array(named, kind), pa.array(shorter, pa.string())], names=["doc_id", "n_runs", "runs", "collapsed"])

        for batch in batches:
            id_type = batch.column(0).type
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), in_slices(batch.column(1)), strict=True):
                words = prepared((text or "").encode().split(), doc_id)
                if texts and held + len(words) > settings.together:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
            if texts:
                yield done(ids, texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(releasing(run), f"doc_id {kind}, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    number = lambda doc_id: None if doc_id is None else crc32(str(doc_id).encode())
    found = find_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), prepared=lambda words, doc_id: tiled(words, number(doc_id)))
    # Exponents are compared exactly: products of a length and a period stay far below 2^63.
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    hashed = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        "n_runs",
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        hashed(lines).alias("runs_sha256"),
        hashed(F.col("collapsed")).alias("collapsed_sha256"),
    )


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
bytes AS (
  SELECT doc_id, list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))) AS b
  FROM documents),
crcs AS (
  SELECT doc_id, xor(4294967295, list_reduce(b, lambda c, y: list_reduce(list_prepend(xor(c, y), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) AS h FROM bytes),
parts AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM words JOIN crcs USING (doc_id)),
tiles AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM parts),
tokens AS (
  SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM tiles)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM tokens x JOIN tokens y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
of_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM tokens ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN of_doc USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
