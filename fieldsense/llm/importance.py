"""Importance resampling towards a target corpus by hashed n-grams.

One scan per document keeps a ring of CRC-32 states, one for each of the last n words: every word opens a state of its own
and extends the others by a space and itself, so the checksums of all runs of 1 to n words that end here come from n steps,
and no run is put together as a string. The scan emits bucket numbers, written once as 16 or 32 bits each; corpus counts,
gains and weights are all taken from them.

A bucket's gain is the log ratio of its smoothed shares of target and source, in thousandths; a document's weight is the
floored mean of its features' gains. Gumbel noise from a hash of the id is added, and the highest scores of documents with
enough words are drawn, which samples without replacement in proportion to exp(weight / 1000). Ranks come from a sort over
ranges of (score, id): a range's ranks begin where the ranges before it end, so no task orders all rows.

Defined cases: null and empty texts have no features and weight 0; a null id has neither score nor rank and doesn't count
among those drawn from; rows that repeat an id share their noise and are ranked one by one, equal ones in any order; empty
documents or an empty target give counts of 0, which the smoothing allows; texts of any length are read whole; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import in_slices, materialize, releasing

#: Runs of ASCII digits, letters and all other code points above ASCII, in UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Settings:
    """Runs of 1 to `words` words; `percent` of the documents of at least `least_words` words are drawn."""

    words: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def ring(words: list[bytes], n: int) -> Iterator[int]:
    """CRC-32 of every run of 1 to n consecutive words joined by spaces, shortest first at each end."""
    if n == 2:  # the ring's common size, without its list
        before = None
        for word in words:
            own = crc32(word)
            yield own
            if before is not None:
                yield crc32(word, crc32(b" ", before))
            before = own
        return
    states: list[int] = []
    for word in words:
        states = [crc32(word), *(crc32(word, crc32(b" ", s)) for s in states[: n - 1])]
        yield from states


def features(docs: DataFrame, settings: Settings, carried: tuple[str, ...] = ()) -> DataFrame:
    """The carried columns, n_words and the buckets of all features of each text, as packed little-endian numbers."""
    kind = np.dtype("<u2" if settings.buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, packed = [], []
            for text in in_slices(batch.column(0)):
                words = WORD.findall((text or "").encode().lower())
                n_words.append(len(words))
                crcs = np.fromiter(ring(words, settings.words), np.uint32)
                packed.append((crcs % np.uint32(settings.buckets)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n_words, pa.int64()), pa.array(packed, pa.binary())], names=[*carried, "n_words", "features"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carried)
    return docs.select("text", *carried).mapInArrow(releasing(run), f"{kept}n_words long, features binary")


def bucket_counts(written: DataFrame, settings: Settings) -> np.ndarray:
    """Features in each bucket. A task sends at most one row a bucket; the driver gets one array of `buckets` numbers."""
    kind = np.dtype("<u2" if settings.buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for packed in in_slices(batch.column(0)):
                total += np.bincount(np.frombuffer(packed, kind), minlength=settings.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = written.select("features").mapInArrow(releasing(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(settings.buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    of = lambda s, t: math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n))))
    return np.array([of(float(s), float(t)) for s, t in zip(source, target, strict=True)], np.int64)


def weights(written: DataFrame, gain: np.ndarray, settings: Settings, carried: tuple[str, ...]) -> DataFrame:
    """The carried columns, n_words, n_features and weight."""
    shared = written.sparkSession.sparkContext.broadcast(gain)
    kind = np.dtype("<u2" if settings.buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for packed in in_slices(batch.column(0)):
                own = shared.value[np.frombuffer(packed, kind)]
                n.append(len(own))
                weight.append(int(own.sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=[*carried, "n_words", "n_features", "weight"])

    kept = "".join(f"`{c}` {written.schema[c].dataType.simpleString()}, " for c in carried)
    return written.select("features", *carried, "n_words").mapInArrow(releasing(run), f"{kept}n_words long, n_features long, weight long")


def ranked(scored: DataFrame, settings: Settings) -> DataFrame:
    """scored (doc_id, n_words, score, ...) + rank of the rows drawn."""
    usable = F.col("doc_id").isNotNull() & (F.col("n_words") >= settings.least_words)
    rows = scored.withColumn("usable", usable)
    # In a written sort by ranges the row's number within its task counts from 0; the task is in the upper bits.
    rows = rows.orderBy(F.desc("usable"), F.desc("score"), "doc_id").withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("task", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND((1 << 33) - 1)), "ranked")
    # A row for each task.
    starts = rows.filter("usable").groupBy("task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("task", before.alias("start"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("start") + F.col("place") + 1
    drawn = F.col("usable") & (rank <= F.floor(settings.percent * F.col("all") / 100))
    return rows.join(F.broadcast(starts), "task", "left").withColumn("rank", F.when(drawn, rank)).drop("usable", "at", "task", "place", "start", "all")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), carried: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, n_words, n_features, weight, score, rank and the carried columns."""
    kept = ("doc_id", *carried)
    written = materialize(features(docs, settings, kept), "features")
    gain = gains(bucket_counts(written, settings), bucket_counts(features(target, settings), settings))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weights(written, gain, settings, kept).withColumn("score", F.col("weight") + noise)
    # Written, since a sort by ranges reads its rows twice.
    return ranked(materialize(scored, "scored"), settings)


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return resample(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH lowered AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
runs AS (
  SELECT side, id, unnest(w) AS f FROM words
  UNION ALL SELECT side, id, w[i] || ' ' || w[i + 1] FROM (SELECT side, id, w, unnest(range(1, len(w))) AS i FROM words)),
counts AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counts)),
bytes AS (
  SELECT f, list_prepend(4294967295, list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))) AS b FROM hexed),
crcs AS (
  SELECT f, xor(4294967295, list_reduce(b, lambda c, y: list_reduce(list_prepend(xor(c, y), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) % 10000 AS bucket FROM bytes),
marked AS (SELECT side, id, bucket, n FROM counts JOIN crcs USING (f)),
totals AS (SELECT sum(n) FILTER (side = 'd') AS s_all, coalesce(sum(n) FILTER (side = 'b'), 0) AS t_all FROM marked),
of_bucket AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM marked GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (t_all + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM of_bucket, totals),
means AS (
  SELECT id, sum(n) AS n_features, sum(n * gain) AS total FROM marked JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight,
    weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN means USING (id) WHERE side = 'd'),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
