"""Toxicity scores by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and their beginnings of 4, 5 and 6 bytes (stems), hashed into
buckets. score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the buckets present: the second sum holds what two
terms say together, such as an insult and the mention of a group, beyond what either says alone. Buckets whose share
of toxic texts doesn't differ from the rest get no weight.

Defined cases: null and empty texts are scored by the intercept; texts of any length are read whole; a document with
several labels counts as toxic if one says so; rows that repeat an id are scored each and one of them teaches; without both labels in the
training rows every score is the share of toxic rows (0 without rows); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import DOCUMENT_COLUMNS, in_slices, releasing

STEMS = (4, 5, 6)
_BREAKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


@dataclass(frozen=True)
class Settings:
    """The machine is fitted on at most per_label texts of each label, those of lowest hash of doc_id."""

    per_label: int = 4000
    bits: int = 18
    factors: int = 8
    epochs: int = 25
    step: float = 0.1
    decay: float = 1e-4
    least_texts: int = 3
    least_z: float = 2.5


def words(text: str) -> set[bytes]:
    return set(text.encode().lower().translate(_BREAKS).split())


def buckets(word: bytes, bits: int) -> tuple[int, ...]:
    keep = (1 << bits) - 1
    return (crc32(word) & keep, *(crc32(b"%d:" % n + word[:n]) & keep for n in STEMS if len(word) >= n))


def text_buckets(text: str | None, bits: int) -> np.ndarray:
    found: set[int] = set()
    for word in words(text or ""):
        found.update(buckets(word, bits))
    return np.array(sorted(found), np.int32)


@dataclass
class Machine:
    place: dict[int, int]  # of the buckets that count
    bias: float
    linear: np.ndarray
    pairs: np.ndarray

    def raw(self, present: list[list[int]]) -> np.ndarray:
        sizes = [len(p) for p in present]
        flat = np.fromiter((i for p in present for i in p), np.int64, sum(sizes))
        row = np.repeat(np.arange(len(present)), sizes)
        out = self.bias + np.bincount(row, self.linear[flat], len(present))
        v = self.pairs[flat]
        for f in range(v.shape[1]):
            out += 0.5 * (np.bincount(row, v[:, f], len(present)) ** 2 - np.bincount(row, v[:, f] ** 2, len(present)))
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[np.ndarray], toxic: np.ndarray, share: float, settings: Settings) -> Machine:
    """Adagrad over the sampled texts; rows are weighted so that toxic ones make up their share of all."""
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    prior = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not n1 or not n0:
        return Machine({}, prior if n1 + n0 else -30.0, np.zeros(0), np.zeros((0, settings.factors)))
    size = 1 << settings.bits
    pos, neg = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for t, y in zip(texts, toxic, strict=True):
        (pos if y else neg)[t] += 1  # a text holds a bucket once
    p, q = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    z = (p - q) / np.sqrt((p + q) / 2 * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((np.abs(z) >= settings.least_z) & (pos + neg >= settings.least_texts))
    place = np.full(size, -1)
    place[chosen] = np.arange(len(chosen))
    rows = [place[t][place[t] >= 0] for t in texts]
    weight = np.where(toxic, share / n1, (1 - share) / n0) * len(texts)
    rng = np.random.default_rng(5)
    model = Machine(dict(zip(chosen.tolist(), range(len(chosen)), strict=True)), prior, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), settings.factors)))
    seen_b, seen_w, seen_v = 1.0, np.ones(len(chosen)), np.ones((len(chosen), settings.factors))
    for _ in range(settings.epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            sizes = [len(rows[i]) for i in part]
            flat, row = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), sizes)
            v = model.pairs[flat]
            sums = np.stack([np.bincount(row, v[:, f], len(part)) for f in range(settings.factors)], axis=1)
            raw = model.bias + np.bincount(row, model.linear[flat], len(part)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (v**2).sum(1), len(part)))
            error = (sigmoid(raw) - toxic[part]) * weight[part]
            of, at = np.unique(flat, return_inverse=True)
            grad_w = np.bincount(at, error[row], len(of)) + settings.decay * model.linear[of]
            each = error[row][:, None] * (sums[row] - v)
            grad_v = np.stack([np.bincount(at, each[:, f], len(of)) for f in range(settings.factors)], axis=1) + settings.decay * model.pairs[of]
            grad_b = error.sum()
            seen_b += grad_b**2
            seen_w[of] += grad_w**2
            seen_v[of] += grad_v**2
            model.bias -= settings.step * grad_b / np.sqrt(seen_b)
            model.linear[of] -= settings.step * 3 * grad_w / np.sqrt(seen_w[of])
            model.pairs[of] -= settings.step * grad_v / np.sqrt(seen_v[of])
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, settings: Settings) -> Machine:
    """From docs (doc_id, text) and labels (doc_id, toxic) where usable, an expression over doc_id, is true."""
    marked = labels.filter(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    # A bound on the hash keeps a little more than the sample of each label, so that only as much is put in order.
    spread = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    bound = {toxic: int(min(1.0, 1.5 * (settings.per_label + 100) / n) * spread) for toxic, n in counts.items()}
    low = marked.select("doc_id", (F.col("toxic") > 0).alias("toxic")).filter(place < F.when(F.col("toxic"), bound.get(True, 0)).otherwise(bound.get(False, 0)))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(place, "doc_id"))
    sample = low.withColumn("rank", rank).filter(F.col("rank") <= settings.per_label).drop("rank")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_buckets(t, settings.bits).tobytes() for t in in_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], names=["doc_id", "terms", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    found = joined.mapInArrow(releasing(terms), f"doc_id {kind}, terms binary, toxic boolean")
    # Of rows that repeat an id one is learned from, the same on every run.
    rows = found.groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms")).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["terms"])))
    total = sum(counts.values())
    return fit([np.frombuffer(r["terms"], np.int32) for r in rows], np.array([r["toxic"] for r in rows], bool), counts.get(True, 0) / total if total else 0.0, settings)


def score(docs: DataFrame, model: Machine, settings: Settings, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns of docs + score, for each row of docs (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            present = []
            for text in in_slices(batch.column(0)):
                found: set[int] = set()
                for word in words(text or ""):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) > 100_000:
                            known.clear()
                        ids = tuple(model.place[b] for b in buckets(word, settings.bits) if b in model.place)
                        if len(word) <= 48:
                            known[word] = ids
                    if ids:
                        found.update(ids)
                present.append(sorted(found))
            scores = sigmoid(model.raw(present)) if present else []
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*keep, "score"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(F.col("text").alias("__read"), *keep).mapInArrow(releasing(run), f"{kinds}, score double")


def _usable() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def op8_toxicity(spark, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _usable(), settings)
    scored = score(docs.withColumn("held_out", F.coalesce(~_usable(), F.lit(False))), model, settings, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Documents that score below 0.5; the machine learns from their labels."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _usable(), settings)
    return score(docs, model, settings, tuple(DOCUMENT_COLUMNS)).filter(F.col("score") < 0.5).select(*DOCUMENT_COLUMNS)
