"""Language identification with string kernels.

The kernel is the blended spectrum of character n-grams, n = 1 to 3, by presence: the mean over n of
|A_n and B_n| / sqrt(|A_n| |B_n|) for the sets of hashed n-grams of two texts. Nystroem landmarks taken from the
training texts give explicit features, kernel ridge regression fits one score for each language against the rest, and
batches of presence vectors are scored by matrix products. As the kernel is linear in a text's scaled presence vector,
landmarks and regression weights are multiplied out once, into one matrix of n-grams by languages.

Defined cases: text that is null or has no letter is `und` with score 0; so is every text if nothing can be learned;
texts of any length are read whole; rows that repeat an id are predicted each and one of them teaches, in the first of
the id's languages; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import in_slices, releasing

#: Bits of the hash of 1-, 2- and 3-grams.
BITS = (11, 13, 15)
STARTS = np.cumsum([0, *(1 << b for b in BITS)])
WIDTH = int(STARTS[-1])
UNKNOWN = "und"
#: At most this many languages (their names and a number each) are broadcast; beyond it the join is by shuffle.
BROADCAST_LANGUAGES = 200_000


@dataclass(frozen=True)
class Settings:
    """The model is fitted on at most per_language texts of a language and texts in all; landmarks in all."""

    per_language: int = 300
    texts: int = 6000
    landmarks: int = 120
    ridge: float = 1e-2
    sharpness: float = 4.0
    batch: int = 96


def presence(text: str, out: np.ndarray) -> None:
    """Set out[i] for each hashed n-gram i of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    a = points * np.uint32(0x9E3779B1)
    out[a >> np.uint32(32 - BITS[0])] = 1
    if len(points) > 1:
        two = (a[:-1] ^ (points[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        out[STARTS[1] + (two >> np.uint32(32 - BITS[1]))] = 1
        if len(points) > 2:
            three = (two[:-1] ^ (points[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
            out[STARTS[2] + (three >> np.uint32(32 - BITS[2]))] = 1


def scaled(flags: np.ndarray) -> np.ndarray:
    """Rows of presence flags, each n-gram length scaled to norm 1 / sqrt(3), so that products are kernel values."""
    x = flags.astype(np.float32)
    for a, b in zip(STARTS, STARTS[1:], strict=False):
        count = x[:, a:b].sum(axis=1, keepdims=True)
        x[:, a:b] /= np.sqrt(len(BITS) * np.maximum(count, 1))
    return x


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(packed: list[bytes], names: list[str], settings: Settings) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, matrix of n-grams by languages, intercepts; from packed presence flags of the training texts."""
    languages = sorted(set(names))
    if not languages:
        return None
    flags = lambda rows: np.unpackbits(np.frombuffer(b"".join(packed[i] for i in rows), np.uint8).reshape(len(rows), -1), axis=1)
    of = np.array([languages.index(x) for x in names])
    each = max(1, settings.landmarks // len(languages))
    chosen = [i for k in range(len(languages)) for i in np.flatnonzero(of == k)[:each]]
    landmarks = scaled(flags(chosen))
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    chunks = [list(range(i, min(i + 128, len(packed)))) for i in range(0, len(packed), 128)]
    features = np.concatenate([scaled(flags(c)) @ landmarks.T for c in chunks]) @ root
    y = np.where(of[:, None] == np.arange(len(languages)), 1.0, 0.0)
    weight = (len(of) / len(languages) / np.bincount(of, minlength=len(languages)))[of][:, None]
    mean_x, mean_y = (weight * features).sum(0) / weight.sum(), (weight * y).sum(0) / weight.sum()
    x = features - mean_x
    inner = x.T @ (weight * x) + settings.ridge * len(of) / 100 * np.eye(x.shape[1])
    solved = np.linalg.solve(inner, x.T @ (weight * (y - mean_y)))
    return languages, (landmarks.T @ (root @ solved)).astype(np.float32), (mean_y - mean_x @ solved).astype(np.float32)


def training_flags(labelled: DataFrame, docs: DataFrame, settings: Settings) -> tuple[list[bytes], list[str]]:
    """Presence flags and languages of the sample: of each language the ids of lowest hash; an id with several languages
    counts for the first of them."""
    marked = labelled.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    # A bound on the hash keeps a little more than the sample of each language, so that only as much is put in order.
    share = F.lit(1.5 * (settings.per_language + 100)) / F.count("*")
    bounds = marked.groupBy("lang").agg(((share - 0.5) * 2.0**64).alias("bound"))
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_LANGUAGES else bounds
    low = marked.join(bounds, "lang").filter(F.xxhash64("doc_id").cast("double") <= F.col("bound"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = low.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= settings.per_language)
    ids = ids.orderBy("place", "lang").limit(settings.texts)

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in in_slices(batch.column(0)):
                row = np.zeros(WIDTH, np.uint8)
                presence(text, row)
                out.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1), batch.column(2)], names=["flags", "lang", "place"])

    texts = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])
    found = texts.select("text", "lang", "place").mapInArrow(releasing(flags), "flags binary, lang string, place int")
    # Of rows that repeat an id one is learned from, the same on every run.
    rows = found.groupBy("lang", "place").agg(F.min("flags").alias("flags")).collect()
    rows.sort(key=lambda r: (r["place"], r["lang"], r["flags"]))
    return [bytes(r["flags"]) for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, held_out, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text, lang).

    held_out: a column expression over doc_id; rows where it is true teach nothing.
    """
    model = fit(*training_flags(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()), docs, settings), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for a in range(0, batch.num_rows if model else 0, settings.batch):
                texts = batch.column(2).slice(a, settings.batch).to_pylist()
                part = [a + i for i, text in enumerate(texts) if has_letter(text)]
                if not part:
                    continue
                flags = np.zeros((len(part), WIDTH), np.uint8)
                for row, i in zip(flags, part, strict=True):
                    presence(texts[i - a], row)
                raw = scaled(flags) @ model[1] + model[2]
                p = np.exp(settings.sharpness * (raw - raw.max(axis=1, keepdims=True)).astype(np.float64))
                p /= p.sum(axis=1, keepdims=True)
                for i, k, best in zip(part, p.argmax(axis=1), p.max(axis=1), strict=True):
                    names[i], scores[i] = model[0][k], float(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(releasing(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
