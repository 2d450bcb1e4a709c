"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks of bounded size and queries into blocks as well; each pair of blocks is one group. In a
group every dimension has its list of vectors in order of value. A query walks all lists from their better end at
once, scores what it meets by its whole vector, and stops when the sum of its products with the list values at the
current depth, which no vector unseen so far can beat, is below its kth best score. One block is searched first; the kth
best score there is a bound that each query takes along to all other blocks, where it stops below that bound at once:
before the first step if the lists' ends can't reach it. The bests of the groups are then ranked by query.

Defined cases: a component or score beyond the range of a long counts as the nearest long; vectors that are null, or hold null or non-finite components, or have another length than most, take no
part; ties go to the smaller id; a candidate row with the query's own id is left out; of rows that repeat a query id
one is the query, as candidates all count; with fewer than k candidates all are returned; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldsense.llm.common import materialize


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def usual_length(vectors: DataFrame, column: str) -> int:
    counts = vectors.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "length").first()
    return first["length"] if first else 0


def within_long(scores: np.ndarray) -> np.ndarray:
    """Floats hold scores below 2**53 only; Python's whole numbers are cut to the range of a long."""
    return np.maximum(np.minimum(scores, (1 << 63) - 1), -(1 << 63)) if scores.dtype == object else scores


class Lists:
    """The sorted list of each dimension over the vectors of a block."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, steps: int = 24):
        self.vectors, self.ids = vectors, ids
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, axis=0)
        self.step = max(8, len(ids) // steps)

    def top(self, query: np.ndarray, own: int, k: int, least=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, better first, of those that score `least` or more if that is given; lists are
        walked `step` places at a time."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.ids == own
        best, scores = np.zeros(0, self.ids.dtype), np.zeros(0, self.vectors.dtype)
        reach = lambda upto: self.values[n - upto, up] @ query[up] + self.values[upto - 1, down] @ query[down]
        if least is not None and within_long(np.array([reach(1)]))[0] < least:
            return best, scores
        for depth in range(0, n, self.step):
            upto = min(n, depth + self.step)
            met = np.zeros(n, bool)
            met[self.order[n - upto : n - depth, up]] = True
            met[self.order[depth:upto, down]] = True
            if not len(up) and not len(down):
                met[:], upto = True, n
            met &= ~seen
            seen |= met
            rows = np.flatnonzero(met)
            found = within_long(self.vectors[rows] @ query)
            if least is not None:
                rows, found = rows[found >= least], found[found >= least]
            best, scores = np.concatenate([best, self.ids[rows]]), np.concatenate([scores, found])
            keep = np.lexsort((best, -scores))[:k]
            best, scores = best[keep], scores[keep]
            bound = within_long(np.array([reach(upto)]))[0]
            if upto == n or (len(best) == k and scores[-1] > bound) or (least is not None and bound < least):
                break
        return best, scores


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in column])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int = 16_384, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) from vectors (vec_id long, parts array<long>).

    Each vector goes to every block of queries and each query to every block of vectors, blocks of at most about
    `block` and `query_block` rows.
    """
    vectors = vectors.select("vec_id", "parts")
    rows = vectors.count()
    queries = vectors.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("parts").alias("parts"))
    n_blocks, n_query_blocks = max(1, -(-rows // block)), max(1, -(-queries.count() // query_block))
    every = lambda first, n: F.explode(F.sequence(F.lit(first), F.lit(n - 1)))
    # The row's hash deals rows out, so that the first block is the same on every run.
    at = F.pmod(F.xxhash64("vec_id", "parts"), F.lit(n_blocks)).cast("int")
    dealt = vectors.withColumn("at", at).withColumn("part", every(0, n_query_blocks))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_query_blocks)).cast("int"))

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(block) and len(asked):
            v, q = _matrix(block["parts"]), _matrix(asked["parts"])
            most = sum(max(abs(int(a)), abs(int(b))) * max(abs(int(c)), abs(int(d))) for a, b, c, d in zip(v.max(axis=0), v.min(axis=0), q.max(axis=0), q.min(axis=0), strict=True))
            kind = np.float64 if most < 1 << 53 else object  # whole numbers are exact either way
            lists = Lists(v.astype(kind), block["vec_id"].to_numpy(np.int64))
            for own, query, least in zip(asked["query_id"], q.astype(kind), asked["least"], strict=True):
                ids, scores = lists.top(query, own, k, None if least is None else int(least))
                out["query_id"] += [own] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += [int(s) for s in scores]
        return pd.DataFrame(out).astype("int64")

    found = "query_id long, vec_id long, score long"
    least = F.lit(None).cast("string")  # as text, since pandas would make a null of longs a float
    seed = dealt.filter("at = 0").groupBy("at", "part").cogroup(asked.withColumn("at", F.lit(0)).withColumn("least", least).groupBy("at", "part")).applyInPandas(search, found)
    if n_blocks > 1:
        seed = materialize(seed, "first-block")
        kth = seed.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("string").alias("least"))
        asked = asked.join(kth, "query_id", "left").withColumn("at", every(1, n_blocks))
        rest = dealt.filter("at > 0").groupBy("at", "part").cogroup(asked.groupBy("at", "part")).applyInPandas(search, found)
        seed = seed.union(rest)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return seed.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.filter(F.size("embedding") == usual_length(rows, "embedding"))
    parts = F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))
    return top_k(rows.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("parts")), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
