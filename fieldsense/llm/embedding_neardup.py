"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the unit vectors by random directions at about the median, and rows near the median go to both sides
(spill). Trees grow in rounds, each a distributed job: of every node that holds more than a leaf's vectors a bounded
sample is taken, a subtree of a few levels is grown on it in one task, and the node's vectors are routed through it, a
bounded part of them in a task. So leaves are equally small whatever the size of the table, and only the number of
rounds grows. Rows that share a leaf in some tree are compared by cosine in double precision; a pair that meets in
several leaves counts in the first. Links are united into components. A node that can't be split, because most of it
lies within the threshold, is cut into blocks, and all pairs of blocks are compared, so nothing is capped. Equal vectors
are collapsed before and counted after.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another length than most link
with nothing; rows that repeat an id are vectors of their own with a common component; a null id takes no part, has a
null component and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsense.llm.common import discard, materialize
from fieldsense.llm.components import connected_components
from fieldsense.llm.exact_topk import usable, usual_length


@dataclass(frozen=True)
class Settings:
    """Nodes of more than `leaf` vectors are split, `levels` levels at most in a round, by about `sample` of their
    vectors. There are `trees` trees, or as many as a tree has levels, so that recall holds as trees get deeper."""

    cosine: float = 0.95
    trees: int = 8
    leaf: int = 200
    levels: int = 6
    sample: int = 4000
    overlap: float = 0.10
    task_rows: int = 5000
    block: int = 2000
    seed: int = 17


#: Subtrees have 64 leaves at most; the path of a node is a number of base-128 digits, one a round after the tree's.
DIGIT = 128
ROUNDS = 7


@dataclass
class Node:
    leaf: int = -1
    direction: np.ndarray | None = None
    low: float = 0.0
    high: float = 0.0
    sides: list = field(default_factory=list)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def levels_of(rows: int, settings: Settings) -> int:
    """Levels after which a node of so many rows has come down to a leaf."""
    return max(0, math.ceil(math.log(max(1.0, rows / settings.leaf)) / -math.log((1 + settings.overlap) / 2)))


def grow(sample: np.ndarray, depth: int, settings: Settings, rng: np.random.Generator, leaves: list[int]) -> Node:
    """A node over the sample. It stays a leaf at the depth limit, on a small sample, or when a split would part linked
    rows or hardly anything: if most of the sample lies close together."""
    if depth > 0 and len(sample) >= 8:
        centre = sample.mean(axis=0)
        close = sample @ (centre / max(np.linalg.norm(centre), 1e-12)) >= settings.cosine
        if close.mean() < 0.5:
            direction = rng.normal(size=sample.shape[1])
            direction /= np.linalg.norm(direction)
            at = sample @ direction
            low, high = np.quantile(at, [0.5 - settings.overlap / 2, 0.5 + settings.overlap / 2])
            left, right = at <= high, at >= low
            if max(left.mean(), right.mean()) <= 0.9:
                sides = [grow(sample[part], depth - 1, settings, rng, leaves) for part in (left, right)]
                return Node(direction=direction, low=low, high=high, sides=sides)
    leaves[0] += 1
    return Node(leaf=leaves[0] - 1)


def route(node: Node, vectors: np.ndarray, rows: np.ndarray, out: list[list[int]]) -> None:
    if node.direction is None:
        for i in rows.tolist():
            out[i].append(node.leaf)
        return
    at = vectors[rows] @ node.direction
    for side, there in zip(node.sides, (at <= node.high, at >= node.low), strict=True):
        if there.any():
            route(side, vectors, rows[there], out)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the pairs, for each of n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def first_meeting(leaves: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """The smallest leaf that the rows of each pair share; leaves: padded with -1."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), chunk):
        x, y = leaves[a[i : i + chunk], :, None], leaves[b[i : i + chunk], None, :]
        out[i : i + chunk] = np.where((x == y) & (x >= 0), x, np.iinfo(np.int64).max).min(axis=(1, 2))
    return out


def compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Rows of one leaf and pair of blocks (i, j) -> (rid, links, root): linked rows that this leaf counts, and the
    smallest id that the row is linked with here."""
    pdf = pdf.sort_values("rid", ignore_index=True)
    leaf, i, j = (int(pdf[c].iloc[0]) for c in ("leaf", "i", "j"))
    x = unit(np.stack(pdf["embedding"].to_numpy()))
    width = max(map(len, pdf["leaves"]))
    leaves = np.full((len(pdf), width), -1, np.int64)
    for row, own in zip(leaves, pdf["leaves"], strict=True):
        row[: len(own)] = own
    block, copies, rid = (pdf[c].to_numpy(np.int64) for c in ("block", "copies", "rid"))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    pairs = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(left), 512):
        a, b = np.nonzero(x[left[k : k + 512]] @ x[right].T >= cosine)
        a, b = left[k + a], right[b]
        pairs.append(np.stack([a, b], axis=1)[(a < b) if i == j else slice(None)])
    a, b = np.concatenate(pairs).T
    counts = first_meeting(leaves, a, b) == leaf
    links = np.zeros(len(pdf), np.int64)
    np.add.at(links, a[counts], copies[b[counts]])
    np.add.at(links, b[counts], copies[a[counts]])
    linked = np.unique(np.concatenate([a, b]))
    return pd.DataFrame({"rid": rid[linked], "links": links[linked], "root": rid[roots(len(pdf), a, b)[linked]]})


def forest(vectors: DataFrame, rows: int, settings: Settings = Settings()) -> DataFrame:
    """(rid, leaf): the leaves of each vector of vectors (rid, embedding), of which there are so many."""
    n_trees = max(settings.trees, levels_of(rows, settings))
    at = vectors.select("rid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_trees).cast("long"))).alias("leaf"), F.lit(False).alias("done"))
    for _ in range(ROUNDS):
        sizes = at.filter(~F.col("done")).groupBy("leaf").agg(F.count("*").alias("n"))
        large = materialize(sizes.filter(F.col("n") > settings.leaf), "large-nodes")
        if large.isEmpty():
            break
        in_large = at.filter(~F.col("done")).join(large, "leaf")
        chance = F.pmod(F.xxhash64("rid", "leaf", F.lit(settings.seed)), F.lit(1 << 30)) < F.least(F.lit(1.0), settings.sample / F.col("n")) * (1 << 30)
        sample = in_large.filter(chance).join(vectors, "rid").select("leaf", "n", "rid", "embedding")

        def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rid")
            node, leaves = int(pdf["leaf"].iloc[0]), [0]
            depth = min(settings.levels, levels_of(int(pdf["n"].iloc[0]), settings))
            tree = grow(unit(np.stack(pdf["embedding"].to_numpy())), depth, settings, np.random.default_rng([settings.seed, node]), leaves)
            return pd.DataFrame({"leaf": [node], "tree": [pickle.dumps(tree)], "leaves": [leaves[0]]})

        trees = materialize(sample.groupBy("leaf").applyInPandas(subtree, "leaf long, tree binary, leaves int"), "subtrees")
        parts = F.ceil(F.col("n") / settings.task_rows).cast("int")
        routed = in_large.join(vectors, "rid").select("leaf", F.pmod(F.xxhash64("rid"), parts).cast("int").alias("part"), "rid", "embedding")
        guides = trees.join(large, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "tree", "leaves")

        def send(rows: pd.DataFrame, guide: pd.DataFrame) -> pd.DataFrame:
            # Without a subtree, when no vector of a node has come into its sample, the node stays as it is.
            node = int(rows["leaf"].iloc[0]) if len(rows) else 0
            tree, leaves = (pickle.loads(guide["tree"].iloc[0]), int(guide["leaves"].iloc[0])) if len(guide) else (Node(leaf=0), 1)
            out: list[list[int]] = [[] for _ in range(len(rows))]
            if len(rows):
                route(tree, unit(np.stack(rows["embedding"].to_numpy())), np.arange(len(rows)), out)
            counts = [len(o) for o in out]
            child = np.array([c for o in out for c in o], np.int64)
            return pd.DataFrame({"rid": np.repeat(rows["rid"].to_numpy(np.int64), counts), "leaf": node * DIGIT + child + 1, "done": leaves == 1})

        below = routed.groupBy("leaf", "part").cogroup(guides.groupBy("leaf", "part")).applyInPandas(send, "rid long, leaf long, done boolean")
        small = at.join(large.select("leaf"), "leaf", "left_anti").unionByName(at.filter("done").join(large.select("leaf"), "leaf", "left_semi"))
        before, at = at, materialize(small.select("rid", "leaf", F.lit(True).alias("done")).unionByName(below), "nodes")
        discard(large, trees, *([before] if before.inputFiles() != vectors.inputFiles() else []))
    return at.select("rid", "leaf")


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    good = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    length = usual_length(vectors.filter(good), "embedding")
    good = good & (F.size("embedding") == length)
    keyed = vectors.withColumn("h1", F.when(good, F.xxhash64("embedding"))).withColumn("h2", F.when(good, F.xxhash64(F.lit(7), "embedding")))
    # A vector's number is a hash of it, so that what is drawn for it doesn't depend on where it stands.
    different = keyed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("vid"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    different = materialize(different.withColumn("rid", F.col("h1")), "vectors")
    of_ids = keyed.filter("h1 is not null").groupBy("vec_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b")
    one_id = keyed.join(of_ids.select("vec_id", "a"), "vec_id").filter("h1 is not null").select("a", F.col("h1").alias("b")).distinct()

    leaves = forest(different.select("rid", "embedding"), different.count(), settings)
    placed = different.select("rid", "copies", "embedding").join(leaves.groupBy("rid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves")), "rid")
    placed = materialize(placed, "placed")
    in_leaf = placed.withColumn("leaf", F.explode("leaves"))
    parts = in_leaf.groupBy("leaf").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("parts"))
    cells = (
        in_leaf.join(parts, "leaf")
        .withColumn("block", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("rid", "copies", "embedding", "leaves", "leaf", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    cosine = settings.cosine
    found = cells.groupBy("leaf", "i", "j").applyInPandas(lambda pdf: compare(pdf, cosine), "rid long, links long, root long")
    found = materialize(found, "links")
    links = found.select(F.col("rid").alias("a"), F.col("root").alias("b"))
    components = materialize(connected_components(links.union(one_id)), "components")

    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    of_rid = different.select("h1", "h2", "rid", "vid", "copies").join(counts, "rid", "left").join(components, F.col("rid") == F.col("id"), "left")
    of_rid = materialize(of_rid.select("h1", "h2", "vid", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("root")), "vector-links")
    first = of_rid.groupBy("root").agg(F.min("vid").alias("component"))
    of_rid = of_rid.join(first, "root").select("h1", "h2", "n_links", "component")
    discard(different, placed, found, components)
    joined = keyed.select("vec_id", "h1", "h2").join(of_rid, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op5_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
counts AS (SELECT a, count(*) AS n FROM edges GROUP BY a),
reached AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings
  UNION
  SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.id WHERE r.root < e.b),
components AS (SELECT id, min(root) AS component_id FROM reached GROUP BY id)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id JOIN components ON id = vec_id
"""
