"""Components of an edge list against union-find."""

import random

from fieldsense.llm.components import connected_components


def union_find(edges):
    above = {}

    def root(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    return {x: root(x) for x in above}


def test_components_equal_union_find(spark):
    draw = random.Random(3)
    cases = {
        "empty": [],
        "loops and nulls": [(1, 1), (None, 2), (3, None)],
        "stars": [(0, i) for i in range(1, 20)] + [(50, i) for i in range(51, 60)],
        "star around the largest": [(99, i) for i in range(30)],
        "path, repeated": [(i, i + 1) for i in range(40)] * 2,
        "random": [(draw.randrange(-60, 60), draw.randrange(-60, 60)) for _ in range(70)],
    }
    for name, edges in cases.items():
        rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        found = {r["id"]: r["component"] for r in rows}
        assert len(rows) == len(found) and found == union_find(edges), name
