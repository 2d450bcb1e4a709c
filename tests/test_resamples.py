"""The resampled queries with the reference's counts of resamples, against brute force."""

from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest

from fieldsense.plans import catalogue
from fieldsense.plans.stand_ins import units

SF = "/root/testdata/sf0.001"


def weights(names, n_boot):
    draw = lambda b, j: int(md5(f"{b}-{j}".encode()).hexdigest()[:8], 16) % len(names)
    return [Counter(names[draw(b, j)] for j in range(len(names))) for b in range(n_boot)]


def ap(rows, score, weight):
    """Average precision of rows with weights by group; equal scores are one step."""
    steps = defaultdict(lambda: [0, 0])
    for r in rows:
        steps[r[score]][0] += weight[r["split_group"]] * r["y"]
        steps[r[score]][1] += weight[r["split_group"]]
    tp = n = gained = 0
    for s in sorted(steps, reverse=True):
        tp, n = tp + steps[s][0], n + steps[s][1]
        gained += steps[s][0] * tp / n if n else 0
    return gained / tp if tp else None


@pytest.fixture(scope="module")
def by_class(spark):
    found = defaultdict(list)
    for r in units(spark, SF).collect():
        found[r["class"]].append(r)
    return found


def test_run(spark, by_class):
    drawn = weights(sorted({r["split_group"] for rows in by_class.values() for r in rows}), 500)
    got = {(r["boot_id"], r["split_group"]): r["weight"] for r in catalogue.QUERIES["q_boot_weights_run"](spark, SF).collect()}
    assert got == {(b, g): n for b, w in enumerate(drawn) for g, n in w.items()}
    got = {(r["boot_id"], r["class"]): r["ap"] for r in catalogue.QUERIES["q_boot_ap_run"](spark, SF).collect()}
    expected = {(b, c): ap(rows, "score_a", w) for b, w in enumerate(drawn) for c, rows in by_class.items() if any(w[r["split_group"]] for r in rows)}
    assert got.keys() == expected.keys()
    assert all(got[k] == expected[k] or abs(got[k] - expected[k]) < 1e-8 for k in got)


def test_compare(spark, by_class):
    drawn = weights(sorted({r["split_group"] for rows in by_class.values() for r in rows}), 1000)
    once = Counter({r["split_group"]: 1 for rows in by_class.values() for r in rows})
    got = {r["class"]: r for r in catalogue.QUERIES["q_paired_delta_compare"](spark, SF).collect()}
    assert got.keys() == by_class.keys()
    for c, rows in by_class.items():
        both = [(ap(rows, "score_a", w), ap(rows, "score_b", w)) for w in drawn]
        lo, hi = np.quantile([b - a for a, b in both if a is not None], [0.025, 0.975])
        found = (ap(rows, "score_b", once) - ap(rows, "score_a", once), lo, hi)
        assert np.allclose([got[c][k] for k in ("delta", "ci_lo", "ci_hi")], found, atol=2e-8) and got[c]["significant"] == (lo > 0 or hi < 0)
    decided = catalogue.QUERIES["q_decide_compare"](spark, SF).collect()[0]
    lowest, worst = min(r["ci_lo"] for r in got.values()), min(r["delta"] for r in got.values())
    assert abs(decided["delta"] - np.mean([r["delta"] for r in got.values()])) < 1e-6 and decided["adopt"] == (lowest > 0 and worst >= -0.05)
