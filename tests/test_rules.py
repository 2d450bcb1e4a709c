"""Rules on small hand-made inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsense.functions import attributes as A
from fieldsense.functions import geo
from fieldsense.functions import text as T
from fieldsense.functions import vectors as V
from fieldsense.operators import captions, dedupe, metrics, splits, windows
from fieldsense.plans.stand_ins import units
from fieldsense.sources import readers
from fieldsense.streaming import events


def ap(y, s, w):
    total, tp, n, out = sum(wi for yi, wi in zip(y, w) if yi), 0.0, 0.0, 0.0
    for score in sorted(set(s), reverse=True):
        gained = sum(wi for yi, si, wi in zip(y, s, w) if si == score and yi)
        tp, n = tp + gained, n + sum(wi for si, wi in zip(s, w) if si == score)
        out += gained * (tp / n if n else 0)
    return out / total if total else None


def test_average_precision_with_ties_and_weights(spark):
    rng = np.random.default_rng(2)
    y, s, w = rng.random(200) < 0.3, rng.integers(0, 12, 200) / 10, rng.integers(0, 3, 200)
    df = spark.createDataFrame([("k", bool(a), float(b), float(c)) for a, b, c in zip(y, s, w)], "k string, y boolean, score double, w double")
    got = metrics.average_precision(df, ["k"], weight=F.col("w")).first()["ap"]
    assert got == pytest.approx(ap(y, s, w))
    assert metrics.average_precision(df.withColumn("y", F.lit(False)), ["k"]).first()["ap"] is None


def test_recall_and_effort(spark):
    rows = [("k", i, y, s) for i, (y, s) in enumerate([(True, 0.9), (True, 0.8), (False, 0.7), (True, 0.6), (False, 0.5)])]
    df = spark.createDataFrame(rows, "k string, unit_id int, y boolean, score double")
    r = metrics.recall_at_precision(df, ["k"], 0.75).first()
    assert (r["recall"], r["threshold"]) == (1.0, 0.6)
    r = metrics.recall_at_precision(df.withColumn("y", F.lit(False)), ["k"], 0.75).first()
    assert r["recall"] == 0 and math.isinf(r["threshold"])
    assert metrics.review_effort(df, ["k"], 0.6).first()["effort"] == pytest.approx(0.4)


def test_boot_weights_sum_to_groups(spark):
    df = spark.createDataFrame([(g,) for g in "abc"], "g string")
    sums = metrics.boot_weights(df, "g", 30).groupBy("boot_id").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 30 and {r["w"] for r in sums} == {3}


def test_same_run_has_no_delta(spark):
    rows = [("k", str(i % 5), i % 3 == 0, (i * 7 % 11) / 11) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, g string, y boolean, a double").withColumn("b", F.col("a"))
    r = metrics.paired_delta(df, ["k"], "g", 20, "a", "b").first()
    assert (r["delta"], r["ci_lo"], r["ci_hi"], r["significant"]) == (0, 0, 0, False)


@pytest.mark.parametrize("duration,expected", [(1.0, [0.0]), (3.0, [0.0]), (4.0, [0.0, 1.0]), (6.0, [0.0, 1.5, 3.0]), (6.4, [0.0, 1.5, 3.0, 3.4])])
def test_frames_end_with_the_recording(spark, duration, expected):
    df = spark.createDataFrame([(1, duration)], "recording_id int, duration_s double")
    got = windows.frame(df, 3.0, 1.5).orderBy("window_idx").collect()
    assert [r["start_s"] for r in got] == pytest.approx(expected)


@pytest.mark.parametrize("bucket", [None, 2.0])
def test_box_overlap_rule(spark, bucket):
    w = spark.createDataFrame([(1, 0, 2.0, 5.0)], "r int, window_idx int, start_s double, end_s double")
    boxes = [("touches", 1.0, 2.0), ("short", 1.5, 2.15), ("enough", 1.5, 2.25), ("half", 4.9, 5.05), ("none", 6.0, 7.0)]
    b = spark.createDataFrame([(1, s, e, c) for c, s, e in boxes], "r int, box_start double, box_end double, class string")
    hits = windows.box_hits(w, b, "r", bucket=bucket)
    assert {r["class"] for r in hits.collect()} == {"enough", "half"}
    assert "BroadcastNestedLoop" not in hits._jdf.queryExecution().toString()


def test_weak_states(spark):
    rows = [(1, 0, 0.0, None), (2, 0, 12.0, 5.0), (2, 1, 12.0, 0.0), (2, 2, 3.0, 6.0), (3, 0, 11.0, None), (3, 1, 2.0, None)]
    df = spark.createDataFrame(rows, "r int, window_idx int, db double, own double")
    got = {(r["r"], r["window_idx"]): r["state"] for r in windows.weak_states(df, "r", "db", "own").collect()}
    assert got == {(1, 0): "pos", (2, 0): "pos", (2, 1): "uncertain", (2, 2): "pos", (3, 0): "pos", (3, 1): "uncertain"}


def test_tone_is_louder_than_noise(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.01, 32_000)
    x[16_000:] += np.sin(np.arange(16_000) * 2 * np.pi * 1000 / 16_000)
    sounds = spark.createDataFrame([("a", 16_000, x.tolist()), ("short", 16_000, x[:100].tolist()), ("none", None, None)], "r string, rate int, samples array<double>")
    spans = spark.createDataFrame([(r, k, float(k), k + 1.0) for r in ("a", "short", "none") for k in (0, 1)], "r string, window_idx int, start_s double, end_s double")
    got = {(r["r"], r["window_idx"]): r["activity_db"] for r in windows.activity(spans, windows.frame_levels(sounds, "r", together=7), "r").collect()}
    quiet, loud = got["a", 0], got["a", 1]
    assert loud > quiet + 20 and all(got[r, k] == 0.0 for r in ("short", "none") for k in (0, 1))


def test_merge_labels_and_keep_first(spark):
    rows = [(1, "m", "a", ["x"]), (2, "m", "b", []), (3, None, "c", []), (4, None, "d", None)]
    df = spark.createDataFrame(rows, "id int, md5 string, label string, secondary array<string>")
    got = {r["id"]: r["secondary"] for r in dedupe.merge_labels(df, "md5", "label", "secondary", "id").collect()}
    assert got == {1: ["b", "x"], 3: [], 4: None}


def test_folds_and_locks(spark):
    df = spark.createDataFrame([("c", f"{b:02d}", b * 10 + i) for b in range(10) for i in range(3)], "cls string, block string, unit int")
    got = splits.contiguous_folds(df, "cls", "block").collect()
    assert {r["block"] for r in got if r["locked"]} == {"08", "09"}
    assert {r["fold"] for r in got if not r["locked"]} == {0, 1, 2, 3, 4}
    groups = splits.group_folds(df, "block", "cls").select("block", "fold").distinct().collect()
    assert len(groups) == 10 and {r["fold"] for r in groups} == {0, 1, 2, 3, 4}


def spread(rows, folds):
    """Mean over classes of the standard deviation of their shares over folds; rows: (fold, class)."""
    by = {}
    for fold, cls in rows:
        by.setdefault(cls, [0] * folds)[fold] += 1
    shares = [[n / sum(v) for n in v] for v in by.values()]
    return sum((sum((x - 1 / folds) ** 2 for x in s) / folds) ** 0.5 for s in shares) / len(shares)


def test_group_folds_balance_classes(spark, monkeypatch):
    rnd = random.Random(4)
    groups = {f"g{i}": rnd.choices("abcd", k=3) for i in range(60)}
    rows = [(g, rnd.choice(groups[g])) for g in groups for _ in range(rnd.choice([1, 5, 30]))]
    df = spark.createDataFrame(rows, "g string, cls string")

    # Back and forth over the folds by modal class and size, as groups were dealt before.
    modal = {g: (max(sorted({c for x, c in rows if x == g}), key=[c for x, c in rows if x == g].count), -sum(x == g for x, _ in rows), g) for g in groups}
    turns = {g: (k % 5 if k // 5 % 2 == 0 else 4 - k % 5) for k, g in enumerate(sorted(groups, key=modal.get))}
    before = spread([(turns[g], c) for g, c in rows], 5)
    for lot in (2000, 7):
        monkeypatch.setattr(splits, "LOT", lot)
        got = splits.group_folds(df, "g", "cls").collect()
        assert len(got) == len(rows) and {r["fold"] for r in got} == set(range(5))
        assert len({(r["g"], r["fold"]) for r in got}) == len(groups)
        if lot == 2000:
            assert spread([(r["fold"], r["cls"]) for r in got], 5) < before

    assert splits.group_folds(df.limit(0), "g", "cls").collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_group_folds_spread_on_the_test_tables(spark, sf):
    u = units(spark, f"/root/testdata/{sf}").select("split_group", "class")
    got = [(r["split_group"], r["class"], r["fold"]) for r in splits.group_folds(u, "split_group", "class").collect()]
    sizes = {g: [c for x, c, _ in got if x == g] for g in {x for x, _, _ in got}}
    order = sorted(sizes, key=lambda g: (max(sorted(set(sizes[g])), key=sizes[g].count), -len(sizes[g]), g))
    turns = {g: (k % 5 if k // 5 % 2 == 0 else 4 - k % 5) for k, g in enumerate(order)}
    assert spread([(f, c) for _, c, f in got], 5) <= spread([(turns[g], c) for g, c, _ in got], 5) + 1e-12


def test_greedy_lock_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("c", "a", 10, 1), ("c", "b", 50, 2), ("c", "d", 5, 3), ("c", "e", 35, 4)], "cls string, g string, n int, ord int")
    got = {r["g"]: r["locked"] for r in splits.greedy_lock(df, "cls", "g", "n", "ord").collect()}
    assert got == {"a": True, "b": False, "d": True, "e": False}


def test_grid_and_digest(spark):
    assert splits.learning_curve_points(spark).count() == 18
    df = spark.createDataFrame([(2, "x"), (1, "y")], "u int, c string")
    one = splits.table_digest(df, "u", ["u", "c"]).first()[0]
    assert one == splits.table_digest(df.orderBy("u"), "u", ["u", "c"]).first()[0] != splits.table_digest(df.withColumn("c", F.lit("z")), "u", ["u", "c"]).first()[0]


def test_text_rules(spark):
    values = lambda t: spark.range(1).select(T.single_value(F.lit(t), {"a": "aa", "b": "bb"}).alias("v")).first()["v"]
    assert (values("aa"), values("aa bb"), values("c")) == ("a", None, None)
    codes = lambda t: spark.range(1).select(T.named_codes(F.lit(t), {"red": "R", "red frog": "RF"}).alias("v")).first()["v"]
    assert (codes("Two red frogs and a red-frog, then red."), codes("Two red frogs"), codes(None)) == (["RF", "R"], ["RF"], [])


def attributes_of(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string").select("id", A.described(F.col("text")).alias("s"))
    return df.select(*(c.alias(k) for k, c in A.attributes(F.col("s")).items())).first(), df


def test_attributes(spark):
    r, df = attributes_of(spark, "A high-pitched trill of 2 - 3.5 seconds. It is not very loud. This is a low-pitched clip. Its release call is a grunt. Peeps come at 3-5 notes per second, rising.")
    assert (r["pitch"], r["loudness"], r["duration_s"], r["notes_per_s"]) == ("high", "quiet", [2.0, 3.5], [3.0, 5.0])
    assert (r["structure"], r["rising_pitch"], r["underwater"]) == (["trill", "peep_plink"], True, None)
    found = A.evidence(df, "id", "s").collect()
    assert all(e["match"] in e["sentence"] for e in found) and {e["field"] for e in found} >= {"pitch", "structure", "duration_s"}
    r, _ = attributes_of(spark, "High-pitched or low-pitched. Moderately loud, then loud. Lasting up to one second. From quiet waters.")
    assert (r["pitch"], r["loudness"], r["duration_s"], r["structure"]) == (None, None, [None, 1.0], None)
    r, _ = attributes_of(spark, "Calls about 1/2 second, called under water.")
    assert (r["duration_s"], r["underwater"]) == ([0.5, 0.5], True)


def test_evidence_is_what_decided(spark):
    _, df = attributes_of(spark, "It is not very loud. LOUD and loud. Lasting up to 2 seconds, less than 3 seconds. Underwater, under water.")
    found = [(e["field"], e["match"]) for e in A.evidence(df, "id", "s").orderBy("place").collect()]
    assert found == [("loudness", "not very loud"), ("loudness", "LOUD"), ("duration_s", "Lasting up to 2 seconds"), ("underwater", "Underwater")]


def test_captions_counties_taxa(spark):
    rows = [("A 2.5-second call, courtesy of Ann Lee. Napa County", "Chorus"), ("1 minute of release", None), ("none", None)]
    df = spark.createDataFrame(rows, "c string, section string")
    types = T.call_types(F.col("c"), F.col("section"), ["chorus", "release", "call"])
    got = df.select(T.caption_duration(F.col("c")), T.caption_recordist(F.col("c")), T.county(F.col("section"), F.col("c")), types).collect()
    assert [tuple(r) for r in got] == [(2.5, "Ann Lee", "Napa", ["call", "chorus"]), (60.0, None, "unknown", ["release"]), (None, None, "unknown", ["unspecified"])]
    species = spark.createDataFrame([("AA", "Alpha one"), ("BB", "Beta two two"), ("CC", "Alpha three four")], "code string, scientific string")
    names = T.taxon_names(species, {"Alpha": ["Omega"]}, {"alpha three": "GG"})
    asked = spark.createDataFrame([(1, "Omega", "one", None), (2, "Beta", "two", "x"), (3, "Alpha", "three", "four"), (4, "Alpha", "three", ""), (5, "No", "one", None)], "id int, gen string, sp string, ssp string")
    assert {r["id"]: (r["label"], r["rank"]) for r in T.classify(asked, names).collect()} == {1: ("AA", "species"), 2: ("BB", "species"), 3: ("CC", "species"), 4: ("GG", "group"), 5: (None, None)}


def test_labels_from_captions(spark):
    names = {"Red Frog": "RF", "Dark Red Frog": "DR", "Blue Toad": "BT"}
    rows = [
        (1, "RF", "u/a.mp3", "A recording of Dark red-frogs. Blue toads call behind."),
        (2, "RF", "u/b.mp3", "Red frog and blue toad together."),
        (3, "RF", "u/c.mp3", "Similar to a blue toad. Red frogs."),
        (4, "RF", "u/d.mp3", "Blue toad and dark red frog."),
        (5, "RF", "u/e.mp3?x=1", "Blue toad."),
        (6, "RF", "u/f.mp3", None),
        (7, "BT", "u/f.mp3", "No name."),
    ]
    fixed = spark.createDataFrame([("e.mp3", "RF", ["DR"])], "file string, label string, secondary array<string>")
    got = {r["recording_id"]: tuple(r)[:] for r in captions.assign_labels(spark.createDataFrame(rows, "recording_id int, code string, url string, caption string"), names, fixed).select("recording_id", "label", "label_source", "needs_review", "secondary").collect()}
    assert got == {
        1: (1, "DR", "caption", True, ["BT"]),
        2: (2, "RF", "page", False, ["BT"]),
        3: (3, "RF", "page", False, []),
        4: (4, "RF", "page", True, ["DR", "BT"]),
        5: (5, "RF", "override", False, ["DR"]),
        6: (6, "RF", "page", True, []),
        7: (7, "BT", "page", True, []),
    }


def test_geo(spark):
    assert spark.range(1).select(geo.range_weight(F.lit(20.0)).alias("w")).first()["w"] == pytest.approx(math.exp(-1))
    x, y = geo.project(F.lit(38.0), F.lit(-120.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r["x"] == pytest.approx(0) and -5_000 < r["y"] < 5_000
    edges = readers.range_edges(spark.createDataFrame([("s", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]])], "code string, polygons array<array<array<array<double>>>>"))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.0, 0.5)], "id int, x double, y double")
    assert {r["id"]: r["distance"] for r in geo.distances(points, edges, "id").collect()} == {1: 0.0, 2: 2.0}
    p = spark.range(1).select(geo.adjust(F.lit(0.3), F.lit(None).cast("double")).alias("p")).first()["p"]
    assert p == pytest.approx(0.3)


def test_masked_loss_counts_nothing(spark):
    r = spark.range(1).select(V.bce(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("l")).first()
    assert r["l"] == pytest.approx(math.log(2))


def test_readers(spark, tmp_path):
    (tmp_path / "dev_1.txt").write_text("Selection\tBegin Time (s)\tEnd Time (s)\tannotation\n1\t0.5\t1.5\tA\n2\t2.0\t2.5\tX\n")
    got = readers.box_tables(spark, str(tmp_path), {"A": "frog", "X": None}).orderBy("box_start").collect()
    assert [(r["recording_id"], r["class"], r["dropped"]) for r in got] == [("dev_1", "frog", False), ("dev_1", None, True)]
    with pytest.raises(Exception, match="unknown label"):
        readers.box_tables(spark, str(tmp_path), {"A": "frog"}).collect()
    with pytest.raises(ValueError):
        readers.check_card({"name": "x"})
    answers = spark.createDataFrame([("c", True, 1), ("c", False, 2)], "clip string, frog boolean, line int")
    assert [r["frog"] for r in readers.last_answers(answers, "clip", "line").collect()] == [False]


def test_ranges_and_paths(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}]}')
    edges = readers.range_edges(readers.range_features(spark, f"{tmp_path}/r.json", "s"))
    assert edges.count() == 6 and edges.select("part").distinct().count() == 2
    layouts = [(r"^(S\d+)/(\d{8})_", ["site_id", "date"]), (r"^(S\d+)/", ["site_id"])]
    df = spark.createDataFrame([("S1/20200102_x.wav",), ("S2/y.wav",), ("other/z.a.wav",)], "p string")
    got = [tuple(r[0]) for r in df.select(readers.path_parts(F.col("p"), layouts)).collect()]
    assert got == [("S1", "20200102", "S1_20200102_x"), ("S2", None, "S2_y"), (None, None, "other_z.a")]


def test_streams_equal_tables(spark):
    sf = "/root/testdata/sf0.001"
    for f in (events.daily_counts, events.sessions):
        streamed = events.run_to_end(f(events.read_events(spark, sf, True)), f"t_{f.__name__}")
        table = f(events.read_events(spark, sf, False))
        assert streamed.exceptAll(table).isEmpty() and table.exceptAll(streamed).isEmpty()
