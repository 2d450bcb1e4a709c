"""Evaluation, catalogue, splits and readers against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldsense.operators import catalog, dedupe, evaluation, metrics, pipelines, splits
from fieldsense.sources import readers


def ap(pairs):
    """Average precision of (positive, score) pairs, ties as one block."""
    total, tp, n, out = sum(y for y, _ in pairs), 0, 0, 0.0
    for s in sorted({s for _, s in pairs}, reverse=True):
        block = [y for y, t in pairs if t == s]
        tp, n = tp + sum(block), n + len(block)
        out += sum(block) * tp / n
    return out / total if total else None


def run(spark, seed=1):
    rnd = random.Random(seed)
    units, scores = [], []
    for i in range(150):
        domain = "focal" if i < 100 else "aru"
        kind = "background" if i >= 125 else "frog"
        own = rnd.choice("AAAAB") if kind == "frog" else None
        units.append((i, own, kind, domain, i % 11 == 0, i % 5, [rnd.choice("AB")] if i % 9 == 0 else [], i % 3 > 0, "air" if i % 4 else "underwater", f"g{i % 17}"))
        scores += [(i, c, round(rnd.random() * 0.6 + (0.3 if c == own else 0), 1)) for c in "AB"]
    u = spark.createDataFrame(units, "unit_id int, own string, kind string, domain string, locked boolean, fold int, masked array<string>, leakage_safe boolean, medium string, split_group string")
    return units, scores, u, evaluation.judged(spark.createDataFrame(scores, "unit_id int, class string, score double"), u)


def test_headline_and_tables(spark):
    units, scores, u, rows = run(spark)
    of = {x[0]: x for x in units}
    judged = [(c, s, *of[i]) for i, c, s in scores if not of[i][4]]
    pick = lambda domain, c, cond=lambda r: True: [(r[3] == c, r[1]) for r in judged if r[5] == domain and r[0] == c and c not in r[8] and cond(r)]
    got = {r["metric"]: r["value"] for r in evaluation.headline(rows, u).collect()}
    a = {c: ap(pick("focal", c)) for c in "AB"}
    n = {c: sum(x[1] == c and x[3] == "focal" and not x[4] for x in units) for c in "AB"}
    assert n["A"] >= 30 > n["B"]
    expected = {"A_macro_ap": (a["A"] + a["B"]) / 2, "A_macro_ap_rare": a["B"], "A_macro_ap_common": a["A"], "A_ap:A": a["A"], "A_ap:B": a["B"]}
    expected["A_macro_ap_leakage_safe"] = sum(ap(pick("focal", c, lambda r: r[9])) for c in "AB") / 2
    expected["A_macro_ap_air"] = sum(ap(pick("focal", c, lambda r: r[10] == "air")) for c in "AB") / 2
    b = {c: ap(pick("aru", c)) for c in "AB"}
    expected |= {"B_macro_ap": (b["A"] + b["B"]) / 2, "B_ap:A": b["A"], "B_ap:B": b["B"]}
    clips = {x[0]: (x[2] == "frog", max(s for i, _, s in scores if i == x[0])) for x in units if x[3] == "aru" and not x[4]}
    expected["B_detection_ap"] = ap(list(clips.values()))
    assert got == pytest.approx(expected)
    table = {r["class"]: r for r in evaluation.per_class_b(rows).collect()}
    quiet = [r for r in judged if r[5] == "aru" and r[4] == "background" and r[0] == "A"]
    assert table["A"]["fp_per_hour"] == pytest.approx(sum(r[1] >= 0.5 for r in quiet) / (len(quiet) * 3 / 3600))
    own = [r for r in judged if r[5] == "aru" and r[0] == "A" and r[3] == "A"]
    assert table["A"]["clips"] == len(own) and table["A"]["recall_at_half"] == pytest.approx(sum(r[1] >= 0.5 for r in own) / len(own))
    assert {r["pool"] for r in evaluation.thresholds(rows, u).collect()} == {"aru"}


def test_comparison_of_a_run_with_itself_and_a_better_one(spark):
    _, _, u, rows = run(spark, 2)
    same = evaluation.delta_headline(rows, rows, u, 20)
    assert all(r["delta"] == 0 and not r["significant"] for r in same.filter("delta is not null").collect())
    assert not evaluation.adopt(same).first()["adopt"]
    better = rows.withColumn("score", F.col("y").cast("double"))
    decided = evaluation.adopt(evaluation.delta_headline(rows, better, u, 40)).first()
    assert decided["primary"] == "B_macro_ap" and decided["adopt"]


def test_running_sums_over_pieces(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", None]), rnd.choice([rnd.uniform(-3, 3), 0.5, 1e9, -1e9, None, math.nan]), 1.0) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, score double, w double")
    got = metrics.running_sums(df.groupBy("k", "score").agg(F.sum("w").alias("w")), ["k"], "score", {"n": F.col("w")}).collect()
    rank = lambda s: (-math.inf if s is None else s) if s is None or s == s else math.inf
    for r in got:
        above = sum(1 for k, s, _ in rows if k == r["k"] and ((s is not None and s != s) or rank(s) > rank(r["score"]) or s == r["score"]) and not (s is None and r["score"] is not None))
        assert r["n"] == above


def test_inventory_counts_verified_negatives(spark):
    r = [("w", "weak", False, "d", 3600.0, "s", "2020-01-01"), ("x", "box", True, "d", 3600.0, None, "2020-01-01"), ("n", "negative", True, "e", 1800.0, "s", None), ("q", "box", False, "e", 60.0, "s", None)]
    recordings = spark.createDataFrame(r, "recording_id string, label_kind string, exhaustive boolean, dataset string, duration_s double, site_id string, date string")
    windows = spark.createDataFrame([("w", "A"), ("w", "A"), ("x", None), ("n", None)], "recording_id string, class string")
    inv = catalog.inventory(recordings, windows)
    got = {(x["class"], x["label_kind"]): (x["recordings"], x["hours"], x["windows"], x["sources"], x["no_site"]) for x in inv.collect()}
    assert got == {("A", "weak"): (1, 1.0, 2, "d", 0), ("negative", "negative"): (2, 1.5, 2, "d, e", 1)}
    wide = {x["class"]: (x["weak_rec"], x["weak_win"], x["negative_rec"], x["hours"]) for x in catalog.summary(inv).collect()}
    assert wide == {"A": (1, 2, 0, 1.0), "negative": (0, 0, 2, 1.5)}


def test_focal_lock_and_splits(spark):
    rows = [(f"r{i}", "A", f"g{i % 10}", "2024-05-01" if i % 10 < 8 else "2020-01-01") for i in range(100)] + [(f"s{i}", "B", f"h{i}", "2024-05-01") for i in range(20)] + [("m1", "A", "mixed", "2024-05-01"), ("m2", "B", "mixed", "2024-05-01")]
    units = spark.createDataFrame(rows, "unit_id string, acoustic_class string, split_group string, date string")
    got = [r for r in splits.focal_lock(units, "2024-01-01").collect() if r["locked"]]
    groups = {r["split_group"] for r in got}
    assert len(groups) == 1 and len(got) == 10 and groups <= {f"g{k}" for k in range(8)}  # 15 % of 101 is one group of ten
    manifest = units.select(F.col("unit_id").alias("recording_id"), F.lit("herps").alias("source"), "acoustic_class", "split_group", "date", F.lit(1).alias("fold"))
    clips = spark.createDataFrame([(f"c{i}", "rain") for i in range(10)], "clip_id string, category string")
    built = splits.build_splits(manifest, clips, ["herps"], "aru", "2024-01-01")
    assert built.columns == splits.UNIT_COLUMNS and built.filter("kind = 'background' and locked").count() == 2
    with pytest.raises(Exception, match="unit occurs twice"):
        splits.build_splits(manifest.union(manifest.limit(1)), clips, ["herps"], "aru", "2024-01-01").collect()
    with pytest.raises(Exception, match="without a fold"):
        splits.build_splits(manifest.withColumn("fold", F.lit(-1)), clips, ["herps"], "aru", "2024-01-01").collect()


def test_nulls_are_kept(spark):
    df = spark.createDataFrame([(1, None, "A"), (2, "g", "A"), (3, None, "B"), (4, "g", "B")], "id int, g string, cls string")
    assert splits.group_folds(df, "g", "cls").filter("fold is not null").count() == 4
    assert sorted(r["id"] for r in dedupe.keep_first(df, ["g"], "id").collect()) == [1, 2, 3]
    merged = dedupe.merge_labels(df.withColumn("more", F.array(F.lit("C"))), "g", "cls", "more", "id")
    assert {r["id"]: r["more"] for r in merged.collect()} == {1: ["C"], 2: ["B", "C"], 3: ["C"]}


def test_windows_outside_the_splits_fail(spark):
    labels = spark.createDataFrame([("r1", 0, "A", "pos", [])], "recording_id string, window_idx int, acoustic_class string, state string, masked array<string>")
    none = spark.createDataFrame([], "clip_id string, window_idx int")
    manifest = spark.createDataFrame([("r1", "herps")], "recording_id string, source string")
    units = spark.createDataFrame([("r2", 0, False)], "unit_id string, fold int, locked boolean")
    with pytest.raises(Exception, match="isn't in the splits"):
        pipelines.load_windows(labels, none, manifest, units).collect()


def test_cards_and_readers(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    card = {"name": "d", "kind": "aru", "raw_dir": "x", "reader": "clips", "label_kind": "clip", "license": "open"}
    (tmp_path / "b.yaml").write_text(yaml.safe_dump(card))
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(card | {"name": "e"}))
    assert [c["name"] for c in readers.read_cards(str(tmp_path))] == ["e", "d"]
    with pytest.raises(ValueError, match="reader is odd"):
        readers.check_card(card | {"reader": "odd"})
    (tmp_path / "s.yml").write_text(yaml.safe_dump({"species": [{"code": "X", "scientific": "Rana x", "acoustic_group": "G"}, {"code": "Y", "scientific": "Rana y"}, {"code": "Z", "scientific": "Rana z", "vocal": False}], "groups": [{"code": "G"}]}))
    _, classes = readers.taxonomy(spark, str(tmp_path / "s.yml"))
    assert {tuple(r) for r in classes.collect()} == {("X", "G"), ("Y", "Y"), ("G", "G")}
    (tmp_path / "clips.csv").write_text("clip_id,file,kind,label,code,use,duration_s,sample_rate,site_id,date\nc1,f1,frog,Tree frog,T,yes,3.0,48000,s,2020-01-01\nc2,f2,background,rain,,yes,3.0,48000,s,2020-01-01\nc3,f3,frog,Tree frog,T,frog_present,3.0,48000,s,2020-01-01\n")
    rec, spans = readers.read_dataset(spark, card | {"reader_args": {"table": str(tmp_path / "clips.csv"), "classes": {"T": "TREE"}}})
    assert {(r["recording_id"], r["label_kind"], r["exhaustive"], r["dataset"]) for r in rec.collect()} == {("c1", "clip", False, "d"), ("c2", "negative", True, "d")}
    assert {(r["recording_id"], r["acoustic_class"]) for r in spans.collect()} == {("c1", "TREE"), ("c2", None)}
    names = spark.createDataFrame([("D1_20200102",), ("D9_x",)], "stem string")
    sites = [{"device_id": "D1", "site_id": "s1"}, {"device_id": "D2", "site_id": "s2"}]
    site, date = readers.recorder_names(F.col("stem"), r"^(D\d+)_(\w+)$", sites)
    assert [tuple(r) for r in names.select(site, date).collect()] == [("s1", "2020-01-02"), (None, None)]
    kinds = "strUC string, Presence string, Season string"
    assert tuple(readers.unit_presence(spark.createDataFrame([("u", "Known/extant", "Year-round")] * 2, kinds)).first()) == ("u", "Y")
    with pytest.raises(Exception, match="uncertain presence"):
        readers.unit_presence(spark.createDataFrame([("u", "Known/extant", "Winter"), ("u", "Possibly present", "Winter")], kinds)).collect()
    assert readers.check_ranges({"A": "frog-range-x", "B": {"gap": "id"}}) == {"A": ("cwhr", "frog-range-x"), "B": ("gap", "id")}
    with pytest.raises(ValueError, match="range map"):
        readers.check_ranges({"A": "frog-predicted-habitat"})
