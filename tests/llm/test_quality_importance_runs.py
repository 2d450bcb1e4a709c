"""Quality rules, importance resampling and periodic runs against brute force and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, ODD, table

from fieldsense.llm import importance, periodic_runs, quality_rules

LONG = [(30, "w " * 300_000), (31, "one two three four five six " * 3), (32, "# * $ % & | < >"), (33, "a\r\nb\x0b c\x0cd\te\x1cf"), (33, "another text of one id")]


def same_rows(got, want):
    order = lambda rows: sorted(rows, key=repr)
    assert order(map(tuple, got)) == order(want)


# 11 --------------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside), sum(a == b for a, b in zip(words, words[1:], strict=False))


def test_quality_counts_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        alphabet = rnd.choice(["ab", "abcdefgh", "éß漢a"])
        pieces = [rnd.choice(["x#", "*", "<b>", "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 2)))]) for _ in range(rnd.randint(0, 60))]
        text = "".join(p + rnd.choice([" ", "  ", "\n", "\t", "\r\n"]) for p in pieces)
        assert quality_rules.counts(text) == plain_counts(text)


def test_repeated_windows_of_many_words():
    # More than 2^12 different words don't fit five to an integer and are made dense on the way.
    words = [str(i).encode() for i in range(9000)]
    assert quality_rules.repeat_words(words + words[100:107]) == 14


@pytest.mark.parametrize("v", [0, 1, 127, 128, 129, 255, 256, 1000, 65_535, 10**12])
def test_quality_buckets(spark, v):
    b = spark.range(1).select(quality_rules.bucket(F.lit(v).cast("long")).alias("b"))
    low, high = b.select(*(c.alias(s) for c, s in zip(quality_rules.bounds(F.col("b")), "lh", strict=True))).first()
    assert low <= v <= high and (high - low) * 64 <= max(v, 1)
    after = spark.range(1).select(quality_rules.bucket(F.lit(high + 1).cast("long")).alias("a")).first()[0]
    assert after == b.first()[0] + 1


def quantile_bounds(values, percent):
    """Of the value at a rank, the range of integers that share its first seven bits."""
    values = sorted(values)
    v = values[-(-percent * len(values) // 100) - 1]
    shift = max(0, v.bit_length() - 7)
    return (v >> shift) << shift, ((v >> shift) << shift) + (1 << shift) - 1


def judged_by_hand(rows, least, reach=3):
    measured = [(r[0], r[2], r[3], plain_counts(r[1])) for r in rows]
    at = dict(zip(quality_rules.COUNTS, range(7), strict=True))
    base = lambda m: m[3][0] < 10 or 100 * m[3][5] > 20 * m[3][0]
    good = [m for m in measured if not base(m)]
    out = []
    for m in measured:
        broken = "base" if base(m) else None
        group = [x for x in good if x[1:3] == m[1:3]]
        for near in (lambda x: x[1] == m[1], lambda x: True):
            if len(group) < least:
                group = list(filter(near, good))
        for rule in () if broken else quality_rules.RULES:
            value = lambda x: 1000 * x[3][at[rule.part]] // x[3][at[rule.whole]] if x[3][at[rule.whole]] else 0  # noqa: B023, E731
            low, high = quantile_bounds(map(value, group), 25)[0], quantile_bounds(map(value, group), 75)[1]
            spread = reach * (high - low) + rule.margin
            if value(m) > high + spread or (rule.low and value(m) < low - spread):
                broken = rule.name
                break
        out.append((m[0], broken, broken is None))
    return out


def corpus(rnd, n=260):
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(5, 60))]
        if rnd.random() < 0.1:
            words = [w + "###" for w in words]
        if rnd.random() < 0.05:
            words = [w for w in words[: len(words) // 3] for _ in range(3)]
        if rnd.random() < 0.05:
            words = [w * 4 for w in words]
        text = " ".join(words[:20]) + "\n" + " ".join(words[20:])
        rows.append((i, text, rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "a", "a", "b", None])))
    return rows


@pytest.mark.parametrize("least", [1, 20, 70, 1000])
def test_quality_verdicts_equal_brute_force(spark, least):
    rows = corpus(random.Random(least)) + [(900, None, "xx", "none"), (901, "too short", None, "alone")]
    got = quality_rules.judge(quality_rules.measure(table(spark, rows)), least=least)
    same_rows(got.select("doc_id", "broken", "kept").collect(), judged_by_hand(rows, least))
    assert {r["broken"] for r in got.collect()} >= {None, "base", "symbols", "word_length"}


def test_quality_without_broadcast_and_however_dealt(spark, monkeypatch):
    docs = table(spark, corpus(random.Random(8)))
    want = sorted(map(tuple, quality_rules.quality(docs).collect()), key=repr)
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, quality_rules.quality(docs.repartition(7)).collect()), key=repr) == want


def test_quality_edges(spark):
    rows = ODD + LONG
    got = quality_rules.quality(table(spark, rows)).collect()
    same_rows([(r["doc_id"], *(r[c] for c in quality_rules.COUNTS)) for r in got], [(r[0], *plain_counts(r[1])) for r in rows if r[0] != 30] + [(30, *plain_counts(LONG[0][1]))])
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 10)
    empty = quality_rules.quality(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and {"kept", "base_failed"} <= set(empty.columns)


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    got = quality_rules.quality(read("documents").select("doc_id", "text", "lang", "source")).join(read("labels"), "doc_id")
    share = {r["quality"]: r["share"] for r in got.filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.99 and share.get(0, 0.0) < 0.05


# 12 --------------------------------------------------------------------------------------------------------------


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def resampled_by_hand(docs, target, n=2, buckets=10_000, least=20, percent=25, seed=7):
    def of(text):
        w = lowered(text)
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    measured = [(i, *of(t)) for i, t in docs]
    s, t = Counter(b for m in measured for b in m[2]), Counter(b for x in target for b in of(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + float(buckets)) / ((s[b] + 1.0) * (t.total() + float(buckets))))) for b in s}
    out = []
    for i, words, f in measured:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), None])
    drawn = sorted((r for r in out if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[5] = k + 1
    return list(map(tuple, out))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ring_is_the_crc_of_every_run(n):
    words = "the quick brown fox é 漢字 1 a".encode().split()
    want = [crc32(b" ".join(words[e - k : e])) for e in range(1, len(words) + 1) for k in range(1, min(n, e) + 1)]
    assert list(importance.ring(words, n)) == want


@pytest.mark.parametrize(("n", "buckets"), [(2, 10_000), (3, 100_000), (1, 5)])
def test_resampling_equals_brute_force(spark, n, buckets):
    rnd = random.Random(n)
    word = lambda: rnd.choice(["The", "a1", "é-b", "x_y", "Z", "don't", "漢字"])
    rows = [(rnd.randrange(10**9), " ".join(word() for _ in range(rnd.randint(0, 60)))) for _ in range(300)] + [(5, None), (6, ""), (7, "!!")]
    target = [" ".join(word() for _ in range(30)) for _ in range(5)] + [None, ""]
    settings = importance.Settings(words=n, buckets=buckets, least_words=10, percent=30)
    got = importance.resample(table(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), settings)
    same_rows(got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect(), resampled_by_hand(rows, target, n, buckets, 10, 30))


def test_resampling_edges(spark):
    rows = [r[:2] for r in ODD + LONG]
    target = spark.createDataFrame([("a word",)], "text string")
    settings = importance.Settings(least_words=1, percent=50)
    got = importance.resample(table(spark, rows), target, settings)
    same_rows(got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect(), resampled_by_hand(rows, ["a word"], least=1, percent=50))
    empty = importance.resample(spark.createDataFrame([], DOCS), target)
    assert empty.collect() == []
    # An empty target is allowed by the smoothing; half of the ten rows with words are drawn.
    assert importance.resample(table(spark, rows), target.limit(0), settings).filter("rank is not null").count() == 5


def test_resampling_prefers_the_target(spark):
    rnd = random.Random(1)
    text = lambda alphabet: " ".join(rnd.choice(alphabet) for _ in range(40))
    rows = [(i, text("abcdefgh" if i % 4 else "stuvwxyz")) for i in range(400)]
    target = spark.createDataFrame([(text("stuvwxyz"),) for _ in range(50)], "text string")
    drawn = [r["doc_id"] for r in importance.resample(table(spark, rows), target).filter("rank is not null").collect()]
    assert len(drawn) == 100 and sum(i % 4 == 0 for i in drawn) > 80


# 13 --------------------------------------------------------------------------------------------------------------


def plain_runs(words, least=6, exponent=4):
    out, seen, n = [], set(), len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (10, 3)])
def test_runs_equal_brute_force(least, exponent):
    rnd = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            letters = rnd.choice([1, 2, 2, 3, 6, 30])
            words = [rnd.randrange(letters) for _ in range(rnd.randint(0, 70))]
            texts.append(periodic_runs.tiled(words, 10 * rnd.randrange(10_000)) if rnd.random() < 0.5 else words)
        got = periodic_runs.runs_together(texts, periodic_runs.Settings(least, exponent))
        assert got == [plain_runs(t, least, exponent) for t in texts]


def test_runs_of_long_periodic_texts():
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 3000:
        before, fibonacci = fibonacci, fibonacci + before
    texts = [["w"] * 20_000, fibonacci, [str(i % 2500) for i in range(12_000)], [str(i) for i in range(30_000)]]
    got = periodic_runs.runs_together(texts)
    assert got[0] == [(0, 20_000, 1)] and got[1] == plain_runs(fibonacci) and got[2] == [(0, 12_000, 2500)] and got[3] == []


def test_many_changes_and_few_give_the_same_squares(monkeypatch):
    rnd = random.Random(4)
    texts = [[rnd.randrange(2) for _ in range(500)] for _ in range(4)]
    want = [plain_runs(t) for t in texts]
    for bulk in (0, 3, 10**9):
        monkeypatch.setattr(periodic_runs.Squares.__init__, "__defaults__", (bulk,))
        assert periodic_runs.runs_together(texts) == want


def found_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words) if len(set(words)) > 1 else [(0, n, 1)] * (n >= 6)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines, kept = "".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(lines), digest(kept))


@pytest.mark.parametrize("together", [1, 100, 200_000])
def test_periodic_runs_query(spark, tmp_path, monkeypatch, together):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 80)))) for i in range(300)] + [r[:2] for r in ODD + LONG]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(periodic_runs.find_runs, "__defaults__", (periodic_runs.Settings(together=together), periodic_runs.find_runs.__defaults__[1]))
    got = periodic_runs.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    same_rows(got.collect(), [found_by_hand(*r) for r in rows])


def test_periodic_runs_of_nothing(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], DOCS)).collect() == []

