"""The corpus operators against brute force, libraries and edge cases."""

import hashlib
import random
from collections import Counter
from zlib import crc32

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from fieldsense.llm import byte_bpe, components, embedding_neardup, exact_topk, language_id, line_dedup, ngram_jaccard, registry, sharding, source_mixing, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, score double"


def table(spark, rows):
    """Documents (doc_id, text[, lang, source]) with extra columns whose names clash with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 7, "x", 0.5) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, "  \n "), (4, "a"), (4, "a"), (None, "null id"), (5, "word " * 5000), (6, "é漢字😀 x"), (7, "a"), (8, "x" * 20_000)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), oracle.connect(SF), registry.ORACLES[name]) == []


# 1 ---------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rnd, text, n, alphabet):
    out = list(text)
    for _ in range(n):
        i, kind = rnd.randrange(len(out)), rnd.random()
        if kind < 0.4:
            out[i] = rnd.choice(alphabet)
        elif kind < 0.7:
            out.insert(i, rnd.choice(alphabet))
        else:
            del out[i]
    return "".join(out)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(spark, k):
    rnd = random.Random(k)
    rows = []
    for _ in range(400):
        a = "".join(rnd.choice("abé ") for _ in range(rnd.choice([8, 30, 90])))
        b = changed(rnd, a, rnd.randint(0, 5), "abé ")
        if abs(len(a) - len(b)) <= k:
            rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", line_dedup.distance_within(F.col("a"), F.col("b"), k).alias("d")).collect()
    assert all(min(r["d"], k + 1) == min(edits(r["a"], r["b"]), k + 1) for r in got)


def brute_lines(rows, s=line_dedup.Settings()):
    lines = sorted((d, i, t) for d, text in rows if d is not None and text is not None for i, t in enumerate(text.split("\n")) if len(t) >= s.least)
    gone = set()
    for n, (d, i, t) in enumerate(lines):
        for e, j, u in lines[:n]:
            short = min(len(t), len(u))
            if (e, j) != (d, i) and abs(len(t) - len(u)) <= s.edits and edits(t, u) <= min(s.edits, short // s.per_edit):
                gone.add((d, i))
                break
    return gone


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.choice([12, 20, 25, 39, 40, 41, 60, 100]))) for _ in range(12)]
    rows = []
    for d in range(40):
        rows.append((d, "\n".join(changed(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3]), "abcdeé ") for _ in range(rnd.randint(1, 5)))))
    rows += [(100, None), (101, ""), (None, base[0])]
    got = line_dedup.dropped_lines(table(spark, rows)).collect()
    found = {(r["doc_id"], i) for r in got for i in r["dropped"]}
    assert found == brute_lines(rows) and len(found) > 30


def test_line_dedup_of_common_lines(spark, monkeypatch):
    rnd = random.Random(6)
    kinds = ["".join(rnd.choice("abcdefgh ") for _ in range(40)) for _ in range(9)]
    rows = [(d, "\n".join([kinds[0]] + [kinds[rnd.randrange(9)] for _ in range(rnd.randint(0, 4))])) for d in range(200)]
    for common in (1, 3, 10_000):
        monkeypatch.setattr(line_dedup, "COMMON", common)
        found = {(r["doc_id"], i) for r in line_dedup.dropped_lines(table(spark, rows)).collect() for i in r["dropped"]}
        assert found == brute_lines(rows)


def test_line_keys_are_compiled(spark):
    """The JVM only interprets methods of more than 8,000 bytes of code, which took most of the time of the keys."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = line_dedup.candidates(table(spark, [(1, "x" * 50)]), line_dedup.Settings())
        stages = found._jdf.queryExecution().debug().codegenToSeq()
        assert 0 < max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_line_dedup_of_more_edits(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdeé ") for _ in range(n)) for n in (20, 39, 40, 41, 59, 60, 61, 62, 63, 80)]
    rows = [(d, "\n".join(changed(rnd, rnd.choice(base), rnd.choice([0, 1, 2, 3, 4]), "abcdeé ") for _ in range(rnd.randint(1, 4)))) for d in range(60)]
    for edits in (1, 2, 3):
        settings = line_dedup.Settings(edits=edits)
        found = {(r["doc_id"], i) for r in line_dedup.dropped_lines(table(spark, rows), settings).collect() for i in r["dropped"]}
        assert found == brute_lines(rows, settings) and len(found) > 10


def test_line_dedup_stage(spark):
    long = "This line is long enough to be looked at."
    rows = [(1, f"{long}\nshort\n{long}"), (2, f"{long}\nsomething else that is long enough"), (3, long), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup_stage(spark, table(spark, rows), "").collect()}
    assert {k: r["text"] for k, r in got.items()} == {1: f"{long}\nshort", 2: "something else that is long enough", 4: None, 5: ""}
    assert got[2]["n_chars"] == 34
    assert line_dedup.line_dedup_stage(spark, table(spark, []), "").isEmpty()
    line_dedup.dropped_lines(table(spark, ODD)).collect()


# 2 ---------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (300, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, x[51].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, parts array<long>")
    got = exact_topk.top_k(df, F.col("vec_id") % 100 == 0, k=5, block=70, query_block=2).collect()
    for q in (0, 100, 200):
        best = sorted((-int(np.dot(v, x[q])), i) for i, v in rows if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best


def test_top_k_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 0.0]), (1, [0.5, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, -1.0]), (6, [1.0]), (7, [-1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = exact_topk.op2_exact_topk(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(5, 0), (7, 0)]
    assert exact_topk.top_k(spark.createDataFrame([], "vec_id long, parts array<long>"), F.lit(True)).isEmpty()


def test_top_k_of_huge_values_and_clashing_columns(spark, tmp_path):
    rows = [(0, [1e8, -1e8]), (1, [1e8, 0.0]), (2, [-1e30, 1e30]), (3, [1e8, 0.0]), (4, [0.0, 1e-3]), (5, [1.0, 1.0])]
    named = "vec_id long, embedding array<double>, score string, rank string, query_id int, parts int, at int, part string, least int"
    spark.createDataFrame([(*r, "s", "r", 1, 2, 3, "p", 4) for r in rows], named).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = exact_topk.op2_exact_topk(spark, str(tmp_path)).orderBy("rank").collect()
    top, bottom = 2**63 - 1, -(2**63)
    score = {1: (1024 * 10**8) ** 2, 2: bottom, 3: (1024 * 10**8) ** 2, 4: -(1024 * 10**8), 5: 0}
    expected = sorted(((-min(max(s, bottom), top), i) for i, s in score.items()))
    assert [(-r["score"], r["vec_id"]) for r in got] == expected and got[0]["score"] == top


@pytest.mark.parametrize("block,query_block", [(10_000, 4096), (90, 3), (17, 1)])
def test_top_k_with_shared_bounds(spark, block, query_block):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-900, 900, (400, 8)), np.tile(rng.integers(-900, 900, (1, 8)), (60, 1))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, parts array<long>")
    got = exact_topk.top_k(df, F.col("vec_id") % 50 == 0, k=10, block=block, query_block=query_block).collect()
    for q in range(0, 460, 50):
        best = sorted((-int(x[i] @ x[q]), i) for i in range(len(x)) if i != q)[:10]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best


# 3 ---------------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    got = registry.QUERIES["op3_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    odd = language_id.identify(table(spark, [(i, t, "en") for i, t, *_ in ODD] + [(90, "123 456", None)]), held_out).collect()
    assert len(odd) == len(ODD) + 1 and {r["doc_id"]: r["lang_pred"] for r in odd}[90] == "und"
    assert language_id.identify(table(spark, []), held_out).isEmpty()
    none = language_id.identify(table(spark, [(1, "text", None)]).withColumn("lang", F.lit(None).cast("string")), held_out).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)


def test_language_sample_is_that_of_lowest_hashes(spark):
    """Of many ids, one of them with most of the rows and some with two languages, against sorting all of them."""
    rows = [(i, f"text {i}", "en" if i % 7 else "de") for i in range(4000)] + [(11, "text 11", "en")] * 3000
    rows += [(i, f"other {i}", "fr") for i in range(0, 4000, 50)] + [(9000, "alone", "pt")]
    s = language_id.Settings(per_language=20, texts=50)
    docs = table(spark, rows).repartition(9)
    packed, names = language_id.training_flags(docs, docs, s)
    first = {}
    for i, _, lang in rows:
        first[i] = min(lang, first.get(i, lang))
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    places = []
    for lang in set(first.values()):
        ids = sorted((i for i in first if first[i] == lang), key=lambda i: (hashes[i], i))
        places += [(place, lang, i) for place, i in enumerate(ids[:20])]
    chosen = sorted(places)[:50]
    assert names == [lang for _, lang, _ in chosen]
    text = {(i, lang): t for i, t, lang in rows}
    for got, (_, lang, i) in zip(packed, chosen, strict=True):
        row = np.zeros(language_id.WIDTH, np.uint8)
        language_id.presence(text[i, lang], row)
        assert got == np.packbits(row).tobytes()


def test_language_scores_equal_the_kernel_matrix():
    """The one matrix of n-grams by languages against kernel values between texts, landmarks and training texts."""
    rnd, s = random.Random(3), language_id.Settings(landmarks=12)
    words = {"aa": ["der", "und", "nicht", "ich"], "bb": ["the", "and", "not", "which"], "cc": ["les", "est", "pas", "que"]}
    texts = [(x, " ".join(rnd.choice(words[x]) for _ in range(12))) for x in words for _ in range(10)]

    def grams(text):
        row = np.zeros(language_id.WIDTH, np.uint8)
        language_id.presence(text, row)
        at = language_id.STARTS
        return [set(np.flatnonzero(row[a:b]).tolist()) for a, b in zip(at, at[1:])]

    def kernel(x, y):
        return np.mean([len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0.0 for a, b in zip(grams(x), grams(y))])

    packed = []
    for _, t in texts:
        row = np.zeros(language_id.WIDTH, np.uint8)
        language_id.presence(t, row)
        packed.append(np.packbits(row).tobytes())
    names, matrix, intercept = language_id.fit(packed, [x for x, _ in texts], s)
    marks = [t for x in names for t in [t for y, t in texts if y == x][: s.landmarks // len(names)]]
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.array([[kernel(t, m) for m in marks] for _, t in texts]) @ root
    y = np.array([[float(x == n) for n in names] for x, _ in texts])
    centred = features - features.mean(0)
    solved = np.linalg.solve(centred.T @ centred + s.ridge * len(texts) / 100 * np.eye(centred.shape[1]), centred.T @ (y - y.mean(0)))
    for t in ("nicht und the", "est que pas les", "zz 12"):
        expected = (np.array([kernel(t, m) for m in marks]) @ root - features.mean(0)) @ solved + y.mean(0)
        row = np.zeros((1, language_id.WIDTH), np.uint8)
        language_id.presence(t, row[0])
        assert (language_id.scaled(row) @ matrix + intercept)[0] == pytest.approx(expected, abs=2e-3)


# 4 ---------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rnd = random.Random(2)
    alphabet = list(" \n\t'sABéÉ漢1²!?.\x1c\x85 ​́Σς😀") + ["<|endoftext|>", "<|startoftext|>", "hello", "  "]
    rows = ODD + [(1000 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))) for i in range(500)]
    got = token_counts.count_tokens(table(spark, rows), path, batch_bytes=500, call_bytes=100).collect()
    library = Tokenizer.from_file(path)
    expected = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.count_tokens(table(spark, []), path).isEmpty()


def test_token_counts_with_added_strings(spark, tmp_path):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.add_tokens(["New York"])
    tokenizer.add_special_tokens([AddedToken("<end of text>", special=True)])
    tokenizer.save(path := f"{tmp_path}/added.json")
    rows = ODD + [(20, "in New York <end of text> and New  York"), (21, "New York")]
    got = token_counts.count_tokens(table(spark, rows), path).collect()
    want = [(r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter(want)
    assert not token_counts.splits_at_white_space(tokenizer) and token_counts.splits_at_white_space(Tokenizer.from_file(P.path("word_bpe_49k.json")))


@pytest.mark.parametrize("name,splits", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_token_counts_of_vocabularies_that_cross_white_space(spark, name, splits):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(name))
    assert token_counts.splits_at_white_space(library) == splits
    rows = ODD + [(20, "Hello  world, this\n\n is a text   with spaces ")]
    got = token_counts.count_tokens(table(spark, rows), P.path(name), call_bytes=30).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)


# 5 ---------------------------------------------------------------------------------------------------------------


def near(x, threshold=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T >= threshold
    np.fill_diagonal(s, False)
    return s


def clustered(rng, centres, copies, size, noise):
    middle = rng.normal(size=(centres, size))
    return np.concatenate([middle, middle[rng.integers(0, centres, copies)] + rng.normal(0, noise, (copies, size))])


def test_embedding_recall_and_blocks(spark):
    rng = np.random.default_rng(3)
    x = clustered(rng, 150, 500, 16, 0.12)
    x = np.concatenate([x, np.repeat(x[:1], 40, axis=0), x[1:2] + rng.normal(0, 0.02, (300, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    settings = embedding_neardup.Settings(leaf=60, block=50, levels=2, task_rows=100)
    got = {r["vec_id"]: r for r in embedding_neardup.near_duplicates(df, settings).collect()}
    links = near(x)
    found = sum(r["n_links"] for r in got.values())
    assert 0.97 * links.sum() <= found <= links.sum()
    assert all(got[i]["n_links"] <= links[i].sum() for i in range(len(x)))
    assert all(r["kept"] == (r["component_id"] == i) and r["component_id"] <= i for i, r in got.items())


def test_embedding_leaves_stay_small(spark):
    rng = np.random.default_rng(4)
    settings, worst = embedding_neardup.Settings(leaf=50, levels=3), []
    for n in (1500, 6000):  # 6 and 9 levels
        x = clustered(rng, n // 2, n // 2, 32, 0.2)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rid long, embedding array<double>")
        assert embedding_neardup.levels_of(n, settings) >= 5
        sizes = [r["count"] for r in embedding_neardup.forest(df, n, settings).distinct().groupBy("leaf").count().collect()]
        worst.append(max(sizes))
    assert max(worst) <= 3 * settings.leaf
    got = {r["vec_id"]: r["n_links"] for r in embedding_neardup.near_duplicates(df.withColumnRenamed("rid", "vec_id"), settings).collect()}
    links = near(x)
    assert 0.97 * links.sum() <= sum(got.values()) <= links.sum() and links.sum() > 1000


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(5, [1.0, 0.0]), (3, [2.0, 0.0]), (9, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (4, [nan, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0])]
    named = "vec_id long, embedding array<double>, rid long, leaf string, copies int, h1 string, component double, done int"
    df = spark.createDataFrame([(*r, 1, "x", 2, "y", 0.5, 3) for r in rows], named)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_neardup.near_duplicates(df).collect()}
    assert got == {5: (2, 3), 3: (2, 3), 9: (2, 3), 1: (0, 1), 2: (0, 2), 4: (0, 4), 6: (0, 6), 7: (0, 7), None: (0, None), 8: (0, 8)}
    assert embedding_neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    twice = [(3, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [-1.0, 0.0])]
    got = embedding_neardup.near_duplicates(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["component_id"]) for r in got} == {(3, 3), (4, 3), (5, 3), (6, 6)}


# 6 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets = {}
    for d, text in rows:
        words = bytes(text or "", "utf8").lower().split()
        n = max(1, len(words) - k + 1) if words else 0
        sets.setdefault(d, []).append({tuple(words[i : i + k]) for i in range(n)})
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, k, percent):
    rnd = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([2, 6, 20, 60, 150]))] for _ in range(25)]
    rows = []
    for d in range(220):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((d, " ".join(words).upper() if d % 3 else "\t".join(words)))
    rows += [(900, None), (901, ""), (902, " \n")]
    got = ngram_jaccard.near_duplicates(table(spark, rows), ngram_jaccard.Settings(words=k, percent=percent, noted=1, frequent=50)).collect()
    expected = brute_components(rows, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == expected and len(set(expected.values())) < 200


def triples(n, seed, settings):
    """Rows (id, text) of A, B, C: sets of n shingles with one prefix, of which only B and C are similar enough, A first."""
    rnd, shingle, none = random.Random(seed), ngram_jaccard.Shingler(settings.words), np.zeros(0, np.uint64)
    for at in range(4):
        while True:
            words = [f"t{seed}x{n}x{at}w{rnd.randrange(10**9)}" for _ in range(n + settings.words - 1)]
            off = next(m for m in range(1, n) if 100 * (n - m) < settings.percent * (n + m))
            texts = [[f"other{w}" for w in words[:off]] + words[off:], words, words[:-1] + ["end"]]
            found = {tuple(ngram_jaccard.prefix(shingle(" ".join(t)), none, none, settings.percent)) for t in texts}
            if len(found) == 1:
                break
        yield from ((n * 100 + at * 10 + i, " ".join(t)) for i, t in enumerate(texts))


def test_ngram_join_links_inside_a_prefix_group(spark):
    settings = ngram_jaccard.Settings(words=3, percent=90, frequent=0)
    rows = [r for n in (20, 33, 60) for r in triples(n, 3, settings)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.near_duplicates(table(spark, rows), settings).collect()}
    assert got == brute_components(rows, 3, 90) and all(got[d] == d - d % 10 + (d % 10 > 0) for d in got)


def families(seed, n):
    """Rows (id, text) of near-copy families whose members differ at the ends and in the middle, and ids that repeat."""
    rnd, rows = random.Random(seed), []
    for at in range(n):
        base = [f"f{at}w{rnd.randrange(10**6)}" for _ in range(rnd.choice([15, 60, 100]))]
        for _ in range(rnd.choice([3, 4, 6])):
            words = list(base)
            for _ in range(rnd.choice([1, 2, 3])):
                words[rnd.choice([0, 1, len(words) // 2, -1, -2])] = f"n{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(rnd.randrange(len(rows)), rows[rnd.randrange(len(rows))][1]) for _ in range(n // 4)]


@pytest.mark.parametrize("parts,many", [(1, 64), (4, 64), (16, 1)])
def test_ngram_join_is_the_same_however_rows_are_dealt(spark, parts, many):
    rows = families(1, 200)
    got = ngram_jaccard.near_duplicates(table(spark, rows).repartition(parts), ngram_jaccard.Settings(many=many)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 3, 90)


def test_ngram_join_of_a_triple_in_partitions_of_its_own(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [["a", "b", "c", "d", *words[4:]], words, [*words[:-1], "z"]]
    rows = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    got = ngram_jaccard.near_duplicates(table(spark, rows).repartitionByRange(4, "doc_id")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 3, 90) == {1: 1, 2: 2, 3: 2}


def crowded_element(settings, decoys=68):
    """Rows (id, text): `decoys` texts, g, x and y of which all hold one shingle in their prefix. g and x have one prefix and
    little else in common; y is x without its first words, and the second element that it shares with x isn't in g."""
    k, n, rnd, shingle = settings.words, 20, random.Random(settings.words), ngram_jaccard.Shingler(settings.words)
    shared = n - -(-settings.percent * n // 100)  # of the prefix of n - ceil(t n) + 1, all but the crowded one lead

    def longer(words, low):
        while True:
            more = [*words, f"w{rnd.randrange(10**9)}"]
            if len(more) < k or (int(shingle(" ".join(more[-k:]))[0]) < 2**64 // 50) == low:
                return more

    def crowded():
        while True:
            words = [f"t{rnd.randrange(10**9)}" for _ in range(k)]
            if int(shingle(" ".join(words))[0]) < 2**64 // 50:
                return words

    t = crowded()

    def text(start):
        while True:
            words = list(start)
            while len(words) < 12:
                words = longer(words, False)
            words += t
            while len(words) < n + k - 1:
                words = longer(words, False)
            if (np.sort(shingle(" ".join(words))) < 2**64 // 50).sum() == 1 + max(0, len(start) - k + 1):
                return words

    head = []
    while len(head) < shared + k - 1:
        head = longer(head, True)
    x = text(head)
    return [(i + 1, " ".join(text([]))) for i in range(decoys)] + [(1000, " ".join(text(head))), (1001, " ".join(x)), (1002, " ".join(x[shared:]))]


@pytest.mark.parametrize("parts", [1, 71])
@pytest.mark.parametrize("many", [1, 64])
@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_ngram_join_takes_the_second_element_from_each_member(spark, k, percent, many, parts):
    settings = ngram_jaccard.Settings(words=k, percent=percent, many=many)
    rows = crowded_element(settings)
    expected = brute_components(rows, k, percent)
    assert [expected[i] for i in (1000, 1001, 1002)] == [1000, 1001, 1001] and len(set(expected.values())) == 70
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.near_duplicates(docs, settings).collect()} == expected


def test_ngram_join_of_an_id_with_several_texts(spark):
    rows = [(3, "a b c d"), (4, "a b c d"), (4, "e f g h"), (5, "e f g h"), (6, "i j k l")]
    got = ngram_jaccard.near_duplicates(table(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 3, 90) == {3: 3, 4: 3, 5: 3, 6: 6}


def test_pairs_of_a_hub_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "PAIRS_TOGETHER", 10)
    pairs, ids = ngram_jaccard.dealt(spark.createDataFrame([(0, b) for b in range(1, 100)] + [(1, 2)], "a long, b long"))
    sizes = pairs.filter("a = 0").groupBy("part").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 25
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    both = ngram_jaccard.beside(pairs, ids, docs, "doc_id", ["text"]).collect()
    assert Counter((r["a"], r["b"], r["text_a"], r["text_b"]) for r in both) == Counter([(0, b, "t0", f"t{b}") for b in range(1, 100)] + [(1, 2, "t1", "t2")])


def test_ngram_edges(spark):
    got = ngram_jaccard.near_duplicates(table(spark, ODD)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (None, None), (5, 5), (6, 6), (7, 4), (8, 8)])
    assert ngram_jaccard.near_duplicates(table(spark, [])).isEmpty()
    kept = ngram_jaccard.near_duplicates_stage(spark, table(spark, ODD), "")
    assert kept.columns == ngram_jaccard.DOCUMENT_COLUMNS
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, 5, 6, 8]))
    assert ngram_jaccard.near_duplicates_stage(spark, table(spark, []), "").isEmpty()


def test_ngram_stage_decides_by_row(spark):
    x, y = "one two three four five six seven", "red green blue black white grey brown"
    rows = [(1, x), (1, x), (9, x), (9, y), (9, ""), (9, ""), (9, None), (12, y), (12, " "), (None, x)]
    kept = ngram_jaccard.near_duplicates_stage(spark, table(spark, rows), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, x), (9, y), (9, ""), (9, ""), (9, None), (12, " "), (None, x)])


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(-(2**63), 2**63 - 1), (2**63 - 1, 7 * 2**60)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if k in got} and set(label) - set(got) <= {a for a, b in pairs if a == b}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 7 ---------------------------------------------------------------------------------------------------------------


def test_sharding(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(900)] + [(3, "text 3"), (3, "other"), (None, None), (-5, "")]
    records = table(spark, rows).select("doc_id", "text", "shard", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    run = lambda n: sharding.two_pass_shuffle(records, "doc_id", "size", n_shards=n, bucket_bytes=100)
    one = run(6).collect()
    assert Counter((r["doc_id"], r["text"]) for r in one) == Counter(rows)
    for s in range(6):
        assert sorted(r["slot"] for r in one if r["shard"] == s) == list(range(sum(r["shard"] == s for r in one)))
    assert sorted(map(repr, one)) == sorted(map(repr, run(6).collect()))
    seven = {r["doc_id"]: r["shard"] for r in run(7).collect()}
    assert all(seven[r["doc_id"]] == r["grown_shard"] in (r["shard"], 6) for r in one)
    sharding.write_shards(run(6), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert sharding.two_pass_shuffle(records.limit(0), "doc_id", "size").isEmpty()
    order = [r["doc_id"] for r in sorted((r for r in one if r["shard"] == 0 and r["doc_id"] is not None), key=lambda r: r["slot"])]
    assert order != sorted(order)


def test_sharding_order_is_the_sessions_business_no_longer(spark):
    records = table(spark, [(i, f"text {i}") for i in range(500)]).select("doc_id", "text", F.octet_length("text").cast("long").alias("size"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, sharding.two_pass_shuffle(records.repartition(3 if n == "4" else 5), "doc_id", "size", n_shards=5, bucket_bytes=300).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_sharding_writes_whole_documents(spark):
    small = "/root/testdata/sf0.001"
    result = sharding.op7_sharding(spark, small)
    files = result.inputFiles()
    assert files and all("/shard=" in f and "/bucket=" in f for f in files)
    written, docs = spark.read.parquet(files[0].split("/shard=")[0]), spark.read.parquet(f"{small}/documents.parquet")
    assert written.select(docs.columns).exceptAll(docs).isEmpty() and docs.exceptAll(written.select(docs.columns)).isEmpty()
    digests = {(r["shard"], r["slot"]): (r["doc_id"], r["size"], r["text_crc32"]) for r in result.collect()}
    rows = {(r["shard"], r["slot"]): (r["doc_id"], len((r["text"] or "").encode()) + 8, crc32((r["text"] or "").encode())) for r in written.collect()}
    assert digests == rows and len(rows) == docs.count()
    for f in files:
        slots = [r["slot"] for r in spark.read.parquet(f).collect()]
        assert slots == sorted(slots)


# 8 ---------------------------------------------------------------------------------------------------------------


def test_toxicity_pairs_and_held_out(spark, tmp_path):
    rnd = random.Random(6)
    filler = [f"plain{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        words = [rnd.choice(filler) for _ in range(30)]
        kind = i % 6
        words += {0: ["insultix", "groupa"], 1: ["insultix"], 2: ["groupa"]}.get(kind, [])
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(kind == 0)))
    table(spark, docs + [(9000, None), (9001, "")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    assert all(r["held_out"] == (crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for k, r in got.items())
    held = [k for k, r in got.items() if r["held_out"] and k < 9000]
    assert np.mean([got[k]["predicted"] == (k % 6 == 0) for k in held]) > 0.95  # neither word alone says it
    stage = toxicity.toxicity_stage(spark, table(spark, docs), str(tmp_path)).count()
    assert stage == sum(1 for k, r in got.items() if k < 9000 and not r["predicted"])


def test_toxicity_scores_equal_the_double_loop(spark):
    rng, s = np.random.default_rng(2), toxicity.Settings(bits=10, factors=3)
    buckets = sorted(set(np.concatenate([toxicity.text_buckets(w, s.bits) for w in ("insult", "group", "plain", "filler")]).tolist()))
    model = toxicity.Machine({b: i for i, b in enumerate(buckets)}, -0.3, rng.normal(size=len(buckets)), rng.normal(size=(len(buckets), 3)))
    rows = [(1, "insult the group"), (2, "plain"), (3, ""), (4, None), (5, "Insult, insult! FILLER " * 4000), (6, "\U0001f600 group")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, rows), model, s, ("doc_id",)).collect()}
    for i, text in rows:
        present = [model.place[b] for b in toxicity.text_buckets(text, s.bits).tolist() if b in model.place]
        raw = model.bias + sum(model.linear[k] for k in present)
        raw += sum(float(model.pairs[k] @ model.pairs[m]) for x, k in enumerate(present) for m in present[x + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_toxicity_sample_and_empty_table(spark):
    docs = table(spark, [(i, f"word{i % 7} text") for i in range(400)] + [(5, "other text of an id")] * 30)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    seen = []
    for parts in (1, 5):
        model = toxicity.train(docs.repartition(parts), labels.repartition(parts), F.lit(True), toxicity.Settings(per_label=40))
        seen.append((model.bias, model.linear.tolist()))
    assert seen[0] == seen[1]
    model = toxicity.train(table(spark, []), labels.limit(0), F.lit(True), toxicity.Settings())
    assert toxicity.score(table(spark, []), model, toxicity.Settings(), ("doc_id",)).isEmpty()


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    settings = toxicity.Settings()
    model = toxicity.train(table(spark, ODD), labels, F.lit(True), settings)
    assert {r["score"] < 0.01 for r in toxicity.score(table(spark, ODD), model, settings, ("doc_id",)).collect()} == {True}


# 9 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = byte_bpe._ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(spark, reference):
    rnd = random.Random(8)
    alphabet = list(" \n\t  ''sstdmrevllaBé漢字1²٣!?., ​́\x1c\x85😀")
    rows = ODD + [(1000 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50)))) for i in range(800)]
    got = byte_bpe.encode(table(spark, rows), P.path("byte_bpe_multi_50k.tiktoken"), outputs=tuple(byte_bpe.OUTPUTS), batch_chars=300).collect()
    expected = Counter((d, tuple(reference.encode_ordinary(t or ""))) for d, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expected
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest() and r["offsets"][-1] == len(r["decoded"])
    texts = Counter((d, (t or "").encode()) for d, t, *_ in rows)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in got) == texts
    assert byte_bpe.encode(table(spark, []), P.path("byte_bpe_multi_50k.tiktoken")).isEmpty()


def test_long_pieces(reference):
    rnd = random.Random(9)
    codec = byte_bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"))
    for text in ("a" * 5000, "".join(rnd.choice("abcdeé") for _ in range(3000)), "!" * 700):
        assert next(iter(codec.encode([text]))) == reference.encode_ordinary(text)


# 10 --------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    rest, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: cap * sizes[s] for s in over}
        rest -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def test_mixing(spark):
    rnd = random.Random(10)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 5, 40, 300])), "en", rnd.choice(["a", "a", "a", "é", "b", None, "Z"])) for i in range(600)]
    rows += [(1000, None, "en", "empty"), (1001, "", "en", "b"), (3, rows[3][1], "en", rows[3][3]), (None, "x y", "en", "a")]
    got = source_mixing.mix(source_mixing.measured(table(spark, rows))).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    targets = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - t) <= max(5, 0.01 * t) for s, t in targets.items())
    for s in targets:  # rates tilt with size, and their tokens meet the target
        rates = sorted({(r["size"], r["rate"]) for r in got if r["source"] == s and r["size"]})
        assert sum(r["rate"] * r["size"] for r in got if r["source"] == s) == pytest.approx(targets[s], rel=1e-3, abs=1)
        assert rates == sorted(rates, key=lambda x: x[1]) or rates == sorted(rates, key=lambda x: -x[1])
    again = source_mixing.mix(source_mixing.measured(table(spark, rows).repartition(7))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert source_mixing.mix(source_mixing.measured(table(spark, []))).isEmpty()
    odd = source_mixing.mix(source_mixing.measured(table(spark, ODD + [(30, "w " * 300_000)]))).collect()
    assert {r["doc_id"]: r["size"] for r in odd}[30] == 300_000 and all(r["copies"] == 0 for r in odd if r["size"] == 0)


def test_mixing_large_sources_and_stage(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 200)), "en", "ab"[i % 3 == 0]) for i in range(1500)]
    for together in (20, 100, 5000):
        got = source_mixing.mix(source_mixing.measured(table(spark, rows)), together=together).collect()
        for s in "ab":
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 200
    copies = Counter({r["doc_id"]: r["copies"] for r in got})
    stage = source_mixing.mix_stage(spark, table(spark, rows + [(5, rows[5][1], "en", rows[5][3])]), "")
    assert stage.columns == source_mixing.DOCUMENT_COLUMNS
    counted = Counter(r["doc_id"] for r in stage.collect())
    assert sum(counted[k] == v for k, v in copies.items()) > 1400 and counted[5] >= 1
