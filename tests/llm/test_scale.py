"""Weighted similarity, spans and entropy against plain Python, very long texts, repeated rows, and empty tables of the last operators."""

import math
import random
import string
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from causeway.llm import language, minhash, pii, secrets, simhash, spans, urls
from causeway.llm.tokens import PieceTokenizer, vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(texts, weight):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            common, every = sum(map(weight, sets[i] & sets[j])), sum(map(weight, sets[i] | sets[j]))
            if texts[i] == texts[j] or (every and common >= 0.8 * every):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("weigh", ["letters", "even"])
def test_probability_jaccard_of_weighted_shingles(spark, weigh):
    """Short and very long words, edits, and passages that one copy repeats 300 times."""
    rng, texts = random.Random(7), []
    vocabulary_ = [f"{rng.choice(string.ascii_lowercase)}{k}" + "x" * rng.choice([0, 0, 2, 40]) for k in range(400)]
    for _ in range(16):
        base = [rng.choice(vocabulary_) for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(base))
        for _ in range(3):
            edited = list(base)
            for _ in range(rng.randrange(8)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary_)
            at = rng.randrange(len(edited) - 30)
            texts.append(" ".join(edited[: at + 20] + edited[at : at + 20] * rng.choice([0, 300]) + edited[at + 20 :]))
    weight = (lambda s: int(64 * math.log2(1 + sum(map(len, s))))) if weigh == "letters" else (lambda s: 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, weigh=weigh).collect()} == classes(texts, weight)


def test_registers_estimate_the_probability_jaccard():
    rng = np.random.default_rng(3)
    a, b = (np.unique(rng.integers(0, 900, 700)).astype(np.uint64) for _ in range(2))
    weight = lambda x: (x % np.uint64(7) + np.uint64(1)).astype(np.float64)
    both = minhash.signatures(np.repeat([0, 1], [len(a), len(b)]), minhash.mixed(np.r_[a, b]), weight(np.r_[a, b]), 2, 4096)
    want = weight(np.intersect1d(a, b)).sum() / weight(np.union1d(a, b)).sum()
    assert abs((both[0] == both[1]).mean() - want) < 0.04


def test_touching_spans(spark):
    rng, rows = random.Random(3), []
    for _ in range(200):
        base = []
        for kind in range(3):
            at = 0
            for _ in range(rng.randrange(7)):
                at += rng.randrange(60)
                base.append((at, kind, at + rng.randrange(1, 10), "x"))
                at = base[-1][2]
        starts = [rng.randrange(300) for _ in range(rng.randrange(15))]
        rows.append((base, [(s, 0, s + rng.randrange(1, 15), "x") for s in starts]))
    df = spark.createDataFrame(rows, f"base array<{spans.SPAN}>, others array<{spans.SPAN}>")
    for r in df.select("*", spans.touching(F.col("base"), F.col("others")).alias("t")).collect():
        assert sorted(r["others"]) == sorted(x["span"] for x in r["t"])
        for x in r["t"]:
            kinds = [b["kind"] for b in r["base"] if b["start"] < x["span"]["end"] and b["end"] > x["span"]["start"]]
            assert x["kind"] in kinds if kinds else x["kind"] is None


def test_entropy_of_windows(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("abc123XY/+"[: rng.randint(1, 10)]) for _ in range(rng.randrange(90))) for _ in range(120)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", secrets.top_entropy(F.col("v")).alias("e")).collect():
        w = min(20, len(r["v"]))
        windows = [Counter(r["v"][i : i + w]) for i in range(len(r["v"]) - w + 1)] if w else []
        assert r["e"] == pytest.approx(max((-sum(c / w * math.log2(c / w) for c in n.values()) for n in windows), default=0), abs=1e-5)


def test_texts_of_many_matches_and_long_candidates(spark):
    """Linear: four times the matches take nothing like sixteen times as long."""
    rng = random.Random(9)
    random_key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(200_000))
    one = lambda text: spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (r,) = secrets.find_secrets(one(random_key), keep=["doc_id"]).collect()
    assert [(s["start"], s["end"]) for s in r["added"]] == [(0, 200_000)] and not r["base"]
    took = []
    for n in (10_000, 40_000):
        text = " ".join(f"{rng.getrandbits(128):032x}" for _ in range(n))
        began = time.perf_counter()
        (r,) = secrets.find_secrets(one(text), keep=["doc_id"]).collect()
        took.append(time.perf_counter() - began)
        assert len(r["base"]) == n and [s["start"] for s in sorted(r["base"])] == [33 * k for k in range(n)]
    assert took[1] < 10 * took[0]
    (r,) = pii.find_pii(one(" ".join(f"u{k}@ex{k % 97}.org" for k in range(20_000)))).collect()
    assert len(r["base"]) == 20_000 and not r["added"]


def test_letters_are_of_category_l():
    model = language.LanguageModel(["en"], np.full((language.BUCKETS, 1), 1 / language.BUCKETS, np.float32))
    assert [model.predict(x)[0] for x in ("²½Ⅷ① 12 _", "²a", "ª", "文", "", None)] == ["und", "en", "en", "en", "und", "und"]


def test_many_languages(spark):
    rows = [(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} w{k}w", f"l{k}") for k in range(1100)]
    assert len(language.train(spark.createDataFrame(rows, "text string, lang string")).languages) == 1100


def test_tokens_of_odd_texts():
    rng, t = random.Random(2), PieceTokenizer(vocabulary())
    atoms = ["a", "Foo", "été", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "'s", "'", "don't", ".", "...", "&&&", "123", "x1", "_", "\0", "\0a", "<|endoftext|>", "日本語", "\U0001f600", "́", "ß", "\x1c", "\x85", "A" * 70, "　", "Ⅷ"]
    for _ in range(60):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(40))) for _ in range(40)]
        ids, counts = t.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for x, end, n in zip(texts, ends, counts, strict=True):
            assert ids[end - n : end].tolist() == t.tokenizer.encode(x, add_special_tokens=False).ids


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d"), (None, None), (None, None)], "doc_id bigint, text string")
    got = simhash.fingerprint_with_edits(docs, repeats=True).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 2, 2: 1, None: 2}
    prints = spark.createDataFrame([(5, 6), (5, 6), (5, 7)], "f1 bigint, f2 bigint")
    assert simhash.hamming_search(prints, prints).count() == 4
    pages = spark.createDataFrame([(1, "http://example.org/es/x")] * 2 + [(2, "http://example.org/es/" + "x" * 100_000)], "page_id bigint, url string")
    table = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    for rules in (urls.RULES, table):
        assert sorted((r["page_id"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()) == [(1, "block"), (1, "block"), (2, "block")]


def test_search_reads_texts_once(spark, monkeypatch):
    """Texts are read and cut into words in one place, and terms aren't made by an interpreted function."""
    plans, write = [], simhash.materialize

    def kept(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", kept)
    rows = [(50, "A b"), (1, " a\t\nB"), (100, "a b c"), (2, "a b  C "), (150, None), (3, " \t"), (200, "a b c d"), (4, "a b c e"), (250, "é"), (250, "é"), (5, "É")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = simhash.near_counts(docs, docs["doc_id"] % 50 == 0).collect()
    assert sorted((r["doc_id"], r["n_near"]) for r in out) == [(50, 1), (100, 1), (150, 1), (200, 0), (250, 2), (250, 2)]
    assert sum(p.count("split(") for p in plans) == 1 and sum("LogicalRDD" in line or "LocalRelation" in line for p in plans for line in p.splitlines()) == 1
    assert "transform(" not in "".join(plans)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    table = spark.createDataFrame([], "verdict string, host string, path string")
    one = spark.createDataFrame([(1, "http://example.org/es/x")], "page_id bigint, url string")
    assert urls.filter_urls(pages, urls.RULES).count() == 0 and urls.filter_urls(pages, table).count() == 0
    assert [r["verdict"] for rules in ([], table) for r in urls.filter_urls(one, rules).collect()] == ["allow", "allow"]
    prints = spark.createDataFrame([], "f1 bigint, f2 bigint")
    assert simhash.hamming_search(prints, prints).count() == 0
    empty = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name


def test_near_copies_of_one_id_stay_apart(spark):
    """Two texts of one id, of which one is a near copy of another document: the copy goes, the other text stays."""
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words), None, "a", 1), (2, " ".join([*words, "end"]), None, "a", 1), (2, "quite another text with its own words", None, "a", 1)]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["text"] for r in got.collect()) == sorted([rows[0][1], rows[2][1]])


OLD_LOOSE = (
    (r"^[^\s@]+@[^\s@]+$|(?i)^\S+ at \S+(?: dot \S+)+$|^\S+? ?[(\[{]at[)\]}] ?\S+", 0, 1000),
    (r"^[0-9]+(?:(?:\.|[\[(](?:\.|dot)[\])])[0-9]+){3}(?:[:/][0-9]+)?$|^[0-9A-Fa-f]*(?::[0-9A-Fa-f]+){7}$|^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$", 0, 1000),
    (r"^[0-9](?:[-\x20./_]{0,3}[0-9])+$", 12, 19),
    (r"^(?!(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$)[+(]*[0-9](?:[-\x20()./]{0,3}[0-9])+(?: ?(?:x|ext\.?) ?[0-9]+)?$", 7, 15),
)


def test_loose_forms_equal_plain_patterns(spark):
    """The forms without unbounded groups accept what the plain patterns accept."""
    rng = random.Random(11)
    values = ["2024-01-02", "a at b dot c", "A AT b DOT c dot d", "a at b dot dot c", "x(at)y", "x [at] y", "1[.]2(dot)3.4:80", "::1", "fe80::", "1:2:3:4:5:6:7:8", "+1 555 123 4567 x12", "(555) 123-4567 ext. 9", "555 1234  x9", "((5551234567", "1" * 12]
    values += ["".join(rng.choice("012345 -./()+x:@adot_") for _ in range(rng.randrange(1, 24))) for _ in range(20_000)]
    values += ["".join(rng.choice(["12", "345", " ", "-", ".", "   ", "    ", "(", ")", "+", " x", "ext."]) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    n = F.length(F.regexp_replace("value", "[^0-9]", ""))
    old = F.filter(F.array(*[F.when(F.col("value").rlike(p) & n.between(a, b), i) for i, (p, a, b) in enumerate(OLD_LOOSE)]), lambda k: k.isNotNull())
    rows = spark.createDataFrame([(v,) for v in values], "value string").select("value", old.alias("a"), pii.loosely(F.col("value")).alias("b"))
    assert rows.filter("a <> b").take(5) == [] and rows.filter("size(a) > 0").count() > 300


REPEATED = ["1 ", "12-", "a.", "a@b.", "1.2.3.4 ", "x dot ", "x at y dot ", "(at)", "+1 ", "555-", "::", "a:", "9", "((", " ", "A", "aB", "a-", "a/", "_", "=", "AKIA", "0f", "0123456789abcdef", "password=", "é", "4" * 16 + " ", "x" * 30 + "-"]


@pytest.mark.parametrize("n", [1_000_000])
def test_patterns_bear_long_repetitions(spark, n):
    """Every pattern, on 1,000,000 characters that repeat what its groups repeat."""
    texts = spark.createDataFrame([(x,) for x in REPEATED], "x string").repartition(4).select(F.expr(f"substring(repeat(x, cast({n} / length(x) as int) + 1), 1, {n})").alias("v"))
    hits = [F.size(pii.loosely(F.col("v"))), *[F.size(F.regexp_extract_all("v", F.lit(p), F.lit(0))) for p in (*pii.PATTERNS, pii.CANDIDATE, *secrets.PATTERNS, secrets.CANDIDATE, secrets.STRETCH)], secrets.allowed(F.col("v")).cast("int")]
    hits += [pii.valid(k, F.col("v")).cast("int") for k in range(4)] + [secrets.valid(k, F.col("v")).cast("int") for k in range(3)]
    assert texts.select(F.length("v").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(hits)]).filter(F.col("n") == n).count() == len(REPEATED)
    assert texts.select(*[F.sum(h) for h in hits]).count() == 1


@pytest.mark.parametrize("n", [4_000, 32_000, 500_000])
def test_tables_of_numbers_have_no_personal_data(spark, n):
    """A text of numbers, the form that once overflowed the stack, and a phone after it."""
    text = "7 " * n + "\nphone +49 30 1234567 ."
    docs = spark.createDataFrame([(1, text), (2, "1 2 " * n), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in [*r["base"], *r["added"]]] for r in pii.find_pii(docs).collect()}
    start = text.index("+")
    assert got == {1: [(start, 3, start + len("+49 30 1234567"))], 2: [], 3: []}
