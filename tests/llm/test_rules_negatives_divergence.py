"""Quality rules, hard negatives and source divergence against plain Python, with nulls, ties, repeats, empty tables and clashing names."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from causeway.llm import divergence, negatives, quality

SF = "/root/testdata/sf0.001"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_over_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = __spark_entry__.queries()["op11_quality_rules"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        own = counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == own
        assert r["base_failed"] == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (r["base_failed"] and r["kept"])


TEXTS = [None, "", " \t\n", "a", "x " * 4, "x " * 5, "x " * 6, "a b c d e a b c d e", "a b c d e f a b c d e", "é ö ß\n\n \né ö ß\n#|<>", "a b c d e X b c d e a b c d e", "l\nl\r\nl\n l\nl", "💡 💡💡 &&", "a b c d e " * 30_000, "q" * 300_000]


def test_statistics_of_odd_texts(spark):
    docs = spark.createDataFrame([(t, i % 2, "x") for i, t in enumerate(TEXTS)] + [("a", 1, "x")], "text string, doc_id int, n_words string")
    rows = quality.statistics(docs, keep=["doc_id"]).collect()
    assert sorted(tuple(r[c] for c in COUNTS) for r in rows) == sorted(counts(t) for t in [*TEXTS, "a"])
    judged = quality.judge(quality.statistics(docs.limit(0), keep=["doc_id"]), quality.DecisionList(()))
    assert judged.count() == 0


def table(spark, rows):
    """Rows (doc_id, mean word length, share of symbols, good) as counts."""
    names = [*COUNTS, "n_lines", "n_distinct_words", "n_letters", "n_upper", "n_digits", "n_wordless", "n_ends"]
    return spark.createDataFrame([(i, i, 1000, int(1000 * mean), int(1000 * symbols), 0, 0, 10, 500, 4000, 40, 10, 5, 50, good) for i, mean, symbols, good in rows], f"doc_id long, split long, {', '.join(f'{n} long' for n in names)}, good boolean")


def test_decision_list_learns_planted_rules_and_judges_unseen_rows(spark):
    rng = random.Random(5)

    def rows(first, n):
        for i in range(first, first + n):
            mean, symbols = rng.uniform(3, 9), rng.uniform(0, 1)
            yield i, mean, symbols, not (symbols > 0.8 or (mean > 7 and symbols > 0.4))

    rules = quality.learn(table(spark, rows(0, 3000)))
    assert len(rules.rules) >= 2 and {c.name for r in rules.rules for c in r} <= {"mean_word", "symbols", "letters", "digits"}
    judged = quality.judge(table(spark, rows(5000, 2000)), rules)
    good, bad = judged.filter("good").agg(F.avg(F.col("kept").cast("int"))).first()[0], judged.filter("NOT good").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.95 and bad < 0.1
    assert str(rules).endswith("keep")


def test_learning_without_evidence_keeps_all(spark):
    assert quality.learn(table(spark, []), rules=2).rules == ()
    assert quality.learn(table(spark, [(i, 5.0, 0.1, True) for i in range(60)])).rules == ()
    assert quality.learn(table(spark, [(i, 5.0, 0.1, None) for i in range(60)])).rules == ()


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    stats = quality.statistics(spark.read.parquet(f"{sf}/documents.parquet"), keep=["doc_id"])
    rows = quality.labelled_rows(stats, spark.read.parquet(f"{sf}/labels.parquet")).cache()
    rules = quality.learn(rows.filter("doc_id % 3 <> 0").filter(~quality.base_failed()))
    seen = quality.judge(rows.filter("doc_id % 3 = 0"), rules).groupBy("good").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["good"]: r["k"] for r in seen}
    assert kept[True] >= 0.95 and kept[False] <= 0.1


def mined(rows, every, positives=5, n=10):
    """Brute force of ``hard_negatives`` over (vec_id, label, vector or None)."""
    good = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, c, v in sorted(good):
        if i % every == 0:
            anchors.setdefault(i, (c, v))
    out = []
    for i, (c, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, d) for j, d, w in good if j != i)
        for s, j, _ in [x for x in scored if x[2] == c][:positives]:
            fit = [x for x in scored if x[2] != c and 30 * -s <= 100 * -x[0] <= 90 * -s][:n]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<float>, score string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def found(spark, rows, every):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, anchors=F.col("vec_id") % every == 0).select(*COLUMNS).collect())


def test_hard_negatives_with_ties_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GATHER", 12)
    rng = random.Random(3)
    vector = lambda n=6: [rng.randrange(-3, 9) / 8 for _ in range(n)]
    rows = [(i * 7 - 400, rng.randrange(3), vector()) for i in range(300)]
    rows += [(10_000 + i, 1 + i % 2, [0.5] * 6) for i in range(200)]  # one score, many ids
    rows += [(77_777, 2, [0.5] * 6)] * 40 + [(10_050, 0, [0.25] * 6)] * 2  # one id, many rows
    rows += [(None, 1, vector()), (5, None, vector()), (6, 1, None), (9, 1, [0.5, None]), (20, 1, [float("nan")]), (30, 1, [float("inf")] * 6), (40, 0, []), (50, 1, [0.5, 0.75])]
    rng.shuffle(rows)
    expected = mined(rows, 50)
    assert len(expected) > 100 and found(spark, rows, 50) == expected


def test_hard_negatives_of_chunks_large_numbers_and_far_ids(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 3)
    monkeypatch.setattr(negatives, "GATHER", 11)
    rng = random.Random(8)
    rows = [(rng.choice([-1, 1]) * rng.randrange(1 << 62) // 10 * 10, rng.randrange(2), [float(rng.randrange(1 << 18)) for _ in range(4)]) for _ in range(25)]
    rows += [(i * 10 + 1, i % 2, [float(1 << 17)] * 4) for i in range(60)]
    assert found(spark, rows, 10) == mined(rows, 10)
    assert found(spark, [], 10) == []
    assert found(spark, [(10, 1, [1.0]), (11, 0, [1.0])], 10) == []


def diverged(rows, min_docs, top):
    """Brute force of ``divergence`` over (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans(divergence.UPPER, divergence.LOWER)
    out = []
    for lang in {r[1] for r in rows}:
        own = [(r[2], re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[0].translate(lower))) for r in rows if r[1] == lang]
        docs = collections.Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        sources = sorted({s for s, _ in own})
        n = {s: collections.Counter(t for x, ts in own if x == s for t in ts if docs[t] >= min_docs) for s in sources}
        whole = sum(n.values(), collections.Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {s: p(n[s]) for s in sources}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            marks = sorted((-f(shares[s][t], q[t]), t.encode()) for t in kept if n[s][t] and shares[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", marks)) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 2, 50])
def test_divergence_equals_brute_force(spark, min_docs):
    rng = random.Random(1)
    words = ["the", "The", "été", "ÉTÉ", "x1y", "straße", "日本", "a-b", "don't", "ＡＢ"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "", None, "fr"]), rng.choice(["s1", "s2", "S", None, "é"])) for _ in range(80)]
    rows += [(None, "en", "empty"), ("", "lone", "one"), ("1 2 3", "numbers", "a"), ("", "numbers", "b"), ("the " * 50_000, "en", "s1")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string")
    got = sorted(tuple(r) for r in divergence.divergence(df, min_docs=min_docs, top=3).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == diverged(rows, min_docs, 3)


def test_divergence_of_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_share_is_exact_for_large_counts(spark):
    n, total = 10**18, 3 * 10**18 + 1
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long")).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // total
