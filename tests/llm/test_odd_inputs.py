"""Columns of clashing names and of maps, extreme ids, repeated rules and rows, a standing index, and near copies without an estimate."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tokenizers
from pyspark.sql import functions as F

import __spark_entry__
from causeway.llm import exact, minhash, mixing, packing, rangecoder, simhash, urls

SF = "/root/testdata/sf0.001"


def test_packing_with_clashing_names_and_maps(spark):
    rows = spark.createDataFrame([(i, 1 + i % 7, {"k": i}, "n") for i in range(60)], "doc_id long, length long, n map<string,int>, sequence_id string")
    out = packing.pack(rows, capacity=8).collect()
    assert len(out) == 60 and max(Counter(r["sequence_id"] for r in out).values()) <= 8
    used = Counter()
    for r in out:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 8 and all(r["n"] == {"k": r["doc_id"]} for r in out)


def test_mixing_with_maps(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", {"a": i}) for i in range(90)], "doc_id long, source string, extra map<string,int>")
    out = mixing.mix(rows, F.lit(10)).collect()
    assert len(out) == 90 and all(r["extra"] == {"a": r["doc_id"]} for r in out) and 80 <= sum(r["copies"] for r in out) <= 100


def test_exact_with_extreme_ids_and_clashing_names(spark):
    rows = [(-(1 << 63), "a b", 1), ((1 << 63) - 1, "ab", 2), (None, "ab", 3), (0, "c", 4), (None, "c", 5)]
    index = exact.new_index(spark)
    out = exact.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, keep_chars int"), index).collect()
    index.drop()
    assert sorted((r["keep_chars"], r["keep_id"], r["kept"]) for r in out) == [(1, -(1 << 63), True), (2, -(1 << 63), False), (3, -(1 << 63), False), (4, 0, True), (5, 0, False)]


def test_deliveries_against_a_standing_index(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    best = {}
    for r in docs:
        key = "".join((r["text"] or "").split())
        rank = (0 if r["source"] <= "src14" else 1, -len(r["text"] or ""), r["doc_id"])
        best[key] = min(best.get(key, (9,)), rank)
    want = sorted((1 if r["source"] <= "src14" else 2, r["doc_id"], best["".join((r["text"] or "").split())][2]) for r in docs)
    got = __spark_entry__.queries()["exact_dedup_deliveries"](spark, SF).collect()
    assert sorted((r["delivery"], r["doc_id"], r["keep_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_tables_of_rules_with_repeats_and_pages_with_maps(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", {"m": 1}), (1, "http://a.org/x", {"m": 2}), (2, None, None), (3, "http://b.a.org/y", {})], "page_id long, url string, meta map<string,int>")
    rules = spark.createDataFrame([("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("block", "org", "/")], "verdict string, host string, path string")
    out = urls.filter_urls(pages, rules).collect()
    assert sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in out) == [(1, "a.org/x", "block"), (1, "a.org/x", "block"), (2, "", urls.DEFAULT), (3, "org/", "block")]


def test_search_tells_rows_of_one_id_apart(spark):
    long = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(50, long), (50, "quite another text"), (7, long), (None, long), (100, None), (100, None)], "doc_id long, text string")
    out = simhash.near_counts(docs, F.col("doc_id") % 50 == 0).collect()
    assert sorted((r["doc_id"], r["n_near"]) for r in out) == [(50, 0), (50, 2), (100, 1), (100, 1)]
    assert simhash.near_counts(docs.limit(0), F.col("doc_id") % 50 == 0).count() == 0


def test_search_finds_all_within_the_radius(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    prints = {r["doc_id"]: ((r["f1"] & (2**64 - 1)) << 64) | (r["f2"] & (2**64 - 1)) for r in simhash.fingerprints(docs, key=["doc_id"]).collect()}
    want = {i: sum((p ^ q).bit_count() <= 3 for j, q in prints.items() if j != i) for i, p in prints.items() if i % 50 == 0}
    assert {r["doc_id"]: r["n_near"] for r in simhash.near_counts(docs, F.col("doc_id") % 50 == 0).collect()} == want


def test_classes_with_and_without_the_estimate(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts, passage = [], [rng.choice(words) for _ in range(60)]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 90))] + passage
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = [sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in minhash.near_duplicates(docs, sure=sure).collect()) for sure in (minhash.SURE, None)]
    assert classes[0] == classes[1] and any(size > 1 for _, _, size in classes[0])


def test_three_orders_beat_a_fixed_table_of_order_0():
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    t = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = np.concatenate([np.array([*e.ids, 0], np.uint32) for e in t.encode_batch(texts, add_special_tokens=False)])
    words, used = rangecoder.code_ids(ids, t.get_vocab_size())
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    order0 = -(share * np.log2(share)).sum() / 8
    # the table itself, which order 0 would need besides, isn't even counted
    assert (2 * len(words) + 4 * len(used)) / len(ids) < 0.97 * order0
    for n in (1, 2, 3, 17, 255, 256, 257, 5000, 70_001):
        w, u = rangecoder.code_ids(ids[:n], t.get_vocab_size())
        assert (rangecoder.decode_ids(w, u, n, t.get_vocab_size()) == ids[:n]).all()
