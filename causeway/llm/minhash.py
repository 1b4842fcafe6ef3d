"""Near-duplicate documents: ProbMinHash signatures of weighted word shingles, banding, and exact verification.

Each shingle is a Poisson process whose rate is its weight: its points arrive at growing times and fall on random registers, and a
register keeps the shingle that came first. A shingle stops as soon as its next point is later than all registers, so that most
shingles of a long text stop after one point. Two documents agree on a register with the probability Jaccard similarity of their
weighted shingles. A shingle weighs the same in every text, the more the more letters it has (``letters``) or always 1 (``even``), and
counts once however often a text repeats it. So the probability Jaccard is the weight of the common shingles over that of all, and
this is what verification works out exactly for each pair, from the same weights.

Equal texts are one node. Nodes that share a band's registers share a bucket. A bucket emits a star, not all pairs: one member is
compared with all others. Buckets that still hold several groups then go through further stars, led by members of the smaller groups.
What is still mixed then goes through members of different groups, dealt to parts of bounded size. There the registers' estimate of
the similarity decides first, within the join, so that many unlike texts that share a passage cost comparisons of a few longs and
make no rows. Registers are independent (each sees its own share of every Poisson process), so that the differing ones of a pair of
similarity 0.8 are binomial, and ``SURE`` standard deviations above their mean leave out such a pair 96 times in a million.
No band in common is the other way to lose one: 49 times in a million at a similarity of exactly 0.8. Both fall fast above it.
Pairs that the estimate lets through but that are less alike, of which a group of loosely edited copies has as many as pairs, are then
left out within the join by a bound that loses none: weights are summed up in ``BINS`` bins by their hash, and two texts have no more in
common than the lesser sums of all bins.

The member of a bucket that shares most buckets with others leads it, so that the original of a group of edited copies, which is
nearer to each of them than they are to each other, is compared with them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import materialize, read_table, text_of
from causeway.llm.components import components
from causeway.llm.tokens import chunks, ragged

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = 256
#: Further stars before the rest of mixed buckets is compared member by member, in parts of so many members; see above.
STARS, PART, SURE = 1, 1000, 4
#: Bins of the bound on what two texts have in common, a power of two.
BINS = 512
#: Weights are whole numbers, so that sums are exact.
UNIT = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def gold(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, words: int = SHINGLE, weigh: str = "letters") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct shingles of all texts (2**20 at most), in order: text number, 44-bit hash, weight (uint16).

    Words are what ASCII white space separates, lower-cased. A text of fewer words is one shingle, one without words has none; no
    text is null. The weight of a shingle is ``UNIT`` times the binary logarithm of its code points plus one, or ``UNIT``.
    """
    lower = pc.ascii_trim(pc.utf8_lower(texts.cast(pa.large_string())), " \t\n\x0b\x0c\r")
    parts = pc.split_pattern_regex(lower, r"[\x09-\x0D\x20]+")
    counts = np.diff(parts.offsets.to_numpy())
    counts[np.asarray(pc.equal(lower, "").to_numpy(zero_copy_only=False), bool)] = 0
    flat = parts.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    w = hashes[flat.indices.to_numpy()]
    letters = pc.utf8_length(flat.dictionary).to_numpy()[flat.indices.to_numpy()].astype(np.int64)
    starts = parts.offsets.to_numpy()[:-1] - (parts.offsets[0].as_py() if len(parts) else 0)
    n = np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
    at = ragged(starts, n)
    size = np.repeat(np.minimum(counts, words), n)
    h = np.zeros(len(at), np.uint64)
    for i in range(words):
        inside = size > i
        h = np.where(inside, mixed(h + gold(i + 1)) ^ w[np.minimum(at + i, len(w) - 1)] if len(w) else h, h)
    if weigh == "letters":
        ends = np.r_[0, np.cumsum(letters)]
        weights = (UNIT * np.log2(1.0 + ends[at + size] - ends[at])).astype(np.uint16)
    else:
        weights = np.full(len(at), UNIT, np.uint16)
    keys = np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(44) | mixed(h) >> np.uint64(20)
    keys, first = np.unique(keys, return_index=True)
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64((1 << 44) - 1), weights[first]


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers (n_docs x registers, uint64: the shingle that came first) of weighted shingles, by doc."""
    times, came = np.full(n_docs * registers, np.inf), np.zeros(n_docs * registers, np.uint64)
    seed, at, rate, who = mixed(hashes + _GOLD), np.zeros(len(hashes)), weights.astype(np.float64), hashes
    point = 0
    while len(doc):
        point += 1
        r = mixed(seed + gold(point))
        at = at - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        slot = doc * registers + (mixed(r) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, slot, at)
        won = times[slot] == at
        came[slot[won]] = who[won]
        # a shingle whose time is past all registers of its document has no more to say
        go = at < times.reshape(n_docs, registers).max(axis=1)[doc]
        doc, seed, at, rate, who = doc[go], seed[go], at[go], rate[go], who[go]
    return came.reshape(n_docs, registers)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """n_docs x bands keys; a key holds its band's number."""
    keys = np.zeros((len(registers), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(registers), b, np.uint64)
        for r in range(rows):
            h = mixed(h * _GOLD + registers[:, b * rows + r])
        keys[:, b] = h
    return keys.view(np.int64)


def nibbles(registers: np.ndarray) -> np.ndarray:
    """Four bits of each register, 16 registers to a long (n_docs x longs)."""
    few = np.zeros((len(registers), -(-registers.shape[1] // 16) * 16), np.uint64)
    few[:, : registers.shape[1]] = mixed(registers) & np.uint64(15)
    return (few.reshape(len(few), -1, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)


def differing(a: str, b: str, longs: int) -> Column:
    """Of two columns of ``nibbles``: how many registers differ."""
    total = F.lit(0)
    for i in range(longs):
        x = F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def signed(docs: DataFrame, words: int, weigh: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, node, keys, few, weight``: keys of the bands and ``nibbles`` of the registers (null for texts without words), sum of the weights."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                doc, hashes, weights = shingles(part.column("text"), words, weigh)
                registers = signatures(doc, hashes, weights, part.num_rows)
                total = np.bincount(doc, weights, part.num_rows).astype(np.int64)

                def listed(keys: np.ndarray, total: np.ndarray = total) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()), mask=pa.array(total == 0))

                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), listed(band_keys(registers, bands, rows)), listed(nibbles(registers)), pa.array(total)], names=["doc_id", "node", "keys", "few", "weight"])

    return docs.mapInArrow(sign, "doc_id long, node binary, keys array<bigint>, few array<bigint>, weight long")


def shingle_sets(docs: DataFrame, words: int, weigh: str) -> DataFrame:
    """``node, items, weights``: the sorted 32-bit hashes of each text's shingles, and their weights in the same order."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                doc, hashes, weights = shingles(part.column("text"), words, weigh)
                items = (hashes >> np.uint64(12)).astype("<u4")
                weights = weights.astype("<u2")
                ends = np.searchsorted(doc, np.arange(part.num_rows), side="right")
                begins = np.r_[0, ends[:-1]] if len(ends) else ends
                of = list(zip(begins.tolist(), ends.tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("node"), *(pa.array([x[a:b].tobytes() for a, b in of], pa.binary()) for x in (items, weights))], names=["node", "items", "weights"])

    return docs.select("node", "text").mapInArrow(listed, "node binary, items binary, weights binary")


def binned(sets: DataFrame) -> DataFrame:
    """``node, bins``: sums of the weights of ``shingle_sets`` by the hash of the shingle."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, BINS), np.int32)
            for i, (x, wx) in enumerate(zip(batch.column("items"), batch.column("weights"), strict=True)):
                found[i] = np.bincount(np.frombuffer(x.as_buffer(), "<u4") & np.uint32(BINS - 1), np.frombuffer(wx.as_buffer(), "<u2"), BINS)
            bins = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BINS), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), bins], names=["node", "bins"])

    return sets.mapInArrow(sums, "node binary, bins array<int>")


def similarity(p: np.ndarray, wp: np.ndarray, q: np.ndarray, wq: np.ndarray) -> float:
    """The probability Jaccard of two sets of sorted shingles, each with its weights (the same for a shingle of both)."""
    both = np.concatenate([p, q])
    order = np.argsort(both, kind="stable")
    both, weights = both[order], np.concatenate([wp, wq])[order].astype(np.int64)
    common = int(weights[1:][both[1:] == both[:-1]].sum())
    every = int(weights.sum()) - common
    return common / every if every else 0.0


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose weighted shingles have a probability Jaccard of at least ``threshold``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, wx, y, wy in zip(*(batch.column(c) for c in ("x", "wx", "y", "wy")), strict=True):
                wp, wq = (np.frombuffer(s.as_buffer(), "<u2") for s in (wx, wy))
                if min(wp.sum(), wq.sum()) < threshold * max(wp.sum(), wq.sum()):
                    good.append(False)
                    continue
                p, q = (np.frombuffer(s.as_buffer(), "<u4") for s in (x, y))
                good.append(similarity(p, wp, q, wq) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"), F.col("weights").alias("wx"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"), F.col("weights").alias("wy"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "wx", "y", "wy").mapInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, words: int = SHINGLE, threshold: float = THRESHOLD, weigh: str = "letters", stars: int = STARS, sure: int | None = SURE) -> DataFrame:
    """``doc_id, node, class_id, class_size, kept`` for every row of ``docs`` (doc_id, text).

    ``node`` is the digest of the text; documents whose texts are equal or linked, directly or through others, have one class. ``class_id``
    is the class's smallest doc_id, whose row is kept. A null text counts as empty; texts without words are linked to equal texts
    alone. Null ids are allowed and kept only in a class without others; rows that repeat id and text are all in their class and all
    kept if that id is the class's. Texts are read whole, however long. An empty table gives an empty table. ``weigh`` is ``letters`` or
    ``even`` (see the module). ``sure`` is the number of standard deviations within which the last comparison in mixed buckets trusts the
    registers' estimate; with None every pair there is verified, and only bands decide which texts meet.
    """
    if weigh not in ("letters", "even"):
        raise ValueError("weigh is 'letters' or 'even'")
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    texts = rows_in.withColumn("node", F.unhex(F.md5("text")))
    # one row stands for all of a text; its id finds the text again without bringing copies together
    known_id = F.coalesce("doc_id", F.lit(-(1 << 63)))
    table = materialize(signed(texts, words, weigh), "signatures")
    nodes = materialize(table.groupBy("node").agg(*[F.first(c).alias(c) for c in ("keys", "few", "weight")], F.min(known_id).alias("row")).filter("keys IS NOT NULL"), "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("together")).filter("together > 1")
    members = materialize(keyed.join(buckets, "key"), "members")
    degrees = members.groupBy("node").agg(F.sum("together").alias("degree"))
    members = materialize(members.join(degrees, "node").select("key", "node", "degree"), "ranked")
    leaders = members.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("leader"))
    pairs = materialize(ordered_pairs(members.join(leaders, "key").filter("leader <> node"), "leader", "node"), "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = asked.join(nodes.select("node", "row"), "node")
    # every member of a bucket is in a pair of that bucket, so these sets serve all later rounds
    held = texts.select(known_id.alias("row"), "node", "text").hint("merge").join(asked.hint("merge"), ["row", "node"], "left_semi")
    sets = materialize(shingle_sets(held.dropDuplicates(["row", "node"]), words, weigh), "sets")
    links = materialize(verified(pairs, sets, threshold), "links")
    tried = pairs
    for k in range(stars + 1):
        groups = components(links)
        placed = members.join(groups, "node", "left").select("key", "node", "degree", F.coalesce("component", "node").alias("component"))
        sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.max(F.struct("degree", "node")).alias("lead"))
        sizes = materialize(sizes, f"sizes{k}")
        open_keys = sizes.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count("*").alias("groups"), F.sum("n").alias("together")).filter("groups > 1")
        smaller = sizes.join(open_keys, "key").filter("component <> largest")
        several = smaller.groupBy("key").agg(F.first("largest").alias("largest"), F.first("together").alias("together"), F.max("lead")["node"].alias("leader"))
        several = materialize(several, f"mixed{k}")
        if several.isEmpty():
            break
        open_members = placed.join(several, "key")
        if k < stars:
            more = ordered_pairs(open_members.filter("node <> leader"), "leader", "node")
        else:
            more = across(open_members.drop("leader"), nodes, sets, threshold, sure)
        more = materialize(more.join(tried, ["a", "b"], "left_anti"), f"more{k}")
        if more.isEmpty() and k == stars:
            break
        tried = tried.unionByName(more)
        links = links.unionByName(materialize(verified(more, sets, threshold), f"links{k}"))
    groups = components(links)
    return classed(table.select("doc_id", "node"), groups)


def across(members: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, sure: int | None = SURE) -> DataFrame:
    """Pairs of members of a bucket that are of different groups; those within the largest group, which may hold most rows, never meet.

    Sets whose weights differ too much can't be similar enough and don't meet either. A large bucket is dealt to parts of ``PART`` members,
    each of which meets the members outside of the largest group. Pairs whose registers differ by more than ``sure`` standard deviations of
    a pair just similar enough don't meet; with None, all do. Of the rest, pairs whose ``binned`` weights (of ``sets``) show that they can't
    be similar enough don't meet.
    """
    bins = materialize(binned(sets.join(members.select("node").distinct(), "node", "left_semi")), "bins")
    known = members.join(nodes.select("node", "keys", "few", "weight"), "node").join(bins, "node").select("key", "node", "component", "largest", "weight", "few", "keys", "bins", F.ceil(F.col("together") / PART).cast("int").alias("parts"))
    outside = known.filter("component <> largest").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("node").alias("leader"), F.col("component").alias("other"), F.col("weight").alias("other_weight"), F.col("few").alias("other_few"), F.col("keys").alias("other_keys"), F.col("bins").alias("other_bins"))
    known = known.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    p = (1 - threshold) * 15 / 16  # that the four bits of a register of a pair just similar enough differ
    most = REGISTERS * p + (sure or 0) * (REGISTERS * p * (1 - p)) ** 0.5
    alike = F.lit(True) if sure is None else differing("few", "other_few", REGISTERS // 16) <= int(most)
    near = alike & (F.col("component") != F.col("other")) & (F.least("weight", "other_weight") >= F.lit(threshold) * F.greatest("weight", "other_weight"))
    # a pair that shares several buckets meets in one of them
    once = F.array_min(F.array_intersect("keys", "other_keys")) == F.col("key")
    common = F.aggregate(F.zip_with("bins", "other_bins", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda total, x: total + x)
    possible = common * (1 + threshold) >= F.lit(threshold - 1e-9) * (F.col("weight") + F.col("other_weight"))
    return ordered_pairs(known.join(outside, ["key", "part"]).filter(near & once & possible), "leader", "node")


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def classed(table: DataFrame, groups: DataFrame, salts: int = 256) -> DataFrame:
    """Gives each row of ``table`` (doc_id, node) its class; rows of one text are dealt to ``salts`` parts on the way."""
    rows = table.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    parts = materialize(rows.groupBy("node", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "parts")
    per_node = parts.groupBy("node").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    per_node = per_node.join(groups, "node", "left").select("node", "least", "n", F.coalesce("component", "node").alias("component"))
    per_node = materialize(per_node, "node_classes")
    per_class = per_node.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    known = per_node.select("node", "component").join(per_class, "component").select("node", "class_id", "class_size")
    owners = materialize(parts.select("node", "salt").join(known, "node"), "owners")
    return rows.join(owners, ["node", "salt"]).select("doc_id", "node", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op1_minhash(spark, sf_dir):
    """Near-duplicate classes of all documents: five words, similarity 0.8."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
