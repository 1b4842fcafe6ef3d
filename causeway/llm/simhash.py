"""Document fingerprints: 128-bit SimHash over weighted word shingles, and Hamming search by permuted block tables.

Terms are shingles of three lower-cased words (a shorter text is one term), weighed by their letters; a term that repeats votes
each time. Votes are summed two bits to a long, so that one document's 128 counters are 64 sums, which Spark's generated code
adds up while it goes through the terms; no Python runs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import SPACE, materialize, read_table, text_of

BITS = 128
#: Words of a term.
SHINGLE = 3
#: Two counters of 32 bits in a long: their lowest bits.
LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    """The lower-cased words; a text without words has an empty one, of no weight, so that its row stays."""
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r")), SPACE)


def with_votes(texts: DataFrame, keys: list[str], words: str) -> DataFrame:
    """One row per ``keys`` of ``texts`` with the fingerprint ``f1``, ``f2`` (64 bits each) of the array ``words``, and ``__rows``, how many rows have these keys.

    Terms are the array beside itself moved by one word and by two, and hashed as rows, all in generated code; ``transform`` would interpret each.
    """
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    parts = [f"__p{j}" for j in range(SHINGLE)]
    zipped = F.arrays_zip(*[F.slice(words, j + 1, n) for j in range(SHINGLE)], F.array(F.lit(1)))
    terms = texts.select(*keys, F.inline(zipped).alias(*parts, "__first"))
    weight = reduce(add, [F.coalesce(F.length(p), F.lit(0)) for p in parts])
    terms = terms.select(*keys, "__first", F.xxhash64(*parts).alias("h0"), weight.cast("long").alias("w")).withColumn("h1", F.xxhash64("h0"))
    lanes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{h}_{i}") for h in ("h0", "h1") for i in range(32)]
    sums = terms.groupBy(*keys).agg(F.count("__first").alias("__rows"), F.sum("w").alias("w"), *lanes)

    def bits(h: str) -> Column:
        lanes = F.array(*[F.col(f"{h}_{i}") for i in reversed(range(32))])
        most = lambda votes, bit: F.when(votes * 2 > F.col("w"), F.lit(bit)).otherwise(F.lit(0)).cast("long")
        two = lambda lane: most(lane.bitwiseAND(F.lit(0xFFFFFFFF)), 1).bitwiseOR(most(F.shiftrightunsigned(lane, 32), 1 << 32))
        return F.aggregate(lanes, F.lit(0).cast("long"), lambda out, lane: F.shiftleft(out, 1).bitwiseOR(two(lane)))

    return sums.select(*keys, bits("h0").alias("f1"), bits("h1").alias("f2"), "__rows")


def shown(f1: Column, f2: Column) -> Column:
    """The fingerprint as 32 hexadecimal digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f1, f2)])


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def fingerprints(docs: DataFrame, *, text: str = "text", key: list[str]) -> DataFrame:
    """``key`` columns with ``f1`` and ``f2`` for every row of ``docs``; the text is whole, null counts as empty.

    Rows of equal text have equal fingerprints; a text without words has all bits 0. Rows that repeat a key are one row (their
    terms vote together), so give a key that is unique where each row counts; null keys are grouped like values.
    """
    return with_votes(docs.select(*key, words_of(text_of(docs, text)).alias("__words")), key, "__words").drop("__rows")


def block_tables(radius: int, spare: int = 0) -> list[tuple[list[tuple[int, int]], ...]]:
    """Tables of (first bit, bits) blocks: two fingerprints within ``radius`` agree on all blocks of at least one table.

    128 bits are cut into ``radius + 1 + spare`` blocks, of which ``radius`` at most differ; each choice of ``1 + spare`` blocks is a
    table, whose permuted fingerprints start with these blocks.
    """
    n = radius + 1 + spare
    at = [BITS * i // n for i in range(n + 1)]
    return [tuple((at[i], at[i + 1] - at[i]) for i in chosen) for chosen in combinations(range(n), 1 + spare)]


def block_key(table: tuple[tuple[int, int], ...]) -> Column:
    text = F.concat(*[F.lpad(F.bin(f), 64, "0") for f in (F.col("f1"), F.col("f2"))])
    return F.xxhash64(*[F.substring(text, first + 1, bits) for first, bits in table])


def hamming_search(queries: DataFrame, stored: DataFrame, *, radius: int = 3, spare: int = 0) -> DataFrame:
    """For each distinct fingerprint of ``queries`` (f1, f2) all distinct ones of ``stored`` within ``radius``: ``q1, q2, f1, f2, distance``.

    Equal fingerprints stand for all their rows, so that copies meet once. ``spare`` widens the keys for large inputs. Complete: no
    fingerprint within the radius is missed. Rows with a null fingerprint find nothing.
    """
    tables = block_tables(radius, spare)

    def keyed(df: DataFrame) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), block_key(t).alias("k")) for i, t in enumerate(tables)])
        return df.select("f1", "f2").distinct().select("f1", "f2", F.explode(keys).alias("b")).select("f1", "f2", "b.t", "b.k")

    left = keyed(queries).withColumnsRenamed({"f1": "q1", "f2": "q2"})
    near = left.join(keyed(stored), ["t", "k"]).select("q1", "q2", "f1", "f2", distance(F.col("q1"), F.col("q2"), F.col("f1"), F.col("f2")).alias("distance"))
    return near.filter(F.col("distance") <= radius).distinct()


def keyed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """``id0`` and ``h`` name a row by its id and text without nulls; order by (id0, h) is the order of ids, null first."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id0"), F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("h"), *more)


def with_neighbours(ids: DataFrame) -> DataFrame:
    """``ids`` (id0, h, n) with the structs ``prev`` and ``next`` of the rows before and after, in a ring.

    The order is made by range partitions; only one row per partition goes through a window of its own.
    """
    placed = materialize(ids.repartitionByRange("id0", "h").withColumn("pid", F.spark_partition_id()), "order")
    row = F.struct("id0", "h", "n")
    ends = placed.groupBy("pid").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    order, ring = Window.orderBy("pid"), Window.partitionBy()
    ends = ends.select("pid", F.coalesce(F.lead("first").over(order), F.min("first").over(ring)).alias("after"), F.coalesce(F.lag("last").over(order), F.max("last").over(ring)).alias("before"))
    inside = Window.partitionBy("pid").orderBy("id0", "h")
    near = placed.select("*", F.lag(row).over(inside).alias("prev"), F.lead(row).over(inside).alias("next")).join(ends, "pid")
    cols = [c for c in ids.columns]
    return near.select(*cols, F.coalesce("prev", "before").alias("prev"), F.coalesce("next", "after").alias("next"))


def fingerprint_with_edits(docs: DataFrame, *, repeats: bool = False) -> DataFrame:
    """Fingerprints of all texts and of their edited texts (the last quarter replaced from the next document).

    One row per distinct pair of doc_id and text, or with ``repeats`` per row of ``docs``; rows that repeat an id stand in the order of a
    hash of their text, those that repeat both stand there as one. Null ids come first. Texts are whole, however long. A single document is its own next one; an empty table gives an empty table.
    """
    body = text_of(docs)
    ids = keyed_rows(docs, F.col("doc_id"), F.length(body).cast("long").alias("n")).groupBy("id0", "h").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("times"))
    ring = materialize(with_neighbours(ids), "ring")
    texts = keyed_rows(docs, body.alias("text"))
    heads = texts.join(ring.select("id0", "h", "prev"), ["id0", "h"])
    heads = heads.select(F.col("prev.id0").alias("id0"), F.col("prev.h").alias("h"), F.substring("text", F.lit(1), F.floor(F.col("prev.n") / 4).cast("int")).alias("head"))
    both = texts.join(ring.select("id0", "h", "doc_id", "n", "times", "next"), ["id0", "h"]).join(heads, ["id0", "h"])
    own = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    both = both.select("id0", "h", "doc_id", "n", "times", F.col("next.id0").alias("next0"), F.col("next.h").alias("nexth"), "text", F.concat(own, "head").alias("edited"))
    both = both.withColumn("sha", F.sha2("edited", 256))
    keys = ["id0", "h", "doc_id", "n", "times", "next0", "nexth", "sha", "part"]
    parts = both.select(*keys[:-1], F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("text").alias("t")), F.struct(F.lit(1).alias("part"), F.col("edited").alias("t")))).alias("p"))
    parts = parts.select(*keys[:-1], F.col("p.part").alias("part"), words_of(F.col("p.t")).alias("words"))
    votes = with_votes(parts, keys, "words")
    wide = votes.groupBy(*keys[:-1]).agg(*[F.max(F.when(F.col("part") == p, F.col(f))).alias(name) for p, f, name in ((0, "f1", "f1"), (0, "f2", "f2"), (1, "f1", "e1"), (1, "f2", "e2"))])
    prints = materialize(wide, "fingerprints")
    following = prints.select(F.col("id0").alias("next0"), F.col("h").alias("nexth"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    out = prints.join(following, ["next0", "nexth"])
    if repeats:
        out = out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("time")
    return out.drop("times")


def op3_simhash(spark, sf_dir):
    """Fingerprints every document and its edited text."""
    out = fingerprint_with_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"), repeats=True)
    like = lambda *f: 1 - distance(*map(F.col, f)) / F.lit(float(BITS))
    return out.select("doc_id", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), shown(F.col("f1"), F.col("f2")).alias("fingerprint"), shown(F.col("e1"), F.col("e2")).alias("edited_fingerprint"), like("f1", "f2", "e1", "e2").alias("near_edited"), like("f1", "f2", "g1", "g2").alias("near_next"))


def simhash_search(spark, sf_dir):
    """Documents whose id is divisible by 50, searched against all: how many other rows are within 3 bits of each."""
    return near_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 50 == 0)


def near_counts(docs: DataFrame, queries: Column) -> DataFrame:
    """``doc_id, n_near`` for every row of ``docs`` (doc_id, text) of the condition ``queries``: how many other rows are within 3 bits.

    Rows are told apart by id and text: rows that repeat an id with different texts have a fingerprint each, and rows with a null id are found
    by others. A null text counts as empty; an empty table gives an empty table.
    """
    rows = keyed_rows(docs, F.col("doc_id"), queries.alias("asks"), words_of(text_of(docs)).alias("words"))
    prints = materialize(with_votes(rows, ["id0", "h", "doc_id", "asks"], "words").withColumnRenamed("__rows", "times"), "prints")
    asked = prints.filter("asks")
    held = prints.groupBy("f1", "f2").agg(F.sum("times").alias("n_rows"))
    found = hamming_search(asked, prints).join(held, ["f1", "f2"]).groupBy("q1", "q2").agg(F.sum("n_rows").alias("n"))
    # rows that repeat both id and text come back as often
    each = asked.withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.join(found, (each["f1"] == found["q1"]) & (each["f2"] == found["q2"])).select("doc_id", (F.col("n") - 1).alias("n_near"))
