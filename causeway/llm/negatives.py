"""Hard negatives: for an anchor and a positive, the best-scoring rows of other labels within a window of scores.

Selection is a distributed radix selection. Every task counts, for each window, the scores of its rows by the highest digit of their distance
from the window's top; the counts of all tasks are summed, and the bucket that holds the k-th score becomes the range of the next round,
whose buckets are that of the next digit. A single score that too many rows share is told apart by the digits of the row ids. When few enough
rows are left, one pass gathers just these, and they are ranked. Positives are selected in the same way.

Anchors are a query set, which grows with the data: they meet all rows in chunks of bounded size, each of which is one job over all
rows. A task keeps the histograms of one chunk and scores one batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import materialize, read_table, scratch_path

#: Bits of a digit; rows a window may gather; anchors, and bytes of their vectors, in a chunk; scores worked out at a time.
DIGIT, GATHER, CHUNK, CHUNK_BYTES, BLOCK = 10, 64, 1024, 8 << 20, 1 << 20
#: Windows: anchor_id, place, label, vector; the highest score (top); the range of scores that is searched (lo, hi); rows above it;
#: whether ids are searched, and what is left of their high bits (prefix) after ``shift`` lower ones; done.
SIGN = np.uint64(1 << 63)


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` with whole components; rows with a null, or with a component that is null or not finite, are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * 256)).alias("vector"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of a matrix, with zeros after their ends."""
    flat, sizes = np.asarray(column.flatten(), np.int64), np.asarray(pc.list_value_length(column), np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - starts[at]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``: in floating point where every sum is below 2**53."""
    most = lambda m: int(np.abs(m).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def biased(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order."""
    return ids.astype(np.int64).view(np.uint64) ^ SIGN


def shifted(ids: np.ndarray, by: int) -> np.ndarray:
    return ids >> np.uint64(by) if by < 64 else np.zeros_like(ids)


@dataclass(frozen=True)
class Chunk:
    """Anchors and their windows, as tasks need them."""

    anchors: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: Per anchor: place, top, lo, hi, by_id, prefix, shift of each window.
    windows: list[list[tuple]]

    @staticmethod
    def of(table: pa.Table, width: int) -> Chunk:
        """Of windows, one per row."""
        ids, at, of = np.unique(table["anchor_id"].to_numpy(), return_index=True, return_inverse=True)
        windows: list[list[tuple]] = [[] for _ in ids]
        for i, window in zip(of, zip(*[table[c].to_pylist() for c in ("place", "top", "lo", "hi", "by_id", "prefix", "shift")], strict=True), strict=True):
            windows[i].append(window)
        return Chunk(ids, table["label"].to_numpy()[at].astype(np.int64), matrix(table["vector"].take(at).combine_chunks(), width), windows)

    def scored(self, batch: pa.RecordBatch, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor's number, ids, scores) of the batch's rows of the anchor's label, or of other labels; never the anchor's own id."""
        ids, labels = np.asarray(batch.column("vec_id"), np.int64), np.asarray(batch.column("label"), np.int64)
        rows = matrix(batch.column("vector"), self.vectors.shape[1])
        step = max(1, BLOCK // max(1, len(ids)))
        for first in range(0, len(self.anchors), step):
            scores = products(self.vectors[first : first + step], rows)
            for i in range(first, min(first + step, len(self.anchors))):
                ok = (labels == self.labels[i]) == same
                ok &= ids != self.anchors[i]
                yield i, ids[ok], scores[i - first][ok]


def digit_bits(shift: int) -> int:
    return shift - max(0, shift - DIGIT)


def histograms(chunk: Chunk, k: int, same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``anchor_id, place, bucket, n``: the buckets of a task's rows, the first first, until they hold ``k`` rows; the k-th row of all tasks
    can't lie beyond."""
    counts: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, ids, scores in chunk.scored(batch, same):
            for place, _, lo, hi, by_id, prefix, shift in chunk.windows[i]:
                own = (scores >= lo) & (scores <= hi)
                if not own.any():
                    continue
                if by_id:
                    b = biased(ids[own])
                    b = b[shifted(b, shift) == np.int64(prefix).view(np.uint64)]
                    bits = digit_bits(shift)
                    buckets = (shifted(b, shift - bits) & np.uint64((1 << bits) - 1)).astype(np.int64)
                else:
                    buckets = (hi - scores[own]) >> score_shift(lo, hi)
                key = (i, place)
                found = np.bincount(buckets, minlength=1 << DIGIT)
                counts[key] = counts[key] + found if key in counts else found
    rows = [(int(chunk.anchors[i]), place, int(b), int(h[b])) for (i, place), h in counts.items() for b in first_buckets(h, k)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "place", "bucket", "n"])


def first_buckets(counts: np.ndarray, k: int) -> np.ndarray:
    at = np.flatnonzero(counts)
    return at[: int(np.searchsorted(np.cumsum(counts[at]), k)) + 1]


def score_shift(lo: int, hi: int) -> int:
    return max(0, (hi - lo).bit_length() - DIGIT)


def gathered(chunk: Chunk, k: int, same: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``anchor_id, place, vec_id, score`` of the rows that the windows' last ranges leave."""
    for batch in batches:
        parts: list[tuple] = []
        for i, ids, scores in chunk.scored(batch, same):
            for place, top, lo, hi, by_id, prefix, shift in chunk.windows[i]:
                own = np.flatnonzero((scores >= lo) & (scores <= top))
                if by_id and len(own):
                    own = own[(scores[own] > hi) | (shifted(biased(ids[own]), shift) <= np.int64(prefix).view(np.uint64))]
                if len(own) > k:  # more than k of a batch: those after its k-th can't be among the first
                    own = own[np.lexsort((ids[own], -scores[own]))[:k]]
                parts.append((np.full(len(own), chunk.anchors[i]), np.full(len(own), place), ids[own], scores[own]))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "place", "vec_id", "score"])


def over_rows(rows: DataFrame, windows: DataFrame, width: int, step, k: int, same: bool, schema: str, label: str) -> DataFrame:
    """``step`` over all rows for each chunk of anchors; what it yields is written chunk by chunk."""
    spark = rows.sparkSession
    size = max(1, min(CHUNK, CHUNK_BYTES // (8 * max(1, width))))
    # anchors in the order of their ids fall into chunks by hash; a chunk holds about ``size`` anchors
    n = windows.select("anchor_id").distinct().count()
    parts = -(-n // size)
    path = scratch_path(spark, label)
    dealt = windows.withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.lit(max(1, parts))))
    for c in range(parts):
        chunk = spark.sparkContext.broadcast(Chunk.of(dealt.filter(F.col("chunk") == c).toArrow(), width))
        rows.mapInArrow(lambda batches, chunk=chunk: step(chunk.value, k, same, batches), schema).write.mode("append").parquet(path)
        chunk.unpersist()
    if not parts:
        spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def narrowed(windows: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The windows after a round: their range is the bucket of the k-th row, or stays if there are fewer rows."""
    found = counts.groupBy("anchor_id", "place", "bucket").agg(F.sum("n").alias("n")).groupBy("anchor_id", "place").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"))
    w = windows.join(found, ["anchor_id", "place"], "left")
    start = F.struct(F.col("above").alias("above"), F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"))

    def reach(s: Column, b: Column) -> Column:
        hit = F.when((s["bucket"] < 0) & (s["above"] + b["n"] >= k), F.struct(s["above"].alias("above"), b["bucket"].alias("bucket"), b["n"].alias("n")))
        return F.when(s["bucket"] >= 0, s).otherwise(F.coalesce(hit, F.struct((s["above"] + b["n"]).alias("above"), s["bucket"].alias("bucket"), s["n"].alias("n"))))

    w = w.withColumn("at", F.aggregate(F.coalesce("b", F.array().cast("array<struct<bucket:bigint,n:bigint>>")), start, reach))
    few, bucket = F.col("at.bucket") < 0, F.col("at.bucket")
    # digits of a distance: the bits of the range beyond those of one digit
    bits = F.when(F.col("hi") > F.col("lo"), F.length(F.bin(F.col("hi") - F.col("lo")))).otherwise(0)
    s = F.greatest(F.lit(0), bits - DIGIT)
    hi = F.col("hi") - F.call_function("shiftleft", bucket, s)
    lo = F.greatest(F.col("lo"), hi - F.call_function("shiftleft", F.lit(1).cast("long"), s) + 1)
    next_shift = F.greatest(F.lit(0), F.col("shift") - DIGIT)
    prefix = F.call_function("shiftleft", F.col("prefix"), F.col("shift") - next_shift).bitwiseOR(bucket)
    enough = (F.col("at.above") + F.col("at.n") <= GATHER) | few
    new = w.select(
        "anchor_id", "place", "label", "vector", "top",
        F.when(few | F.col("by_id"), F.col("lo")).otherwise(lo).alias("lo"), F.when(few | F.col("by_id"), F.col("hi")).otherwise(hi).alias("hi"), F.col("at.above").alias("above"),
        "by_id", F.when(F.col("by_id") & ~few, prefix).otherwise(F.col("prefix")).alias("prefix"), F.when(F.col("by_id") & ~few, next_shift).otherwise(F.col("shift")).alias("shift"), enough.alias("enough"), few.alias("few"),
    )
    # one score is left: rows go by id from here; one id is left: its rows are equal
    ids = ~F.col("enough") & (F.col("lo") == F.col("hi"))
    done = F.col("enough") | (F.col("by_id") & (F.col("shift") == 0))
    # with fewer than k rows in all, everything down to the last range's end qualifies, whatever its ids
    by_id = F.when(F.col("few"), F.lit(False)).otherwise(F.col("by_id") | ids)
    return new.select("anchor_id", "place", "label", "vector", "top", "lo", "hi", "above", by_id.alias("by_id"), "prefix", "shift", done.alias("done"))


def select_top(rows: DataFrame, windows: DataFrame, width: int, k: int, same: bool, label: str) -> DataFrame:
    """``anchor_id, place, rank, vec_id, score``: of each window the first ``k`` rows by score, then id."""
    finished, k_round = None, 0
    open_ = materialize(windows, f"{label}-windows")
    while not open_.isEmpty():
        counts = over_rows(rows, open_, width, histograms, k, same, "anchor_id long, place int, bucket long, n long", f"{label}-counts{k_round}")
        after = materialize(narrowed(open_, counts, k), f"{label}-windows{k_round}")
        finished = after.filter("done") if finished is None else finished.unionByName(after.filter("done"))
        open_, k_round = after.filter("NOT done"), k_round + 1
    if finished is None:
        finished = windows
    found = over_rows(rows, finished, width, gathered, k, same, "anchor_id long, place int, vec_id long, score long", f"{label}-found")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("anchor_id", "place", "rank", "vec_id", "score")


def hard_negatives(rows: DataFrame, *, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``rows`` (vec_id, label, embedding).

    Components become floor(256 x); a score is their inner product. Rows of the condition ``anchors`` are anchors; an anchor's positives are its
    first ``positives`` other rows of its label, and of each the first ``negatives`` rows of other labels are returned whose score is from
    ``low`` to ``high`` percent of the positive's; all, if there are fewer. Higher scores come first, ties by smaller id.

    Rows with a null in any column used, or a component that is null or not finite, take no part. Shorter vectors count as if zeros followed.
    Rows that repeat an id count each for itself, but never for an anchor of the same id; of anchors with one id, that of the least label
    and vector counts. Other columns don't matter; an empty table gives an empty table. Scores must fit 62 bits.
    """
    width_of = usable(rows).agg(F.max(F.size("vector")).alias("width"), F.min("vec_id").alias("least"), F.max("vec_id").alias("most"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm")).first()
    all_ = materialize(usable(rows.filter(anchors)).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select(F.col("vec_id").alias("anchor_id"), "a.label", "a.vector"), "anchors")
    whole = materialize(usable(rows), "rows")
    width = width_of["width"] or 0
    least, most = (int(biased(np.array([x or 0]))[0]) for x in (width_of["least"], width_of["most"]))
    shift = (least ^ most).bit_length()
    prefix = int(np.uint64(least >> shift if shift < 64 else 0).view(np.int64))
    reach = int((width_of["norm"] or 0) * 1.000001) + 1  # no score is larger than the largest square of a norm

    def windows(df: DataFrame, place: Column, lo: Column, hi: Column) -> DataFrame:
        zero = F.lit(0).cast("long")
        return df.select("anchor_id", place.cast("int").alias("place"), "label", "vector", hi.cast("long").alias("top"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), zero.alias("above"), F.lit(False).alias("by_id"), F.lit(prefix).cast("long").alias("prefix"), F.lit(shift).alias("shift"), F.lit(False).alias("done"))

    best = select_top(whole, windows(all_, F.lit(0), F.lit(-reach), F.lit(reach)), width, positives, True, "positives")
    best = materialize(best.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(20,0)")
    # the least and the largest whole score in the window
    lo, hi = F.call_function("div", score * low + 99, F.lit(100)), F.call_function("div", score * high, F.lit(100))
    asked = best.filter("positive_score >= 0").join(all_, "anchor_id")
    found = select_top(whole, windows(asked, F.col("place"), lo, hi).filter("lo <= hi"), width, negatives, False, "negatives")
    return found.join(best, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def is_hundredth(vec_id: str = "vec_id") -> Column:
    return F.col(vec_id) % 100 == 0


def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth embedding, against all embeddings; every seventh stands under the next label."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), anchors=is_hundredth())


ORACLE_OP12 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, e.vec_id, e.label, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT s.anchor_id, p.positive_id, row_number() OVER (PARTITION BY s.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY s.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10"""
