"""Best-fit-decreasing packing of token sequences.

Documents become pieces of at most ``CAPACITY`` tokens. Only their lengths matter for where they go, so the plan is made from the
histogram of lengths, which has at most ``CAPACITY`` rows at any size of the input: lengths fall from long to short, open
sequences of equal room stand together, and a segment tree over the rooms finds the tightest that fits in logarithmic time.
Whole runs of equal pieces go into whole runs of equal sequences at once. Each piece then finds its place by its rank among the
pieces of its length, which Spark counts by salted blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import hashable, materialize, read_table
from causeway.llm.tokens import chunks, tokenizer, vocabulary

CAPACITY = 2048
#: Id at the end of a document.
END = 0
#: Blocks of the pieces of one length.
BLOCKS = 512


class RoomTree:
    """A segment tree over the rooms 0 to ``capacity``: which rooms have open sequences."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, room: int, there: bool) -> None:
        i = room + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that has an open sequence."""
        i = least + self.size
        while not self.any[i]:
            while i & 1:  # a right child: go up until there is a sibling to the right
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs ``length, rank, n, sequence, per, offset``: the pieces of ``length`` with ranks from ``rank`` on, ``n`` of them, go ``per`` to a
    sequence into those from ``sequence`` on, each after ``offset`` tokens.

    It is best-fit decreasing: a piece goes to the tightest open sequence, and a sequence that just took one is the tightest for the
    next of the same length as long as it fits.
    """
    tree, open_runs, runs, made = RoomTree(capacity), {}, [], 0

    def keep(room: int, first: int, count: int) -> None:
        if count and room:
            open_runs.setdefault(room, []).append((first, count))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, count = capacity, made, -(-left // (capacity // length))
                made += count
            else:
                first, count = open_runs[room].pop()
                if not open_runs[room]:
                    tree.put(room, False)
            per = room // length
            full, some = divmod(min(left, count * per), per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - room))
                keep(room - per * length, first, full)
            if some:
                runs.append((length, rank + full * per, some, first + full, some, capacity - room))
                keep(room - some * length, first + full, 1)
            used = full + bool(some)
            keep(room, first + used, count - used)
            rank, left = rank + full * per + some, left - full * per - some
    return pd.DataFrame(runs, columns=["length", "rank", "n", "sequence", "per", "offset"])


def pieces(docs: DataFrame, *, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces; a null text has the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            for part in chunks(batch):
                ids, counts = encoder.encode(pc.fill_null(part.column("text"), ""))
                ids = ids.astype("<u4", copy=False)
                ends = np.cumsum(counts)
                rows: list[tuple[int, int, int, int]] = []
                for d, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    own = ids[end - n : end].tobytes() + END.to_bytes(4, "little")
                    n += 1
                    at, k = 0, 0
                    while at < n:
                        size = (n - at) % capacity or capacity
                        rows.append((d, k, at, size, zlib.crc32(own[4 * at : 4 * (at + size)])))
                        at, k = at + size, k + 1
                table = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, i]) for i in (2, 3, 4))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``; rows that repeat are packed each for itself.
    Columns of the names added are replaced; names that start with two underscores are this function's own.

    ``items`` is read twice, so pass a written table. Only the histogram of lengths (at most ``capacity`` rows) reaches the driver, and
    only the plan made from it (at most four runs per length and open run of sequences) goes back.
    """
    cols = [c for c in items.columns if c not in ("sequence_id", "offset")]
    keys = hashable(items, cols)
    rows = items.withColumn("__block", F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)).cast("int"))
    counts = rows.groupBy("length", "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialize(counts.select(F.col("length").alias("__length"), F.col("__block").alias("__at"), "__n", before.alias("__before")), "blocks")
    histogram = {r["__length"]: r["__n"] for r in counts.groupBy("__length").agg(F.sum("__n").alias("__n")).collect()}
    runs = plan(histogram, capacity)
    wide = runs["length"].to_numpy(np.int64) * 2**44 + runs["rank"].to_numpy(np.int64)  # ascending lengths for the search
    order = np.argsort(wide)
    shared = items.sparkSession.sparkContext.broadcast((wide[order], *(runs[c].to_numpy(np.int64)[order] for c in ("rank", "sequence", "per", "offset"))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank, sequence, per, offset = shared.value
        for batch in batches:
            length, own = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            i = np.searchsorted(keys, length * 2**44 + own, side="right") - 1
            k = own - rank[i]
            out = [batch.column(c) for c in cols]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence[i] + k // per[i]), pa.array(offset[i] + k % per[i] * length)], names=[*cols, "sequence_id", "offset"])

    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__block").orderBy(*keys)))
    ranked = ranked.join(counts, (F.col("length") == F.col("__length")) & (F.col("__block") == F.col("__at")))
    ranked = ranked.select(*cols, (F.col("__before") + F.col("__rank") - 1).alias("__rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*cols).schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs all rows of ``docs`` (doc_id, text): one row per piece with its place. Null ids and rows that repeat are packed too; an empty
    table gives an empty table."""
    return pack(materialize(pieces(docs, path=path or vocabulary(), capacity=capacity), "pieces"), capacity=capacity)


def op5_pack(spark, sf_dir):
    """Packs all documents into sequences of 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
