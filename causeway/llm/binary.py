"""Token ids in compressed binary blocks, in the order of documents.

Documents are dealt by ranges of doc_id, and each task writes its blocks of about ``BLOCK`` ids (whole documents) in order. A block is one
value of the files that Spark writes, with its shard and number; ``read_ids`` decodes each block for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import read_table, scratch_path
from causeway.llm.rangecoder import read_block, write_block
from causeway.llm.tokens import chunks, tokenizer, vocabulary

BLOCK = 1 << 20
END = 0
SCHEMA = "shard int, block int, n_docs int, n_tokens long, payload binary"


def write_ids(docs: DataFrame, target: str, *, path: str | None = None, block: int = BLOCK) -> None:
    """Encode all rows of ``docs`` (doc_id, text) and write them to ``target`` in the order of doc_id (null first; rows that repeat an id in
    the order of their text). A null text has the end id alone; an empty table gives files without blocks."""
    model = path or vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, k = tokenizer(model), TaskContext.get().partitionId(), 0
        size = encoder.tokenizer.get_vocab_size()
        docs_in: list[int | None] = []
        ids_in: list[np.ndarray] = []
        counts_in: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal k, held
            ids, counts = np.concatenate(ids_in), np.concatenate(counts_in)
            out = [[shard], [k], [len(docs_in)], [len(ids)], [write_block(docs_in, counts, ids, size)]]
            k, held = k + 1, 0
            for x in (docs_in, ids_in, counts_in):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for part in chunks(batch):
                ids, counts = encoder.encode(pc.fill_null(part.column("text"), ""))
                docs_in += part.column("doc_id").to_pylist()
                ids_in.append(np.insert(ids, np.cumsum(counts), END))
                counts_in.append(counts + 1)
                held += len(ids_in[-1])
                if held >= block:
                    yield flush()
        if docs_in:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SCHEMA).write.parquet(target)


def read_ids(spark: SparkSession, source: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and shard and block) of every document in the files at ``source``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, payload in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, counts, ids = read_block(payload.as_py())
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts, dtype=np.int64)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - counts), pa.array(counts.astype(np.int64)), pa.array(crcs, pa.int64())], names=["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(SCHEMA).parquet(source)
    rows = stored.select("shard", "block", "payload").mapInArrow(decode, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    blocks = stored.select("shard", "block", "n_tokens")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("shard", "block", inner.alias("block_start")).join(shards, "shard")
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def op4_token_ids(spark, sf_dir):
    """Writes all documents' token ids and reads them back."""
    target = scratch_path(spark, "token_ids")
    write_ids(read_table(spark, sf_dir, "documents").select("doc_id", "text"), target)
    return read_ids(spark, target)
