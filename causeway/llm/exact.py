"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, with one row per distinct text. A batch is first reduced to one row per
digest (salted, so that a text that holds a third of all rows meets in no single task), then a sort-merge anti-join finds the
digests that the index lacks, and these are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import SPACE, materialize, read_table, text_of

#: A group of equal texts is dealt to so many salts.
SALTS = 256


def normalized(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, SPACE, "")


class DigestIndex:
    """Digests seen so far: a bucketed, sorted table ``name`` of ``digest``, ``keep_id``, ``keep_chars`` and ``group_size``.

    ``path`` keeps the files outside of the warehouse, so that a later session finds them by the same path.
    """

    SCHEMA = "digest STRING, keep_id BIGINT, keep_chars BIGINT, group_size BIGINT"

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None) -> None:
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            at = f" LOCATION '{path}'" if path else ""
            spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{at}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the index; files at a ``path`` of the caller stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append_new(self, groups: DataFrame) -> None:
        """Append those groups whose digest the index lacks. ``groups``: one row per digest."""
        known = self.table().select("digest")
        fresh = groups.hint("merge").join(known.hint("merge"), "digest", "left_anti")
        fresh.select("digest", "keep_id", "keep_chars", "group_size").repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``digest``, ``keep_id``, ``group_size`` and ``kept`` added; new digests go to the index.

    Texts are equal when identical without ASCII white space; null counts as empty, so that all empty texts are one group. The
    row with the most code points stays, then the one with the smallest id (a null id comes last). A text that the index had
    before keeps the index's ``keep_id``, and no row of this batch stays, but for the row of that very id if the batch has it.
    Rows that repeat both id and text: each has ``kept``. ``group_size`` counts the rows of the batch that brought the text into the
    index; later batches don't change it. Columns of the names added are replaced. An empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in ("digest", "keep_id", "group_size", "kept")]
    body = text_of(docs, text)
    rows = docs.select(*keep, F.sha2(normalized(body), 256).alias("digest"), F.length(body).cast("long").alias("__chars"))
    return _assign(rows, keep, index, doc_id)


def _assign(rows: DataFrame, keep: list[str], index: DigestIndex, doc_id: str) -> DataFrame:
    key = F.col(doc_id).cast("long")
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(key, F.col("__chars")), F.lit(SALTS)).cast("int"))
    best = F.max(F.struct(F.col("__chars").alias("c"), key.isNotNull().alias("known"), F.bitwise_not(key).alias("i"))).alias("best")
    parts = materialize(rows.groupBy("digest", "__salt").agg(best, F.count("*").alias("n")), "parts")
    groups = parts.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    index.append_new(groups.select("digest", F.bitwise_not(F.col("best.i")).alias("keep_id"), F.col("best.c").alias("keep_chars"), "group_size"))
    owner = materialize(parts.select("digest", "__salt").join(index.table().select("digest", "keep_id", F.col("keep_chars").alias("__keep_chars"), "group_size"), "digest"), "owners")
    out = rows.join(owner, ["digest", "__salt"])
    return out.select(*keep, "digest", "keep_id", "group_size", (key.eqNullSafe(F.col("keep_id")) & (F.col("__chars") == F.col("__keep_chars"))).alias("kept"))


def second_delivery(docs: DataFrame, index: DigestIndex, first: Column) -> DataFrame:
    """``delivery, doc_id, keep_id, kept`` of ``docs`` (doc_id, text) in two deliveries: rows of the condition ``first``, whose digests make the
    index, and all others, which meet it. A null condition counts as false."""
    early = F.coalesce(first, F.lit(False))
    parts = [deduplicate(docs.filter(test).select("doc_id", "text"), index).select(F.lit(k).alias("delivery"), "doc_id", "keep_id", "kept") for k, test in ((1, early), (2, ~early))]
    return parts[0].unionByName(parts[1])


def new_index(spark: SparkSession) -> DigestIndex:
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")


def op9_exact_dedup(spark, sf_dir):
    """Exact deduplication of all documents against a new index: one row per document."""
    docs = read_table(spark, sf_dir, "documents")
    body = text_of(docs)
    rows = materialize(docs.select("doc_id", F.sha2(normalized(body), 256).alias("digest"), F.length(body).cast("long").alias("__chars")), "digests")
    index = new_index(spark)
    out = _assign(rows, ["doc_id"], index, "doc_id")
    index.drop()  # the result reads the rows written from it
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def exact_dedup_deliveries(spark, sf_dir):
    """Documents of the sources up to src14 are delivered first; those of the others are held against the standing index of their digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = new_index(spark)
    out = materialize(second_delivery(docs, index, F.col("source") <= "src14"), "deliveries")
    index.drop()
    return out


ORACLE_DELIVERIES = r"""
WITH d AS (SELECT doc_id, CASE WHEN source <= 'src14' THEN 1 ELSE 2 END AS delivery, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
k AS (SELECT h, doc_id AS keep_id FROM d QUALIFY row_number() OVER (PARTITION BY h ORDER BY delivery, n DESC, doc_id) = 1)
SELECT delivery, doc_id, keep_id, doc_id = keep_id AS kept FROM d JOIN k USING (h)"""

ORACLE_OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  first_value(doc_id) OVER w = doc_id AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id)"""
