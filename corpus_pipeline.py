"""A corpus pipeline: language, exact copies, near copies, mixture, packing. Each stage is written and read again.

Every stage works on all rows it is given, whole texts, null or not, keeps an empty table empty, and ignores columns that ``documents``
doesn't have. Of rows that repeat both id and text, ``exact`` leaves one; the other stages treat each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import materialize, read_table, text_of
from causeway.llm.exact import deduplicate, new_index
from causeway.llm.language import UNDETERMINED, held_out, identify, train
from causeway.llm.minhash import near_duplicates
from causeway.llm.mixing import mix, n_words, repeat_rows
from causeway.llm.packing import pack_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_id(doc_id: str) -> Column:
    """The id, with null as the least number."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and texts without a letter go."""
    labelled = read_table(spark, sf_dir, "documents")
    model = train(labelled.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space; the longest, then the one of smallest id."""
    index = new_index(spark)
    kept = deduplicate(docs.select(*COLUMNS), index).filter("kept").dropDuplicates(["doc_id", "digest"]).select(*COLUMNS)
    index.drop()
    return kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    kept = near_duplicates(docs).filter("kept").select(row_id("doc_id").alias("__row"), "node").distinct()
    rows = docs.select(*COLUMNS, row_id("doc_id").alias("__row"), F.unhex(F.md5(text_of(docs))).alias("node"))
    return rows.join(kept, ["__row", "node"], "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of the sources takes them. The sampling sees ids, sources and numbers of words alone."""
    keys = ["__row", "__h0", "__h1"]
    keyed = docs.select(*COLUMNS, row_id("doc_id").alias("__row"), F.xxhash64(*COLUMNS).alias("__h0"), F.xxhash64(F.lit(1), *COLUMNS).alias("__h1"))
    sizes = materialize(keyed.select("doc_id", "source", *keys, n_words(text_of(keyed)).alias("words")), "sizes")
    copies = mix(sizes, F.col("words")).filter("copies > 0").groupBy(*keys).agg(F.sum("copies").alias("copies"))
    # rows that repeat in all columns meet here and come back as often as all of them are taken
    return repeat_rows(keyed.dropDuplicates(keys).join(copies, keys), COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]

#: SQL expresses only the stage of exact copies; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
