"""Snapshots of files in folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.snapshots import classify, digest, ignored, language
from causeway.sources.store import list_files


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below root), ``size`` and ``content`` of all files below ``root``, but for folders that analyses leave out.

    Queries that don't ask for the content don't read it. Spark gives no rows for empty files, so these come from a listing of folders in tasks.
    """
    below = F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/").split("://")[-1] + r"\E/", "").alias("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    full = files.select(below, F.col("length").alias("size"), "content")
    empty = list_files(spark, root).filter("size = 0").select("path", "size", F.lit("").cast("binary").alias("content"))
    return full.unionByName(empty).filter(~ignored(F.col("path")))


def manifest(files: DataFrame) -> DataFrame:
    """``path, size, sha256, class, language`` of every file."""
    path = F.col("path")
    return files.select("path", "size", digest(F.col("content")).alias("sha256"), classify(path).alias("class"), language(path).alias("language"))


def texts(files: DataFrame, suffix: str) -> DataFrame:
    """``path, text`` of the files with this suffix, as ``schema.statements`` reads them."""
    return files.filter(F.lower("path").endswith(suffix)).select("path", F.decode("content", "UTF-8").alias("text"))
