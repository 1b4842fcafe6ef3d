"""Files as tasks see them: listed and opened by URI, with reads of ranges, wherever pyarrow has a file system for the scheme."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.storage import materialize

LISTED = "path string, name string, is_dir boolean, size long"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a local path."""
    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path) if uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def opened(uri: str) -> pa.NativeFile:
    """A file that can be read from any place; only what is asked for is read."""
    system, path = place(uri)
    return system.open_input_file(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below root), ``uri`` and ``size`` of all files below ``root``, empty ones too.

    Folders are listed level by level: each level is a table whose folders are dealt to tasks, and what reaches the driver is whether one is left.
    """
    base = root.rstrip("/")

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                system, path = place(f"{base}/{folder}" if folder else base)
                found = system.get_file_info(fs.FileSelector(path))
                prefix = f"{folder}/" if folder else ""
                yield pd.DataFrame([(prefix + i.base_name, i.base_name, i.type == fs.FileType.Directory, i.size) for i in found], columns=["path", "name", "is_dir", "size"])

    level, files, k = spark.createDataFrame([("",)], "path string"), None, 0
    while True:
        here = materialize(level.mapInPandas(below, LISTED), f"folders{k}")
        own = here.filter("NOT is_dir").select("path", F.concat(F.lit(f"{base}/"), "path").alias("uri"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
        files = own if files is None else files.unionByName(own)
        level, k = here.filter("is_dir").select("path"), k + 1
        if level.isEmpty():
            return files
        level = level.repartition(max(1, min(1000, level.count())), "path")
