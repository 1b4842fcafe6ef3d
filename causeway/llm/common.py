"""Shared pieces of the training-data operators: word patterns, texts and tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.storage import materialize, scratch_path

__all__ = ["SPACE", "WORD", "hashable", "materialize", "read_table", "scratch_path", "text_of"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII white space, which separate words.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def hashable(df: DataFrame, columns: list[str]) -> list[Column]:
    """``columns`` as values that can be hashed and ordered: those that hold maps or variants as JSON."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if re.search(r"map<|variant|interval|udt", kinds[c]) else F.col(f"`{c}`") for c in columns]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
