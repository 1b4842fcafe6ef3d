"""Canonical output: rows in a fixed order, and digests that don't depend on how rows were dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes that a node of a digest tree joins, on average.
FAN = 256


def ascii_json(value: Column) -> Column:
    """A value as compact JSON in ASCII: names as they stand, nulls written, and every other character as \\u and its four digits (two of
    them beyond the first plane)."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        pair = F.concat(unit(F.lit(0xD800) + F.call_function("shiftright", code - 0x10000, F.lit(10))), unit(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))))
        return F.when(code < 0x80, c).when(code < 0x10000, unit(code)).otherwise(pair)

    # what is ASCII already needs no look at its characters
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))


def sorted_struct(df: DataFrame, *without: str) -> Column:
    """A row's columns by name."""
    return F.struct(*sorted(c for c in df.columns if c not in without))


def change_set_hash(diff: DataFrame) -> DataFrame:
    """``sha256`` of a snapshot diff (path, status, old_sha256, new_sha256): a digest tree over its files in ASCII JSON."""
    return digest_of(diff.select(F.sha2(ascii_json(sorted_struct(diff)), 256).alias("h")))


def write_canonical(df: DataFrame, target: str) -> None:
    """JSON lines with columns by name and rows in the order of all columns; nulls are written."""
    columns = sorted(df.columns)
    df.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns).write.option("ignoreNullFields", False).json(target)


def graph_document(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, place, line``: the canonical document of a graph: nodes by id, then edges by source, target and kind, a line of ASCII JSON each."""
    from causeway.operators.decision import numbered

    nodes = numbered(entities.select("entity_id", ascii_json(sorted_struct(entities)).alias("line")), [], [F.asc("entity_id"), F.asc("line")])
    links = numbered(edges.select("source", "target", "kind", ascii_json(sorted_struct(edges)).alias("line")), [], [F.asc("source"), F.asc("target"), F.asc("kind"), F.asc("line")])
    return nodes.select(F.lit("nodes").alias("section"), "place", "line").unionByName(links.select(F.lit("edges").alias("section"), "place", "line"))


def joined(column: str) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ","), 256)


def digest_of(hashes: DataFrame) -> DataFrame:
    """One row ``sha256`` over ``hashes`` (h, hexadecimal): a tree whose leaves share the first digits of a hash.

    Leaves have four digits, and four more for each 65536-fold number of rows, so that a node joins a bounded number of hashes at any size:
    those of a leaf in order, those of inner nodes in the order of their digits.
    """
    n, digits = hashes.count(), 4
    while n > FAN * 16**digits:
        digits += 4
    level = hashes.groupBy(F.substring("h", 1, digits).alias("b")).agg(joined("h").alias("h"))
    while digits > 0:
        digits -= 4
        inner = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ","), 256)
        level = level.groupBy(F.substring("b", 1, digits).alias("p")).agg(inner.alias("h")).withColumnRenamed("p", "b") if digits else level.agg(inner.alias("sha256"))
    return level


def digest(df: DataFrame) -> DataFrame:
    """One row ``sha256`` of all rows, whatever their order: a digest tree over the hashes of rows as JSON."""
    return digest_of(df.select(F.sha2(F.to_json(sorted_struct(df), {"ignoreNullFields": "false"}), 256).alias("h")))


def with_hash(df: DataFrame, name: str = "deterministic_hash") -> DataFrame:
    """``df`` with the digest of each row's other columns in ASCII JSON, by name and with nulls, as ``name``; an older digest there doesn't count."""
    return df.select(*[c for c in df.columns if c != name], F.sha2(ascii_json(sorted_struct(df, name)), 256).alias(name))
