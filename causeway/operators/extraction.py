"""What was read from source files: counts, changes of structure, and import edges between the entities of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses of references that name a symbol, kinds of imports, kinds of symbols that are entities.
RESOLVED = ("EXACT", "IMPORTED", "QUALIFIED", "PROJECT_UNIQUE")
IMPORTS = ("import", "from_import", "from_import_aliased")
ENTITIES = ("CLASS", "DATA_CLASS")


def counts(files: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Per language of ``files`` (file, language): files, ``symbols`` (file), ``references`` (file, status), and how many of these are resolved or not.

    Both tables are counted by file before they meet the files.
    """
    held = symbols.groupBy("file").agg(F.count("*").alias("s"))
    status = F.col("status")
    named = references.groupBy("file").agg(F.count("*").alias("r"), F.count_if(status.isin(*RESOLVED)).alias("ok"), F.count_if(status == "UNRESOLVED").alias("open"))
    both = files.select("file", "language").join(held, "file", "left").join(named, "file", "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return both.groupBy("language").agg(F.count("*").alias("n_files"), total("s", "n_symbols"), total("r", "n_references"), total("ok", "n_resolved"), total("open", "n_unresolved"))


def structural_changes(old: DataFrame, new: DataFrame, old_files: DataFrame, new_files: DataFrame) -> DataFrame:
    """``file, kind, name, change`` of symbols (file, kind, name) that went or came; the files (file, status) tell which were read.

    What could not be read was not removed: files that failed on either side make no claims.
    """
    failed = old_files.unionByName(new_files).filter("status <> 'SUCCESS'").select("file").distinct()
    key = ["file", "kind", "name"]
    sides = old.select(*key, F.lit("REMOVED").alias("change")).unionByName(new.select(*key, F.lit("ADDED").alias("change"))).distinct()
    lone = sides.groupBy(*key).agg(F.count("*").alias("n"), F.first("change").alias("change")).filter("n = 1").drop("n")
    return lone.join(failed, "file", "left_anti")


def primary_entities(symbols: DataFrame) -> DataFrame:
    """``file, entity_id``: the first class of each file of ``symbols`` (file, symbol_id, kind, line, column, entity_id)."""
    classes = symbols.filter(F.col("kind").isin(*ENTITIES) & F.col("entity_id").isNotNull())
    return classes.groupBy("file").agg(F.min_by("entity_id", F.struct("line", "column", "symbol_id")).alias("entity_id"))


def import_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """``source, target, kind`` of resolved imports: from the first class of the file to the entity of the symbol, without loops and repeats."""
    wanted = references.filter(F.col("status").isin(*RESOLVED) & F.col("import_kind").isin(*IMPORTS)).select("file", F.col("resolved_symbol_id").alias("symbol_id")).distinct()
    targets = symbols.filter("entity_id IS NOT NULL").select("symbol_id", F.col("entity_id").alias("target"))
    edges = wanted.join(primary_entities(symbols).withColumnRenamed("entity_id", "source"), "file").join(targets, "symbol_id")
    return edges.filter("source <> target").select("source", "target", F.lit("IMPORT").alias("kind")).distinct()


def inspection(symbols: DataFrame, references: DataFrame, entities: DataFrame, digest: DataFrame) -> DataFrame:
    """One row: files, symbols, references by whether they were resolved, entities, and the ``digest`` (sha256) of the graph."""
    resolved = F.col("status").isin(*RESOLVED)
    of_symbols = symbols.agg(F.count_distinct("file").alias("n_files"), F.count("*").alias("n_symbols"))
    of_references = references.agg(F.count("*").alias("n_references"), F.count_if(resolved).alias("n_resolved"), F.count_if(F.col("status") == "UNRESOLVED").alias("n_unresolved"))
    return of_symbols.join(of_references).join(entities.agg(F.count("*").alias("n_entities"))).join(digest.select(F.col("sha256").alias("graph_sha256")))
