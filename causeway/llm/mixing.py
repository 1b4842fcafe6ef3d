"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies, ``target / source_size``. The documents of a source
stand in one order; the prefix sum of expected copies plus one random offset per source crosses an integer once for each
copy that a document gets. Documents stand by narrow classes of size, so that the words taken follow the target closely.

The prefix sum needs no window over a whole source: documents fall into blocks (source, size class, hash of the id), a
block's rows are ranked within it, and the offsets of the blocks come from a table of counts per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import WORD, hashable, materialize, read_table, text_of

#: Blocks of one size class of one source; a class of a source that holds a third of all rows falls into so many tasks.
BLOCKS = 256
#: Size classes per doubling of the size.
STEPS = 16


def source_key(col: Column) -> Column:
    """A string that is never null, with null last in the order of code points."""
    return F.coalesce(F.concat(F.lit("0"), col.cast("string")), F.lit("1"))


def targets(totals: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Adds ``target`` to one row per source with ``key`` and ``source_size``.

    Sources in the order of ``key`` have the weights in turn and share the sum of all sizes. A target stops at ``cap`` times
    its source's size; what is over goes to the others by weight. With sources by rising ratio of cap to weight, the first
    that the level of the rest doesn't fill sets the level for all later ones.
    """
    everything = Window.partitionBy()
    order = Window.orderBy("key")
    rising = Window.orderBy("ratio", "key")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    most = F.col("source_size") * F.lit(float(cap))
    t = totals.withColumn("weight", w).withColumn("most", most).withColumn("ratio", F.col("most") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / rest)
    t = t.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
    filled = F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most"))
    return t.select("key", "source_size", filled.alias("target"))


def mix(docs: DataFrame, size: Column, *, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: int = 17, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (long: how often the mix takes the row) added.

    The names added win over columns of the same names in ``docs``. A null source is a source of its own; a null size counts
    as 0; repeated rows are sampled each for itself; an empty table gives an empty table. A source of size 0 has the target 0
    and its documents no copies. ``copies`` is never above ``ceil(cap)``, and reruns give the same.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    rows = docs.withColumn("__size", F.coalesce(size, F.lit(0)).cast("long")).withColumn("__key", source_key(F.col(source)))
    rows = rows.withColumn("__class", F.floor(F.log2(F.col("__size") + 1) * STEPS).cast("int"))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col("__size")), F.lit(BLOCKS)).cast("int"))
    place = ["__key", "__class", "__block"]
    blocks = materialize(rows.groupBy(*place).agg(F.count("*").alias("__n"), F.sum("__size").alias("__sum")), "blocks")
    plan = targets(blocks.groupBy(F.col("__key").alias("key")).agg(F.sum("__sum").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("__key").orderBy("__class", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    blocks = blocks.join(plan, blocks["__key"] == plan["key"]).select(*place, "__before", "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole, part = F.floor(each), each - F.floor(each)
    at = F.col("__before") + F.col("__rank")

    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("__key")), F.lit(1 << 20)) / float(1 << 20)
    crossed = F.floor(offset + part * at) - F.floor(offset + part * (at - 1))
    ranked = rows.select(*keep, "__size", *place, F.row_number().over(Window.partitionBy(*place).orderBy("__size", F.col(doc_id), F.xxhash64(*hashable(docs, keep)))).alias("__rank"))
    return ranked.join(blocks, place).select(*keep, F.col("__size").alias("size"), "source_size", "target", (whole + crossed).cast("long").alias("copies"))


def repeat_rows(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row as often as its ``copies`` say; a row whose copies are null or 0 is gone. Rows that repeat count each for itself."""
    return mixed.filter("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def op2_mix_sources(spark, sf_dir):
    """Mixes all documents by word counts: one row per document with the words taken."""
    docs = read_table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", n_words(text_of(docs)).alias("words")), "sizes")
    mixed = mix(sized, F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
