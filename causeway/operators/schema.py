"""Schema changes: statements, evolution, differences, and what they mean for a deployment.

Statements are rows, which ``statements`` reads; this module knows what their changes are worth and what they leave of a schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.statements import actions, create_tables, statements
from causeway.storage import materialize

__all__ = ["actions", "changes", "create_tables", "deployment_status", "difference", "evolve", "explanation_key", "lookup", "primary", "statements"]

# kind: category, severity
KINDS = {
    "DROP_TABLE": ("DESTRUCTIVE", "HIGH"),
    "DROP_COLUMN": ("DESTRUCTIVE", "HIGH"),
    "ADD_COLUMN": ("ADDITIVE", "LOW"),
    "ALTER_NULLABILITY": ("DATA_DEPENDENT", "MEDIUM"),
    "ALTER_COLUMN_TYPE": ("DATA_DEPENDENT", "MEDIUM"),
    "UNSUPPORTED_SCHEMA_CHANGE": ("UNSUPPORTED", "INFO"),
}
# Rank of a category for the primary change.
PRIORITY = {"DESTRUCTIVE": 5, "DATA_DEPENDENT": 4, "LOCKING": 3, "ADDITIVE": 2, "UNSUPPORTED": 1}


def lookup(col: Column, table: dict[str, object], other: object = None) -> Column:
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)).otherwise(out)
    return out


def changes(stmts: DataFrame) -> DataFrame:
    """``stmts`` (statement) with action, kind, table, object_name, after (type), category and severity; one row per action."""
    out = actions(stmts)
    return out.withColumns({"category": lookup(F.col("kind"), {k: v[0] for k, v in KINDS.items()}), "severity": lookup(F.col("kind"), {k: v[1] for k, v in KINDS.items()})})


def evolve(columns: DataFrame, changed: DataFrame, order: str = "ordinal") -> DataFrame:
    """Columns (table, column, data_type, nullable) after ``changed`` (kind, table, object_name, after), in the order of ``order``.

    DROP_TABLE takes all columns, ADD_TABLE makes an empty table where there is none, and changes of a table or column that isn't there
    do nothing. Nothing goes through the changes one by one: a table's last drop and what made it anew tell which changes count, and one
    aggregate per column finds its birth (in the old schema, or its last ADD or DROP), the last type and the last NOT NULL since.
    """
    first = F.lit(-(1 << 63))
    had = columns.select("table", F.col("column").alias("name"), F.lit("HAD").alias("kind"), F.col("data_type").alias("after"), "nullable", first.alias("at"))
    rows = changed.select("table", F.col("object_name").alias("name"), "kind", "after", F.lit(True).alias("nullable"), F.col(order).cast("long").alias("at"))
    rows = materialize(rows.filter("kind <> 'UNSUPPORTED_SCHEMA_CHANGE'"), "changes")

    # of a table: its last drop, and the first ADD_TABLE after it, which is one that no other ADD_TABLE precedes
    whole = rows.filter("kind IN ('DROP_TABLE', 'ADD_TABLE')")
    before = F.lag("kind").over(Window.partitionBy("table").orderBy("at"))
    whole = whole.withColumn("makes", (F.col("kind") == "ADD_TABLE") & ~before.eqNullSafe(F.lit("ADD_TABLE")))
    tables = whole.unionByName(had.select("table", "kind", "at").distinct(), allowMissingColumns=True).groupBy("table").agg(
        F.max(F.when(F.col("kind") == "DROP_TABLE", F.col("at"))).alias("dropped"), F.max(F.when(F.col("makes"), F.col("at"))).alias("made"), F.bool_or(F.col("kind") == "HAD").alias("was")
    )
    stays = F.col("dropped").isNull() & F.col("was")
    again = F.col("made").isNotNull() & (F.col("dropped").isNull() | (F.col("made") > F.col("dropped")))
    since = tables.filter(stays | again).select("table", F.when(stays, first).otherwise(F.col("made")).alias("since"), stays.alias("stays"))

    counted = rows.filter("name IS NOT NULL AND kind NOT IN ('DROP_TABLE', 'ADD_TABLE')").unionByName(had).join(since, "table").filter(F.when(F.col("kind") == "HAD", F.col("stays")).otherwise(F.col("at") > F.col("since")))
    last = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("at"))
    births, types = last("HAD", "ADD_COLUMN", "DROP_COLUMN"), F.when(F.col("after").isNotNull(), last("HAD", "ADD_COLUMN", "ALTER_COLUMN_TYPE"))
    facts = counted.groupBy("table", "name").agg(
        F.max(births).alias("born"), F.max_by("kind", births).alias("birth"), F.max_by("nullable", births).alias("open"), F.max(types).alias("typed"), F.max_by("after", types).alias("type"), F.max(last("ALTER_NULLABILITY")).alias("strict")
    )
    kind = F.when(F.col("typed") >= F.col("born"), F.col("type")).otherwise(F.when(F.col("birth") == "ADD_COLUMN", "UNKNOWN"))
    nullable = F.coalesce("open", F.lit(True)) & ~F.coalesce(F.col("strict") > F.col("born"), F.lit(False))
    return facts.filter("birth IN ('HAD', 'ADD_COLUMN')").select("table", F.col("name").alias("column"), kind.alias("data_type"), nullable.alias("nullable"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """ADDED, REMOVED, CHANGED or UNCHANGED per column of either schema."""
    facts = F.struct("data_type", "nullable")
    both = old.select("table", "column", facts.alias("o")).join(new.select("table", "column", facts.alias("n")), ["table", "column"], "full_outer")
    status = F.when(F.col("o").isNull(), "ADDED").when(F.col("n").isNull(), "REMOVED").when(F.col("o").eqNullSafe(F.col("n")), "UNCHANGED").otherwise("CHANGED")
    return both.select("table", "column", status.alias("status"), F.col("o.data_type").alias("old_type"), F.col("n.data_type").alias("new_type"))


def shown_differences(diff: DataFrame) -> DataFrame:
    """The rows of ``difference`` that reports show, with ``rank``: what was removed first, then changed, then added; unchanged ones are hidden."""
    rank = F.when(F.col("status") == "REMOVED", 0).when(F.col("status") == "CHANGED", 1).otherwise(2)
    return diff.filter("status <> 'UNCHANGED'").withColumn("rank", rank)


def primary(changed: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the change of the highest category, then severity, then first in order (statement, then action)."""
    rank = lookup(F.col("severity"), {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}, 0)
    order = Window.partitionBy(*by).orderBy(F.desc(lookup(F.col("category"), PRIORITY, 0)), F.desc(rank), "ordinal", *(["action"] if "action" in changed.columns else []))
    return changed.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def deployment_status(category: Column, has_affected: Column) -> Column:
    return F.when(category.isin("DESTRUCTIVE", "LOCKING"), "UNSAFE").when(category == "DATA_DEPENDENT", F.when(has_affected, "UNSAFE").otherwise("COMPATIBLE")).when(category == "ADDITIVE", "SAFE").otherwise("UNKNOWN")


def explanation_key(kind: Column, has_affected: Column) -> Column:
    active = F.when(has_affected, "active_dependency").otherwise("no_dependency")
    out = F.when(kind == "DROP_COLUMN", F.concat(F.lit("drop_column_"), active)).when(kind == "DROP_TABLE", F.concat(F.lit("drop_table_"), active))
    return out.when(kind == "ALTER_NULLABILITY", "not_null_data_dependent").when(kind == "ALTER_COLUMN_TYPE", "type_narrowing_data_dependent").when(kind == "ADD_COLUMN", "additive_safe_change").otherwise("unsupported_change")
