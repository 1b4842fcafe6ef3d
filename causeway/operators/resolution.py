"""Which symbols do references mean, and which columns do statements of a program touch?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a literal reads columns.
SELECT = r"(?i)^\s*SELECT\s+(.+?)\s+FROM\s+([A-Za-z_]\w*)"
# What a statement must look like for each operation that names no columns.
WHOLE = {"UPDATE": r"(?i)^\s*UPDATE\s+([A-Za-z_]\w*)\s+SET\s+.", "INSERT": r"(?i)^\s*INSERT\s+INTO\s+([A-Za-z_]\w*)", "DELETE": r"(?i)^\s*DELETE\s+FROM\s+([A-Za-z_]\w*)"}


def resolve(refs: DataFrame, levels: list[tuple[Column, DataFrame]]) -> DataFrame:
    """``refs`` with ``level`` (0: none) and ``state``: RESOLVED, AMBIGUOUS or UNRESOLVED.

    ``levels`` are pairs of a key of the references and a table of symbols (key), best first. The first level with any candidate decides.
    Symbols are counted by key before they meet references, so that a name that many symbols share makes no more rows.
    """
    out, level, hits = refs, F.lit(0), F.lit(None).cast("long")
    for i, (key, symbols) in reversed(list(enumerate(levels, 1))):
        counted = symbols.groupBy(F.col("key").alias(f"_key{i}")).agg(F.count("*").alias(f"_n{i}"))
        out = out.join(counted, key == F.col(f"_key{i}"), "left")
        found = F.col(f"_n{i}").isNotNull()
        level, hits = F.when(found, i).otherwise(level), F.when(found, F.col(f"_n{i}")).otherwise(hits)
    state = F.when(hits.isNull(), "UNRESOLVED").when(hits == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return out.select(*refs.columns, level.alias("level"), state.alias("state"))


def sql_accesses(literals: DataFrame) -> DataFrame:
    """``table, column, operation`` of each SQL text (column ``statement``); changes of rows name no column, other texts give no rows."""
    s = F.col("statement")
    entry = "array<struct<table:string,column:string,operation:string>>"
    found = F.array().cast(entry)
    for operation, form in reversed(WHOLE.items()):
        found = F.when(s.rlike(form), F.array(F.struct(F.regexp_extract(s, form, 1).alias("table"), F.lit("unknown").alias("column"), F.lit(operation).alias("operation")))).otherwise(found)
    names = F.filter(F.transform(F.split(F.regexp_extract(s, SELECT, 1), ","), lambda c: F.trim(c)), lambda c: c != "")
    read = F.transform(names, lambda c: F.struct(F.regexp_extract(s, SELECT, 2).alias("table"), c.alias("column"), F.lit("SELECT").alias("operation")))
    found = F.when(s.rlike(SELECT), read).otherwise(found)
    return literals.select(*literals.columns, F.explode(found).alias("_a")).select(*[c for c in literals.columns if c != "statement"], "_a.table", "_a.column", "_a.operation")


def _masked(df: DataFrame) -> DataFrame:
    """``df`` (route) with the segments ``_parts`` and ``_mask``, a 1 for each segment that is a parameter."""
    parts = F.split("route", "/")
    return df.withColumn("_parts", parts).withColumn("_mask", F.array_join(F.transform(parts, lambda s: F.when(s.rlike(r"^\{.*\}$"), "1").otherwise("0")), ""))


def match_routes(calls: DataFrame, providers: DataFrame) -> DataFrame:
    """Distinct ``calls`` (method, host, route) with ``n_candidates``, ``entity`` and ``state``: MATCHED, AMBIGUOUS or UNRESOLVED.

    ``providers`` have method, host, route and entity; routes are normalized. A parameter on either side fits any segment, a call
    with an empty host fits providers of all hosts. Clients count only where nothing else offers the route; ``entity`` is set if
    just one is left.

    Calls and providers never meet pair by pair: for each two masks of parameters that occur, they are joined on the segments that
    are no parameter in either, which is a join on equality.
    """
    wanted = _masked(calls.select("method", F.coalesce("host", F.lit("")).alias("host"), "route").distinct()).withColumnRenamed("_mask", "_w")
    hosts = F.array_distinct(F.array(F.coalesce("host", F.lit("")), F.lit("")))
    offered = _masked(providers.select("method", F.explode(hosts).alias("host"), "route", "entity").distinct()).withColumnRenamed("_mask", "_o")
    masks = wanted.select("method", "_w").distinct().join(offered.select(F.col("method").alias("_m"), "_o").distinct(), (F.col("method") == F.col("_m")) & (F.length("_w") == F.length("_o"))).drop("_m")
    fixed = F.array_join(F.transform("_parts", lambda s, i: F.when((F.substring(F.col("_w"), i + 1, F.lit(1)) == "1") | (F.substring(F.col("_o"), i + 1, F.lit(1)) == "1"), "{}").otherwise(s)), "/").alias("_fixed")
    at = ["method", "host", "_w", "_o", "_fixed"]
    asked = wanted.join(masks, ["method", "_w"]).select(*at[:-1], "route", fixed)
    held = offered.join(masks, ["method", "_o"]).select(*at[:-1], "entity", fixed)
    serves = F.when(~F.substring_index("entity", ".", -1).endswith("Client"), F.col("entity"))
    found = asked.join(held, at).groupBy("method", "host", "route").agg(F.count_distinct("entity").alias("_all"), F.min("entity").alias("_any"), F.count_distinct(serves).alias("_n"), F.min(serves).alias("_one"))
    n, one = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.coalesce("_all", F.lit(0))), F.coalesce("_one", "_any")
    out = wanted.select("method", "host", "route").join(found, ["method", "host", "route"], "left")
    return out.select("method", "host", "route", n.alias("n_candidates"), F.when(n == 1, one).alias("entity"), F.when(n == 1, "MATCHED").when(n == 0, "UNRESOLVED").otherwise("AMBIGUOUS").alias("state"))


def breaking_entities(changes: DataFrame, registry: DataFrame) -> DataFrame:
    """Entities (entity) behind routes that break. ``registry`` has path, method, entity and ordinal; of one route the last entry counts."""
    last = registry.groupBy("path", "method").agg(F.max_by("entity", "ordinal").alias("entity"))
    return changes.filter("compatibility = 'BREAKING'").select("path", "method").distinct().join(last, ["path", "method"]).select("entity").distinct()


def application_dependencies(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """What a version depends on, from its graph: ``family`` SCHEMA (what it reads of a database) or API (routes it consumes) and ``dependency``.

    A consumed entity without a route in ``registry`` (entity, method, path, ordinal) stands for itself; of several the last counts.
    """
    used = edges.filter(F.col("kind").isin("DB_READ", "API_CONSUMES")).select("source", "kind").distinct()
    last = registry.groupBy("entity").agg(F.max_by(F.concat_ws(" ", "method", "path"), "ordinal").alias("_route"))
    named = used.join(last, used["source"] == last["entity"], "left")
    api = F.col("kind") == "API_CONSUMES"
    return named.select(F.when(api, "API").otherwise("SCHEMA").alias("family"), F.when(api, F.coalesce("_route", "source")).otherwise(F.col("source")).alias("dependency")).distinct()


# Words that speak for a class being a file's main one, endings that do, and names that speak against it.
MAIN_WORDS, MAIN_ENDINGS, MINOR_NAMES = ("client", "service", "api", "controller", "handler"), ("Service", "Client", "API"), ("response", "row", "payload", "dto")


def primary_classes(classes: DataFrame) -> DataFrame:
    """Of each ``file`` its main class (of ``name``, ``start``): best by name, then the one declared last."""
    name, lower = F.col("name"), F.lower("name")
    score = F.when(lower.rlike("|".join(MAIN_WORDS)), 3).otherwise(0) + F.when(name.rlike(f"(?:{'|'.join(MAIN_ENDINGS)})$"), 2).otherwise(0) - F.when(lower.isin(*MINOR_NAMES), 5).otherwise(0)
    return classes.groupBy("file").agg(F.max_by("name", F.struct(score.alias("score"), "start")).alias("name"))
