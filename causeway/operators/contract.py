"""Differences of API contracts, over rows of operations, parameters, responses and schema nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rule(df: DataFrame, rule: str, compatibility: Column | str, location: Column) -> DataFrame:
    status = F.lit(compatibility) if isinstance(compatibility, str) else compatibility
    return df.select("path", "method", F.lit(rule).alias("rule_id"), location.alias("location"), status.alias("compatibility"))


def endpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Operations (path, method) that went or came.

    Either side may be read from few large texts, whose size says little of the rows: they are merged, so that none is planned to be sent whole
    through the driver.
    """
    gone, came = old.join(new.hint("merge"), ["path", "method"], "left_anti"), new.join(old.hint("merge"), ["path", "method"], "left_anti")
    return _rule(gone, "API-ENDPOINT-REMOVED", "BREAKING", F.lit("endpoint")).unionByName(_rule(came, "API-ENDPOINT-ADDED", "SAFE", F.lit("endpoint")))


def parameters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parameters (path, method, name, location, required): removed, required ones added or made so, moved."""
    key = ["path", "method", "name"]
    both = old.select(*key, F.col("location").alias("ol"), F.col("required").alias("oreq")).join(new.select(*key, F.col("location").alias("nl"), F.col("required").alias("nreq")), key, "full_outer")
    at = F.concat(F.lit("parameters."), F.col("name"))
    rules = [
        (F.col("nl").isNull(), "API-PARAM-REMOVED", "BREAKING"),
        (F.col("nl").isNotNull() & F.col("nreq") & ~F.coalesce("oreq", F.lit(False)), "API-REQUIRED-ADDED", "BREAKING"),
        (F.col("ol").isNotNull() & (F.col("ol") != F.col("nl")), "API-PARAM-LOCATION-CHANGED", "CAUTION"),
    ]
    return reduce(DataFrame.unionByName, [_rule(both.filter(test), rule, status, at) for test, rule, status in rules])


def responses(old: DataFrame, new: DataFrame) -> DataFrame:
    """Response statuses (path, method, status) that went or came."""
    key = ["path", "method", "status"]
    at = F.concat(F.lit("responses."), F.col("status"))
    return _rule(old.join(new, key, "left_anti"), "API-RESPONSE-REMOVED", "BREAKING", at).unionByName(_rule(new.join(old, key, "left_anti"), "API-RESPONSE-ADDED", "SAFE", at))


def security(old: DataFrame, new: DataFrame) -> DataFrame:
    """Operations (path, method, security array) that ask for a scheme now and asked for none before."""
    both = old.select("path", "method", F.col("security").alias("o")).join(new.select("path", "method", F.col("security").alias("n")), ["path", "method"])
    return _rule(both.filter((F.size("n") > 0) & (F.coalesce(F.size("o"), F.lit(0)) <= 0)), "API-SECURITY-REQUIRED", "CAUTION", F.lit("security"))


def path_of(nodes: DataFrame) -> Column:
    """The names down to a node: its column ``names``, or else its location, cut at dots."""
    return F.col("names") if "names" in nodes.columns else F.when(F.col("location") == "", F.array().cast("array<string>")).otherwise(F.split("location", r"\."))


def schema_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (path, method, direction, names, type, required, enum) of flattened schemas: types, values and properties.

    ``names`` lead down to the node; ``[]`` stands for the items of an array, and the whole schema has none. Without that column a location
    of names joined by dots is read, in which a name with a dot looks like two. Of a subtree that went or came, the top alone is
    told; items that went or came say nothing. A property that became required counts where its object had required ones before.
    """
    key = ["path", "method", "direction", "names"]
    rows = lambda df, side: df.select(*key[:3], path_of(df).alias("names"), F.struct("type", "required", "enum").alias(side))
    both = rows(old, "o").join(rows(new, "n"), key, "full_outer")
    deep = F.size("names") > 0
    both = both.withColumn("name", F.when(deep, F.element_at("names", -1)).otherwise("")).withColumn("parent", F.when(deep, F.slice("names", 1, F.size("names") - 1)))
    up = [*key[:3], "parent"]
    lone = both.filter("o IS NULL OR n IS NULL")
    below = lone.filter(deep).select(*key[:3], F.col("names").alias("parent"), F.lit(True).alias("inside"))
    # the node above is there on both sides, or is the schema itself
    tops = lone.join(below.hint("merge"), up, "left").filter("inside IS NULL AND name <> '[]'")
    kept = both.filter("o IS NOT NULL AND n IS NOT NULL")
    held = both.filter("o.required").select(*up).distinct()
    at = F.concat_ws(".", "direction", "names")
    new_values = F.size(F.coalesce("n.enum", F.array().cast("array<string>"))) > 0
    old_values = F.size(F.coalesce("o.enum", F.array().cast("array<string>"))) > 0
    removed = F.when(F.col("direction") == "RESPONSE", "BREAKING").otherwise("CAUTION")
    named = F.concat_ws(".", "direction", "parent", F.lit("required"), "name")
    newly = both.filter(F.col("n.required") & ~F.coalesce("o.required", F.lit(False))).join(held.hint("merge"), up, "left_semi")
    newly = newly.join(below.hint("merge"), up, "left_anti")
    return reduce(
        DataFrame.unionByName,
        [
            _rule(tops.filter(F.col("n").isNull() & (deep | (F.col("direction") == "RESPONSE"))), "API-PROPERTY-REMOVED", removed, at),
            _rule(tops.filter(F.col("o").isNull() & F.col("n.required")), "API-REQUIRED-ADDED", "BREAKING", at),
            _rule(newly, "API-REQUIRED-ADDED", "BREAKING", named),
            _rule(kept.filter(F.col("o.type") != F.col("n.type")), "API-TYPE-NARROWED", "BREAKING", at),
            _rule(kept.filter(new_values & old_values & (F.size(F.array_except("o.enum", "n.enum")) > 0)), "API-ENUM-VALUE-REMOVED", "BREAKING", at),
            _rule(kept.filter(new_values & ~old_values), "API-ENUM-CONSTRAINT-ADDED", "BREAKING", at),
        ],
    )


def status(changes: DataFrame) -> DataFrame:
    """BREAKING over UNKNOWN over CAUTION over SAFE."""
    rank = F.when(F.col("compatibility") == "BREAKING", 3).when(F.col("compatibility") == "UNKNOWN", 2).when(F.col("compatibility") == "CAUTION", 1).otherwise(0)
    worst = F.coalesce(F.max(rank), F.lit(0))
    return changes.agg(F.get(F.array(*map(F.lit, ("SAFE", "CAUTION", "UNKNOWN", "BREAKING"))), worst).alias("status"), F.count("*").alias("n_changes"))
