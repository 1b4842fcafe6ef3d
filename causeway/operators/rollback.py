"""Could the previous version still run against the new state, and the new one against it?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.contract import path_of


def schema_dependencies(deps: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings for ``deps`` (dependency = table.column, or a table alone) of the old version against both schemas."""

    def keyed(df: DataFrame, p: str) -> DataFrame:
        # a dot follows the table, so that a table alone never meets a column
        each = df.select(F.concat_ws(".", "table", "column").alias("dependency"), F.col("data_type").alias(f"{p}t"), F.col("nullable").alias(f"{p}n"), F.lit(True).alias(f"{p}has"))
        whole = df.select(F.col("table").alias("dependency"), F.lit(None).cast("string").alias(f"{p}t"), F.lit(None).cast("boolean").alias(f"{p}n"), F.lit(True).alias(f"{p}has"))
        return each.unionByName(whole.distinct())

    both = deps.join(keyed(old, "o"), "dependency", "left").join(keyed(new, "n"), "dependency", "left")
    kept = F.col("ohas") & F.col("nhas")
    rule = F.when(F.col("ohas") & F.col("nhas").isNull(), "RB-SCHEMA-REMOVED-OLD-DEPENDENCY").when(kept & (F.col("ot") != F.col("nt")), "RB-SCHEMA-TYPE-CHANGED").when(kept & F.col("on") & ~F.col("nn"), "RB-SCHEMA-NOT-NULL-OLD-DEPENDENCY")
    out = both.withColumn("rule_id", rule).filter("rule_id IS NOT NULL")
    removed = F.col("rule_id") == "RB-SCHEMA-REMOVED-OLD-DEPENDENCY"
    return out.select("dependency", "rule_id", F.when(removed, "CRITICAL").otherwise("MEDIUM").alias("severity"), F.when(removed, "UNSAFE").otherwise("CAUTION").alias("status"))


def missing_evidence(requests: DataFrame, *keep: str) -> DataFrame:
    """UNKNOWN findings of requests (``keep``, old_application, deployment_context, old_schema, new_schema, old_api, new_api: whether each was
    given; dynamic_dependencies: array): what was not given, and what can't be resolved without running. Null counts as not given."""
    lacks = lambda *names: F.lit(False) if not names else ~reduce(lambda a, b: a & b, [F.coalesce(n, F.lit(False)) for n in names])
    rules = [
        (lacks("old_application"), "RB-MISSING-OLD-APPLICATION", "old_application"),
        (lacks("deployment_context"), "RB-ROLLBACK-WINDOW-UNKNOWN", "deployment_context"),
        (lacks("old_schema", "new_schema"), "RB-MISSING-SCHEMA-SNAPSHOT", "old_schema/new_schema"),
        (lacks("old_api", "new_api"), "RB-MISSING-API-SNAPSHOT", "old_api/new_api"),
        (~lacks("old_application") & (F.size("dynamic_dependencies") > 0), "RB-DYNAMIC-DEPENDENCY", "old_application.dynamic_dependencies"),
    ]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(what).alias("dependency"))) for test, rule, what in rules]), lambda x: x.isNotNull())
    return requests.select(*keep, F.explode(found).alias("f")).select(*keep, "f.dependency", "f.rule_id", F.lit("MEDIUM").alias("severity"), F.lit("UNKNOWN").alias("status"))


def api_dependencies(deps: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings for ``deps`` (method, path) of the old version: operations that the old contract has and the new one lacks."""
    key = ["path", "method"]
    gone = deps.join(old.select(*key).distinct(), key, "left_semi").join(new.select(*key), key, "left_anti")
    return gone.select(F.concat_ws(" ", "method", "path").alias("dependency"), F.lit("RB-API-ENDPOINT-REMOVED").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit("UNSAFE").alias("status"))


def forward_missing(deps: DataFrame, schema: DataFrame) -> DataFrame:
    """Dependencies of the new version that the new schema lacks."""
    have = schema.select(F.concat_ws(".", "table", "column").alias("dependency"))
    return deps.join(have, "dependency", "left_anti").select("dependency", F.lit("RB-FORWARD-MISSING-DEPENDENCY").alias("rule_id"), F.lit("UNSAFE").alias("status"))


def forward_evidence(requests: DataFrame, *keep: str) -> DataFrame:
    """An UNKNOWN finding for each of ``requests`` (``keep``, new_application, new_schema: whether each was given) that lacks one of the two."""
    given = F.coalesce("new_application", F.lit(False)) & F.coalesce("new_schema", F.lit(False))
    return requests.filter(~given).select(*keep, F.lit("new_application/new_schema").alias("dependency"), F.lit("RB-FORWARD-EVIDENCE-MISSING").alias("rule_id"), F.lit("MEDIUM").alias("severity"), F.lit("UNKNOWN").alias("status"), F.lit("FORWARD").alias("direction"))


def by_direction(findings: DataFrame, by: list[str]) -> DataFrame:
    """Findings (direction) per scope, split in those about going back and those about staying ahead, with their worst status."""
    rank = F.when(F.col("status") == "UNSAFE", 3).when(F.col("status") == "UNKNOWN", 2).when(F.col("status") == "CAUTION", 1).otherwise(0)
    return findings.groupBy(*by, "direction").agg(F.count("*").alias("n_findings"), F.get(F.array(*map(F.lit, ("SAFE", "CAUTION", "UNKNOWN", "UNSAFE"))), F.max(rank)).alias("status"))


def expand_contract(changes: DataFrame, deps: DataFrame) -> DataFrame:
    """Drops of what the old version still reads."""
    drops = changes.filter(F.col("kind").startswith("DROP_")).withColumn("dependency", F.concat_ws(".", "table", "object_name"))
    return drops.join(deps, "dependency", "left_semi").select("ordinal", "dependency", F.lit("EXPAND_CONTRACT_VIOLATION").alias("rule_id"), F.lit("UNSAFE").alias("status"))


def status(findings: DataFrame) -> DataFrame:
    """UNSAFE over UNKNOWN over CAUTION over SAFE."""
    rank = F.when(F.col("status") == "UNSAFE", 3).when(F.col("status") == "UNKNOWN", 2).when(F.col("status") == "CAUTION", 1).otherwise(0)
    return findings.agg(F.get(F.array(*map(F.lit, ("SAFE", "CAUTION", "UNKNOWN", "UNSAFE"))), F.coalesce(F.max(rank), F.lit(0))).alias("status"), F.count("*").alias("n_findings"))


def forward_status(deps: DataFrame, missing: DataFrame) -> DataFrame:
    """SAFE without dependencies, UNSAFE if one is missing, else UNKNOWN: satisfied names alone prove nothing."""
    n, m = deps.agg(F.count("*").alias("n")), missing.agg(F.count("*").alias("m"))
    return n.join(m).select(F.when(F.col("n") == 0, "SAFE").when(F.col("m") > 0, "UNSAFE").otherwise("UNKNOWN").alias("status"))


def provenance(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources (entity, source_file, line) of each finding. Those without an entity belong to all findings and come once, with a null
    dependency and rule, instead of once for each."""
    own = findings.join(sources, findings["dependency"] == sources["entity"]).select("dependency", "rule_id", "source_file", "line")
    none = F.lit(None).cast("string")
    return own.unionByName(sources.filter("coalesce(entity, '') = ''").select(none.alias("dependency"), none.alias("rule_id"), "source_file", "line"))


def parse_dependency(value: Column) -> list[Column]:
    """``method, path, field`` of "METHOD path#field"; without a method GET, without # no field."""
    head = F.trim(F.substring_index(value, "#", 1))
    two = head.contains(" ")
    return [F.when(two, F.upper(F.substring_index(head, " ", 1))).otherwise("GET").alias("method"), F.when(two, F.regexp_replace(head, "^[^ ]* ", "")).otherwise(head).alias("path"), F.when(value.contains("#"), F.regexp_replace(value, "^[^#]*#", "")).alias("field")]


def api_fields(deps: DataFrame, old: DataFrame, new: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Findings for ``deps`` (dependency = METHOD path#field): fields of operations of both contracts that no schema of the new one has, at any depth."""
    key = ["path", "method"]
    named = deps.select("dependency", *parse_dependency(F.col("dependency"))).filter("field IS NOT NULL AND field <> ''")
    kept = named.join(old.select(*key).distinct(), key, "left_semi").join(new.select(*key).distinct(), key, "left_semi")
    have = new_nodes.select(*key, F.try_element_at(path_of(new_nodes), F.lit(-1)).alias("field"))
    return kept.join(have, [*key, "field"], "left_anti").select("dependency", F.lit("RB-API-FIELD-REMOVED").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("UNSAFE").alias("status"))
