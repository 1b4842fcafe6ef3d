"""One run from changes to verdicts: targets, blast radius, deployment, contracts and rollback become findings, which are decided per scope.

All inputs are rows that carry their scope (a request, a variant of it, any columns ``by``). What scopes have in common, such as paths
from a target or what an object reaches, is worked out once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators import decision, graph, rollback, schema
from causeway.storage import materialize


@dataclass(frozen=True)
class Evidence:
    """What is known of every scope. ``by`` are the columns of a scope, which all tables but the graph and the registry have."""

    by: tuple[str, ...]
    #: The scopes themselves.
    scopes: DataFrame
    #: ordinal, action, kind, table, object_name, after, category, severity.
    changes: DataFrame
    #: entity_id; source, target, kind.
    entities: DataFrame
    edges: DataFrame
    #: path, method, rule_id, location, compatibility.
    contract: DataFrame
    #: path, method, entity, ordinal: who serves what; the last one of an operation counts.
    registry: DataFrame
    #: dependency, rule_id, severity, status.
    rollback: DataFrame
    #: Scopes whose rollback status is unknown.
    unsettled: DataFrame
    #: component: analyzers that gave no evidence.
    components: DataFrame


def object_of() -> Column:
    return F.concat_ws(".", "table", "object_name")


def targets(e: Evidence) -> DataFrame:
    """``by, origin``: objects that a change names, and entities that serve broken operations, as far as the graph has them."""
    named = e.changes.select(*e.by, object_of().alias("origin"))
    last = e.registry.groupBy("path", "method").agg(F.max_by("entity", "ordinal").alias("origin"))
    served = e.contract.filter("compatibility = 'BREAKING'").join(last, ["path", "method"]).select(*e.by, "origin")
    return named.unionByName(served).join(e.entities.select(F.col("entity_id").alias("origin")), "origin", "left_semi").select(*e.by, "origin").distinct()


def blast_findings(met: DataFrame, e: Evidence, max_hops: int, max_paths: int) -> DataFrame:
    """A finding for every path from the targets ``met``, numbered within its scope by target, then as ``decision.from_blast`` does."""
    # targets of several scopes are walked once
    walked = materialize(graph.blast_radius(e.edges, met.select("origin").distinct(), max_hops, max_paths), "blast")
    order = [F.asc("origin"), F.desc("severity"), F.asc("hops"), F.asc("entity"), F.split("path", ">").asc()]
    placed = decision.numbered(met.join(walked, "origin"), list(e.by), order)
    return placed.select(
        *e.by, F.concat_ws(":", F.lit("blast"), "entity", F.col("place").cast("string")).alias("finding_id"), F.lit("BLAST_RADIUS").alias("category"), F.lit("BLAST-DOWNSTREAM-IMPACT").alias("rule_id"), F.col("level").alias("severity"),
        F.lit(1.0).alias("confidence"), F.lit(False).alias("blocking"), F.lit(None).cast("string").alias("uncertainty"), "entity",
    )


def rehearse(changes: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``changes`` (kind, table, object_name, category) with object, n_affected, status and explanation: what each one's object is and reaches decides."""
    rows = materialize(changes.withColumn("object", object_of()), "rehearsed")
    reach = graph.impact(rows.select("object"), entities, edges).select("object", "n_affected")
    used = F.col("n_affected") > 0
    return rows.join(reach, "object").withColumns({"status": schema.deployment_status(F.col("category"), used), "explanation": schema.explanation_key(F.col("kind"), used)})


def schema_rollback(changes: DataFrame, columns: DataFrame, deps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, dependency, rule_id, severity, status``: what of ``deps`` (by, dependency) the schema lacks or has changed after a scope's changes.

    Only tables that a scope touches are folded and compared for it, under names that hold the scope.
    """
    scope = F.concat_ws("\x1f", *by)
    mine = lambda table: F.concat(scope, F.lit("\x1e"), table)
    touched = materialize(changes.select(*by, "table").distinct(), "touched")
    old = columns.join(touched, "table").withColumn("table", mine(F.col("table")))
    order = F.col("ordinal").cast("long") * (1 << 20) + F.coalesce(F.col("action") if "action" in changes.columns else F.lit(0), F.lit(0))
    new = schema.evolve(old, changes.withColumn("table", mine(F.col("table"))).withColumn("__order", order), "__order")
    asked = deps.withColumn("table", F.substring_index("dependency", ".", 1)).join(touched, [*by, "table"], "left_semi").select(mine(F.col("dependency")).alias("dependency"), *by)
    found = rollback.schema_dependencies(asked.select("dependency"), old, new)
    return asked.join(found, "dependency").select(*by, F.substring_index("dependency", "\x1e", -1).alias("dependency"), "rule_id", "severity", "status")


def findings(e: Evidence, max_hops: int = 3, max_paths: int = 100) -> DataFrame:
    """Findings of all sources per scope; a source that gave nothing says so, and a scope never stays without any finding.

    The primary change of a scope is its deployment finding, while all changes are targets of the blast radius.
    """
    by = list(e.by)
    met = materialize(targets(e), "targets")
    no_target = e.scopes.select(*by).join(met.select(*by).distinct(), by, "left_anti").withColumn("component", F.lit("blast_radius"))
    primary = materialize(schema.primary(e.changes, by), "primary")
    sources = [
        blast_findings(met, e, max_hops, max_paths),
        decision.from_schema(rehearse(primary, e.entities, e.edges), *by),
        decision.from_contract(e.contract, *by),
        decision.from_rollback(e.rollback, *by),
        decision.without_rollback(e.unsettled, e.rollback, *by),
        decision.unavailable(e.components.select(*by, "component").unionByName(no_target), *by),
    ]
    found = materialize(reduce(DataFrame.unionByName, sources), "findings")
    return found.unionByName(decision.without_evidence(e.scopes, found, *by))


def compare(found: DataFrame, decided: DataFrame, variant: str, before: str, after: str, by: list[str]) -> DataFrame:
    """Per scope ``by``: risk and verdict of the variants ``before`` and ``after``, and how many findings (category, rule, entity) only one of them has.

    ``found`` and ``decided`` hold both variants, told apart by the column ``variant``.
    """
    facts = found.select(variant, *by, "category", "rule_id", F.coalesce("entity", "finding_id").alias("what")).distinct()
    sides = facts.groupBy(*by, "category", "rule_id", "what").agg(F.bool_or(F.col(variant) == before).alias("b"), F.bool_or(F.col(variant) == after).alias("a"))
    changed = sides.groupBy(*by).agg(F.count_if(F.col("b") & ~F.col("a")).alias("n_gone"), F.count_if(F.col("a") & ~F.col("b")).alias("n_new"), F.count_if(F.col("a") & F.col("b")).alias("n_same"))
    one = lambda name: F.max(F.when(F.col(variant) == name, F.struct("risk", "verdict", "rules")))
    both = decided.groupBy(*by).agg(one(before).alias("b"), one(after).alias("a"))
    return both.join(changed, by).select(
        *by, F.col("b.risk").alias("risk_before"), F.col("a.risk").alias("risk_after"), (F.col("a.risk") - F.col("b.risk")).alias("risk_change"), F.col("b.verdict").alias("verdict_before"), F.col("a.verdict").alias("verdict_after"),
        F.col("b.rules").alias("rules_before"), F.col("a.rules").alias("rules_after"), "n_gone", "n_new", "n_same",
    )
