"""The evidence graph of decisions: what is affected produces findings, which feed risk features, policy rules and the verdict.

Findings are those of ``decision``; ``decided`` is ``decision.decide`` over the same groups ``by``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.decision import numbered
from causeway.storage import materialize

# The feature that a category feeds, and the features of the risk formula.
# (a contract change counts for deployment in the score and is drawn to the blast radius; SCHEMA is drawn and counts nowhere)
FEATURE_OF = {"BLAST_RADIUS": "blast_severity", "API_CONTRACT": "blast_severity", "DATABASE": "deployment_severity", "SCHEMA": "deployment_severity", "ROLLBACK": "rollback_unsafety"}
FEATURES = ("blast_severity", "deployment_severity", "rollback_unsafety")
NO_EVIDENCE = "ANALYZER-UNAVAILABLE"


def _id(kind: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(value) if isinstance(value, str) else value)


def _feature(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, feature in FEATURE_OF.items():
        out = F.when(category == name, feature).otherwise(out)
    return out


def _rules(decided: DataFrame, by: list[str], *more: str) -> DataFrame:
    return decided.select(*by, *more, F.explode(F.split("rules", ",")).alias("rule"))


def nodes(findings: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """``node_id, kind, label, layer`` per group. An entity of many findings is one node; findings that only say that evidence is missing are none."""

    def node(df: DataFrame, node_id: Column, kind: str, label: Column, layer: int) -> DataFrame:
        return df.select(*by, node_id.alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"), F.lit(layer).alias("layer"))

    facts = findings.filter(F.col("rule_id") != NO_EVIDENCE)
    parts = [
        node(facts.filter("entity IS NOT NULL").select(*by, "entity").distinct(), _id("entity", "entity"), "SOURCE_SYMBOL", F.col("entity"), 0),
        node(facts, _id("finding", "finding_id"), "FINDING", F.col("rule_id"), 90),
        node(decided.select(*by, F.explode(F.array(*map(F.lit, FEATURES))).alias("f")), _id("risk", "f"), "RISK_FEATURE", F.col("f"), 91),
        node(_rules(decided, by), _id("policy", "rule"), "POLICY_RULE", F.col("rule"), 92),
        node(decided, F.lit("verdict"), "VERDICT", F.col("verdict"), 93),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(findings: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """``source, target, kind`` per group; features of value 0 trigger no rule."""

    def edge(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return df.select(*by, source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))

    facts = findings.filter(F.col("rule_id") != NO_EVIDENCE).withColumn("f", _feature(F.col("category")))
    above = F.array_compact(F.array(*[F.when(F.col(f) > 0, F.lit(f)) for f in FEATURES]))
    triggers = _rules(decided.withColumn("above", above), by, "above").select(*by, "rule", F.explode("above").alias("f"))
    parts = [
        edge(facts.filter("entity IS NOT NULL"), _id("entity", "entity"), _id("finding", "finding_id"), "PRODUCES"),
        edge(facts.filter("f IS NOT NULL"), _id("finding", "finding_id"), _id("risk", "f"), "CONTRIBUTES_TO"),
        edge(triggers, _id("risk", "f"), _id("policy", "rule"), "TRIGGERS"),
        edge(_rules(decided, by), _id("policy", "rule"), F.lit("verdict"), "DETERMINES"),
    ]
    return reduce(DataFrame.unionByName, parts)


# What a node of the graph is, by the kind of its entity; any other is a SOURCE_SYMBOL.
NODE_KINDS = {"DATABASE": "SCHEMA_ENTITY", "SERVICE": "SERVICE", "API": "API_ENDPOINT", "CLIENT": "CLIENT", "SYMBOL": "SOURCE_SYMBOL"}


def node_kind(kind: Column) -> Column:
    out = F.lit("SOURCE_SYMBOL")
    for name, node in NODE_KINDS.items():
        out = F.when(kind == name, node).otherwise(out)
    return out


def _change(changes: DataFrame) -> Column:
    return F.concat_ws(":", F.lit("change"), "kind", F.coalesce("schema_object", F.lit("unresolved")))


def impact_nodes(changes: DataFrame, paths: DataFrame, entities: DataFrame) -> DataFrame:
    """``node_id, kind, label, layer`` of changes (kind, schema_object), of the entities they name, and of those on ``paths`` (origin, nodes).

    Only entities that the graph has (entity_id, kind) are nodes; one that is met at several distances has the least as its layer.
    """
    made = changes.select(_change(changes).alias("node_id"), F.lit("CHANGE").alias("kind"), F.col("kind").alias("label"), F.lit(0).alias("layer")).distinct()
    met = paths.select(F.posexplode("nodes").alias("layer", "entity_id")).unionByName(changes.select(F.lit(0).alias("layer"), F.col("schema_object").alias("entity_id")))
    met = met.groupBy("entity_id").agg(F.min("layer").alias("layer")).join(entities.select("entity_id", "kind"), "entity_id")
    return made.unionByName(met.select(_id("entity", "entity_id").alias("node_id"), node_kind(F.col("kind")).alias("kind"), F.col("entity_id").alias("label"), "layer"))


def impact_edges(changes: DataFrame, paths: DataFrame, entities: DataFrame) -> DataFrame:
    """``source, target, kind, label, via_target``: a change AFFECTS the entity it names, and along ``paths`` (origin, nodes, kinds) each
    entity is one that the next DEPENDS_ON, once per origin. Edges whose ends the graph lacks aren't drawn."""
    here = entities.select("entity_id")
    affects = changes.join(here, F.col("schema_object") == F.col("entity_id")).select(_change(changes).alias("source"), _id("entity", "entity_id").alias("target"), F.lit("AFFECTS").alias("kind"), F.col("kind").alias("label"), F.col("entity_id").alias("via_target"))
    steps = paths.select("origin", "nodes", F.posexplode("kinds").alias("i", "label")).select("origin", F.get("nodes", F.col("i")).alias("a"), F.get("nodes", F.col("i") + 1).alias("b"), "label").distinct()
    steps = steps.join(here.withColumnRenamed("entity_id", "a"), "a", "left_semi").join(here.withColumnRenamed("entity_id", "b"), "b", "left_semi")
    depends = steps.select(_id("entity", "a").alias("source"), _id("entity", "b").alias("target"), F.lit("DEPENDS_ON").alias("kind"), "label", F.col("origin").alias("via_target"))
    return affects.unionByName(depends).distinct()


def drawn(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Those of ``edges`` whose ends are both among ``nodes`` of their group."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(*by, F.col("node_id").alias(end)).distinct(), [*by, end], "left_semi")
    return edges


def ungrounded(claims: DataFrame, findings: DataFrame) -> DataFrame:
    """Claims (evidence_id) that name a finding which isn't there; an explanation is valid only if there are none."""
    return claims.join(findings.select(F.col("finding_id").alias("evidence_id")), "evidence_id", "left_anti")


def added_nodes(current: DataFrame, previous: DataFrame, by: list[str]) -> DataFrame:
    """Nodes of ``current`` whose id ``previous`` lacks."""
    return current.join(previous.select(*by, "node_id"), [*by, "node_id"], "left_anti")


def lineage(graph_edges: DataFrame, by: list[str]) -> DataFrame:
    """``feature, node_id``: of each risk feature the findings that contribute to it and the entities that produce these."""
    feeds = graph_edges.filter("kind = 'CONTRIBUTES_TO'").select(*by, F.col("target").alias("feature"), F.col("source").alias("node_id"))
    made = graph_edges.filter("kind = 'PRODUCES'").select(*by, F.col("target").alias("node_id"), F.col("source").alias("_entity"))
    return feeds.unionByName(feeds.join(made, [*by, "node_id"]).select(*by, "feature", F.col("_entity").alias("node_id")).distinct())


def verdict_chain(graph_nodes: DataFrame, graph_edges: DataFrame, by: list[str]) -> DataFrame:
    """``node_id, kind, label, layer, place`` per group: all nodes from which edges lead to the group's verdict, in the order of layer and id.

    All groups are walked back at once; a step stays within its group's own graph, and a node is met once however many edges lead on.
    """
    known = materialize(graph_nodes.select(*by, "node_id", "kind", "label", "layer").distinct(), "nodes")
    back = materialize(graph_edges.select(*by, F.col("target").alias("node_id"), F.col("source").alias("__next")).distinct(), "back")
    seen = front = materialize(known.filter("kind = 'VERDICT'").select(*by, "node_id").distinct(), "chain")
    step = 0
    while True:
        step += 1
        near = front.join(back, [*by, "node_id"]).select(*by, F.col("__next").alias("node_id")).distinct()
        front = materialize(near.join(seen, [*by, "node_id"], "left_anti"), f"chain{step}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return numbered(known.join(seen, [*by, "node_id"], "left_semi"), by, [F.asc("layer"), F.asc("node_id"), F.asc("label")])


# What a claim can state: ids of findings, policy rules, dotted names of entities, and numbers.
_IDS = r"\b(?:blast|api|rollback|missing|policy|f):[^\s,;]*[^\s,;.]"
_RULES = r"\b(?:[A-Z]{2,}[-_])+[A-Z0-9_-]+\b"
_NAMES = r"(?<![\w:.>/])[A-Za-z_]\w*(?:[.:][A-Za-z0-9_]+)+"
_NUMBERS = r"(?<![\w.:/-])[0-9]+(?:\.[0-9]+)?(?![\w:/-]|\.[0-9])"


def stated(text: Column) -> Column:
    """array<string>: everything checkable that a text states: ids, rules, names of entities and numbers."""
    rest = F.regexp_replace(text, f"{_IDS}|{_RULES}", " ")
    found = [F.regexp_extract_all(t, F.lit(p), F.lit(0)) for t, p in ((text, _IDS), (F.regexp_replace(text, _IDS, " "), _RULES), (rest, _NAMES), (rest, _NUMBERS))]
    return F.array_distinct(F.concat(*found))


def known_facts(findings: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """``fact`` per group: what findings and the decision bear out: ids, rules, entities, the verdict, and the scores as they are written."""
    ids = findings.select(*by, F.explode(F.array("finding_id", "rule_id", "entity")).alias("fact"))
    numbers = decided.select(*by, F.explode(F.array(*[F.col(c).cast("string") for c in ("risk", "base_risk", "critical", "high", "unknown", "affected")], "verdict")).alias("fact"))
    rules = _rules(decided, by).select(*by, F.explode(F.array(F.col("rule"), F.concat(F.lit("policy:"), "rule"))).alias("fact"))
    return ids.unionByName(numbers).unionByName(rules).filter("fact IS NOT NULL").distinct()


def unfounded(claims: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """``by, claim_id, fact``: each thing that a claim (``by``, claim_id, text) states and no fact of its group bears out."""
    said = claims.select(*by, "claim_id", F.explode(stated(F.col("text"))).alias("fact"))
    return said.join(facts.select(*by, "fact"), [*by, "fact"], "left_anti").select(*by, "claim_id", "fact")
