"""From findings to features, compound risks, a risk score and a verdict.

Findings have ``category, severity, confidence, rule_id, blocking, uncertainty, entity``. Everything is one aggregate per scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.storage import materialize

# Worth of severities, weights of scores, multipliers of compound risks and their limit.
SEVERITY = {"INFO": 0.0, "LOW": 0.25, "MEDIUM": 0.5, "HIGH": 0.75, "CRITICAL": 1.0}
BLAST, DEPLOYMENT, ROLLBACK = 0.40, 0.35, 0.25
ROLLBACK_SCHEMA, API_SCHEMA, BLAST_ROLLBACK, MOST = 1.12, 1.08, 1.10, 1.5


def worth(severity: Column) -> Column:
    out = F.lit(0.5)
    for name, value in SEVERITY.items():
        out = F.when(severity == name, value).otherwise(out)
    return out


def severity_of_text(text: Column) -> Column:
    return F.when(F.upper(text).isin(*SEVERITY), F.upper(text)).otherwise("MEDIUM")


def features(findings: DataFrame, by: list[str]) -> DataFrame:
    """Scores and counters per scope."""
    score = worth(F.col("severity")) * F.col("confidence")
    category, rule = F.col("category"), F.col("rule_id")

    def top(test: Column, name: str) -> Column:
        return F.bround(F.coalesce(F.max(F.when(test, score)), F.lit(0.0)), 6).alias(name)

    def any_of(test: Column, name: str) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False)).alias(name)

    unknown = F.col("uncertainty").isNotNull() | (F.col("confidence") == 0)
    return findings.groupBy(*by).agg(
        top(category == "BLAST_RADIUS", "blast_severity"), top(category.isin("DATABASE", "API_CONTRACT"), "deployment_severity"), top(category == "ROLLBACK", "rollback_unsafety"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(rule.isin("DROP_COLUMN", "DROP_TABLE")).alias("destructive"),
        F.count_if((category == "API_CONTRACT") & F.col("blocking")).alias("breaking_api"), F.count_if((category == "ROLLBACK") & (rule.startswith("RB-") | rule.startswith("EXPAND_"))).alias("rollback_violations"),
        F.count_if(unknown).alias("unknown"), F.count_if(category == "AMBIGUITY").alias("ambiguous"), F.count_if(category == "DYNAMIC_REFERENCE").alias("unresolved"), F.count_distinct("entity").alias("affected"),
        any_of((category == "DATABASE") & F.col("blocking"), "db_blocking"), any_of(rule == "RB-SCHEMA-REMOVED-OLD-DEPENDENCY", "removed_dependency"), any_of((category == "API_CONTRACT") & F.col("blocking"), "api_blocking"),
        any_of(category == "DATABASE", "db"), any_of((category == "BLAST_RADIUS") & (F.col("severity") == "CRITICAL"), "blast_critical"), any_of((category == "ROLLBACK") & F.col("blocking"), "rollback_blocking"),
        any_of(F.col("blocking") & (F.col("severity") == "CRITICAL") & (F.col("confidence") >= 0.75), "critical_blocking"),
    )


COMPOUNDS = (
    ("COMPOUND-API-SCHEMA", "api_blocking AND db", API_SCHEMA),
    ("COMPOUND-BLAST-ROLLBACK", "blast_critical AND rollback_blocking", BLAST_ROLLBACK),
    ("COMPOUND-ROLLBACK-SCHEMA", "db_blocking AND removed_dependency", ROLLBACK_SCHEMA),
)


def compound_risks(feats: DataFrame, by: list[str]) -> DataFrame:
    all_ = F.array_compact(F.array(*[F.when(F.expr(test), F.struct(F.lit(name).alias("compound"), F.lit(m).alias("multiplier"))) for name, test, m in COMPOUNDS]))
    return feats.select(*by, F.explode(all_).alias("c")).select(*by, "c.compound", "c.multiplier")


def risk(feats: DataFrame) -> DataFrame:
    """``feats`` with base_risk, multiplier and risk."""
    base = F.bround(100 * (BLAST * F.col("blast_severity") + DEPLOYMENT * F.col("deployment_severity") + ROLLBACK * F.col("rollback_unsafety")), 0)
    product = F.lit(1.0)
    for _, test, m in COMPOUNDS:
        product = product * F.when(F.expr(test), m).otherwise(1.0)
    out = feats.withColumn("base_risk", base.cast("long")).withColumn("multiplier", F.bround(F.least(F.lit(MOST), product), 6))
    return out.withColumn("risk", F.least(F.lit(100), F.bround(F.col("base_risk") * F.col("multiplier"), 0)).cast("long"))


def verdict(risked: DataFrame) -> DataFrame:
    """``risked`` with the rules that decide and the verdict: blocking rules, then unknown evidence, then the score."""
    rules = F.array_compact(F.array(F.when(F.col("critical_blocking"), "CRITICAL_BLOCKING_FINDING"), F.when((F.col("rollback_unsafety") >= 1) & (F.col("destructive") > 0), "UNSAFE_ROLLBACK_DESTRUCTIVE_CHANGE"), F.when(F.col("risk") >= 70, "RISK_THRESHOLD_70")))
    out = risked.withColumn("stop", rules)
    stopped = F.size("stop") > 0
    chosen = F.when(stopped, F.concat_ws(",", "stop")).when(F.col("unknown") > 0, "REQUIRED_EVIDENCE_UNKNOWN").when(F.col("risk") >= 40, "RISK_THRESHOLD_40").otherwise("NO_BLOCKING_FINDING_LOW_RISK")
    state = F.when(stopped, "DO_NOT_DEPLOY").when(F.col("unknown") > 0, "UNKNOWN").when(F.col("risk") >= 40, "CAUTION").otherwise("SAFE")
    return out.withColumn("rules", chosen).withColumn("verdict", state).drop("stop")


def decide(findings: DataFrame, by: list[str]) -> DataFrame:
    return verdict(risk(features(findings, by)))


def evidence_chain(findings: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """source, target, relation and value of every step from findings to the verdict."""
    feats = findings.select(*by, F.col("rule_id").alias("source"), F.concat(F.lit("feature:"), F.lower("category")).alias("target"), F.lit("contributes_to").alias("relation"), F.col("severity").alias("value"))
    base = decided.select(*by, F.lit("risk_features").alias("source"), F.lit("base_risk").alias("target"), F.lit("formula").alias("relation"), F.col("base_risk").cast("string").alias("value"))
    extra = compound_risks(decided, by).select(*by, F.col("compound").alias("source"), F.lit("compound_adjustment").alias("target"), F.lit("multiplier").alias("relation"), F.col("multiplier").cast("string").alias("value"))
    last = decided.select(*by, F.lit("policy").alias("source"), F.lit("verdict").alias("target"), F.lit("selected").alias("relation"), F.col("verdict").alias("value"))
    return feats.unionByName(base).unionByName(extra).unionByName(last)


def top_findings(findings: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """Of each scope the first ``n`` by severity (as text, descending), then id descending."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("severity"), F.desc("finding_id")))
    return findings.withColumn("place", place).filter(F.col("place") <= n)


def remediation(findings: DataFrame) -> DataFrame:
    """Two steps for every destructive finding."""
    rank = F.when(F.col("severity") == "CRITICAL", "CRITICAL").when(F.col("severity") == "HIGH", "HIGH").when(F.col("severity") == "MEDIUM", "MEDIUM").otherwise("LOW")
    steps = F.array(F.struct(F.lit("expand").alias("step"), rank.alias("priority")), F.struct(F.lit("verify").alias("step"), F.lit("HIGH").alias("priority")))
    return findings.filter(F.col("rule_id").isin("DROP_COLUMN", "DROP_TABLE")).select("finding_id", F.explode(steps).alias("s")).select(F.concat_ws(":", "finding_id", "s.step").alias("step_id"), F.col("s.priority").alias("priority"))


# Severity of a contract change by its rule; HIGH where none is listed.
CONTRACT_SEVERITY = {"API-ENDPOINT-ADDED": "LOW", "API-RESPONSE-ADDED": "LOW", "API-PARAM-LOCATION-CHANGED": "MEDIUM", "API-SECURITY-REQUIRED": "MEDIUM"}


def from_schema(changes: DataFrame, *keep: str) -> DataFrame:
    """Findings of schema changes (kind, table, object_name, severity, status): UNSAFE ones block, and UNKNOWN ones count half and say so."""
    unknown, entity = F.col("status") == "UNKNOWN", F.concat_ws(".", "table", "object_name")
    return changes.select(
        *keep, F.substring(F.sha2(F.concat_ws("|", entity, "kind"), 256), 1, 16).alias("finding_id"), F.lit("DATABASE").alias("category"), F.col("kind").alias("rule_id"), "severity", F.when(unknown, 0.5).otherwise(1.0).alias("confidence"),
        (F.col("status") == "UNSAFE").alias("blocking"), F.when(unknown, "deployment status is unknown").alias("uncertainty"), F.when(entity != "UNKNOWN", entity).alias("entity"),
    )


def from_contract(changes: DataFrame, *keep: str) -> DataFrame:
    """Findings of contract changes (path, method, rule_id, location, compatibility), numbered in the order of their operation, rule and place."""
    level = F.lit("HIGH")
    for rule, severity in CONTRACT_SEVERITY.items():
        level = F.when(F.col("rule_id") == rule, severity).otherwise(level)
    placed = numbered(changes, list(keep), [F.asc("path"), F.asc("method"), F.asc("rule_id"), F.asc("location")])
    return placed.select(
        *keep, F.concat_ws(":", F.lit("api"), "rule_id", F.col("place").cast("string")).alias("finding_id"), F.lit("API_CONTRACT").alias("category"), "rule_id", level.alias("severity"), F.lit(1.0).alias("confidence"),
        (F.col("compatibility") == "BREAKING").alias("blocking"), F.lit(None).cast("string").alias("uncertainty"), F.concat_ws(" ", "method", "path").alias("entity"),
    )


def from_rollback(found: DataFrame, *keep: str) -> DataFrame:
    """Findings of rollback (dependency, rule_id, severity, status): an UNKNOWN one tells what is missing, which is no entity."""
    unknown = F.col("status") == "UNKNOWN"
    return found.select(
        *keep, F.concat_ws(":", F.lit("rollback"), "rule_id", "dependency").alias("finding_id"), F.lit("ROLLBACK").alias("category"), "rule_id", "severity", F.when(unknown, 0.0).otherwise(1.0).alias("confidence"),
        (F.col("status") == "UNSAFE").alias("blocking"), F.when(unknown, "rollback evidence is unknown").alias("uncertainty"), F.when(~unknown, F.col("dependency")).alias("entity"),
    )


def missing(rows: DataFrame, finding_id: Column, category: str, severity: str, rule: str, why: str, *keep: str) -> DataFrame:
    """Findings that only say that evidence is missing."""
    return rows.select(*keep, finding_id.alias("finding_id"), F.lit(category).alias("category"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(0.0).alias("confidence"), F.lit(False).alias("blocking"), F.lit(why).alias("uncertainty"), F.lit(None).cast("string").alias("entity"))


def without_rollback(unsettled: DataFrame, rollback: DataFrame, *keep: str) -> DataFrame:
    """RB-UNKNOWN for ``unsettled`` scopes, whose rollback status is unknown, that no finding of ``rollback`` tells about."""
    silent = unsettled.select(*keep).join(rollback.select(*keep).distinct(), list(keep), "left_anti")
    return missing(silent, F.lit("rollback:unknown"), "ROLLBACK", "MEDIUM", "RB-UNKNOWN", "rollback evidence is unavailable", *keep)


def unavailable(components: DataFrame, *keep: str) -> DataFrame:
    """ANALYZER-UNAVAILABLE for each of ``components`` (component) that gave no evidence."""
    return missing(components, F.concat_ws(":", F.lit("missing"), "component"), "DYNAMIC_REFERENCE", "MEDIUM", "ANALYZER-UNAVAILABLE", "required analyzer unavailable", *keep)


def without_evidence(scopes: DataFrame, findings: DataFrame, *keep: str) -> DataFrame:
    """NO_ANALYSIS_EVIDENCE for ``scopes`` that have no finding at all, so that nothing found never looks like nothing wrong."""
    silent = scopes.select(*keep).join(findings.select(*keep).distinct(), list(keep), "left_anti")
    return missing(silent, F.lit("analysis:no-evidence"), "DYNAMIC_REFERENCE", "INFO", "NO_ANALYSIS_EVIDENCE", "analysis evidence is unavailable", *keep)


def policy_steps(findings: DataFrame, decided: DataFrame, by: list[str]) -> DataFrame:
    """``step_id, priority, place`` per scope: the steps of ``remediation``, or, for a scope without any, one for its first policy rule; by priority, then id."""
    steps = findings.select(*by, "finding_id").join(remediation(findings).withColumn("finding_id", F.regexp_replace("step_id", ":(?:expand|verify)$", "")), "finding_id").select(*by, "step_id", "priority").distinct()
    silent = decided.join(steps.select(*by).distinct(), by, "left_anti").filter("rules <> ''")
    policy = silent.select(*by, F.concat(F.lit("policy:"), F.substring_index("rules", ",", 1)).alias("step_id"), F.lit("HIGH").alias("priority"))
    rank = F.when(F.col("priority") == "CRITICAL", 0).when(F.col("priority") == "HIGH", 1).when(F.col("priority") == "MEDIUM", 2).otherwise(3)
    return numbered(steps.unionByName(policy).withColumn("rank", rank), by, [F.asc("rank"), F.asc("step_id")]).drop("rank")


def stage_flags(analyzers: DataFrame, by: list[str]) -> DataFrame:
    """``component, stage_status`` per scope of ``capabilities``: COMPLETED if the analyzer looked at its input, and rollback if it came to a status."""
    done = F.when(F.col("component") == "rollback", F.col("status").isin("SAFE", "CAUTION", "UNSAFE")).otherwise(F.col("status") == "ANALYZED")
    return analyzers.select(*by, "component", F.when(done, "COMPLETED").otherwise("UNAVAILABLE").alias("stage_status"))


def coverage_clean(scopes: DataFrame, components: DataFrame, diagnostics: DataFrame, by: list[str]) -> DataFrame:
    """``clean`` per scope: no component is unavailable, and nothing was diagnosed."""
    marks = components.select(*by).unionByName(diagnostics.select(*by)).distinct().withColumn("marked", F.lit(True))
    return scopes.select(*by).distinct().join(marks, by, "left").select(*by, F.col("marked").isNull().alias("clean"))


def in_order(findings: DataFrame, *keep: str) -> DataFrame:
    """``findings`` with ``place`` (from 0) within their scope, by category, rule and id."""
    return numbered(findings, list(keep), [F.asc("category"), F.asc("rule_id"), F.asc("finding_id")])


def numbered(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``place`` (from 0) among those of their group ``by``, in ``order``.

    Ranges of group and order are dealt to tasks, each numbers its rows as they stand, and what stands before them in their group (one row per
    part and group) is added: a group of any size is no single task's, and rows are dealt and sorted once.
    """
    placed = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__id", F.monotonically_increasing_id())
    parts = materialize(placed, "ranges").withColumn("__part", F.shiftright("__id", 33))
    sizes = parts.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(sizes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__at"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__less")), "sizes")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return parts.join(sizes, [F.col("__part") == F.col("__at"), *same]).select(*rows.columns, (F.col("__id") + F.col("__less")).alias("place"))


def positions(findings: DataFrame, by: list[str]) -> DataFrame:
    """``findings`` with their place (from 0) among those of their group, by finding_id."""
    return numbered(findings, by, [F.col("finding_id").asc()])


def explained_blast(findings: DataFrame, by: list[str]) -> DataFrame:
    """Of each group: the distinct entities that its findings of blast radius name."""
    return findings.filter("category = 'BLAST_RADIUS'").groupBy(*by).agg(F.count_distinct("entity").alias("n_affected"))


def unknowns(findings: DataFrame) -> DataFrame:
    """Findings that say that evidence is missing."""
    return findings.filter(F.col("uncertainty").isNotNull() | (F.col("confidence") == 0))


def from_blast(found: DataFrame) -> DataFrame:
    """Findings of ``graph.blast_radius`` with ids that number them, from 0, within their origin: worst, nearest and first by name first."""
    order = [F.desc("severity"), F.asc("hops"), F.asc("entity"), F.split("path", ">").asc()]
    return numbered(found, ["origin"], order).select("origin", F.concat(F.lit("blast:"), "entity", F.lit(":"), F.col("place").cast("string")).alias("finding_id"), F.lit("BLAST_RADIUS").alias("category"), F.col("level").alias("severity"), F.lit("BLAST-DOWNSTREAM-IMPACT").alias("rule_id"), "entity")


def capabilities(stats: DataFrame, by: list[str]) -> DataFrame:
    """``component, status`` of every analyzer per group, so that missing evidence never looks like evidence of nothing.

    ``stats`` has nodes, unsupported, has_migration, migration_failed, has_target, has_contract, contract_failed and rollback.
    """
    status = {
        "source": F.when(F.col("nodes") > 0, "ANALYZED").when(F.col("unsupported") > 0, "UNSUPPORTED").otherwise("UNAVAILABLE"),
        "database": F.when(~F.col("has_migration"), "UNAVAILABLE").when(F.col("migration_failed"), "PARSE_ERROR").otherwise("ANALYZED"),
        "blast_radius": F.when(F.col("nodes") == 0, "UNAVAILABLE").when(~F.col("has_target"), "NOT_APPLICABLE").otherwise("ANALYZED"),
        "api_contract": F.when(F.col("contract_failed"), "PARSE_ERROR").when(~F.col("has_contract"), "UNAVAILABLE").otherwise("ANALYZED"),
        "rollback": F.col("rollback"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("component"), v.alias("status")) for k, v in status.items()])
    return stats.select(*by, F.explode(rows).alias("_c")).select(*by, "_c.component", "_c.status")


def contributions(feats: DataFrame, by: list[str]) -> DataFrame:
    """Points that each feature gives to the base risk, halves rounded up, as reports show them."""
    parts = (("blast_severity", BLAST), ("deployment_severity", DEPLOYMENT), ("rollback_unsafety", ROLLBACK))
    points = F.array(*[F.struct(F.lit(f).alias("feature"), F.floor(F.lit(100.0) * F.lit(w) * F.col(f) + 0.5).alias("points")) for f, w in parts])
    return feats.select(*by, F.explode(points).alias("_p")).select(*by, "_p.feature", "_p.points")


# The groups under which reports show categories.
REPORT_GROUPS = {"DATABASE": "primary", "SCHEMA": "primary", "BLAST_RADIUS": "blast", "ROLLBACK": "rollback", "API_CONTRACT": "api"}


def report_groups(findings: DataFrame, by: list[str]) -> DataFrame:
    group = F.lit("other")
    for category, name in REPORT_GROUPS.items():
        group = F.when(F.col("category") == category, name).otherwise(group)
    return findings.groupBy(*by, group.alias("report_group")).agg(F.count("*").alias("n_findings"), F.count_if("blocking").alias("n_blocking"))


def root_cause(findings: DataFrame, by: list[str]) -> DataFrame:
    """The finding that explains a group's verdict: the first that blocks in category ROLLBACK, else the first that blocks; null without any."""
    place, blocking = F.struct("category", "rule_id", "finding_id"), F.coalesce("blocking", F.lit(False))
    first = lambda test: F.min(F.when(test, place))
    return findings.groupBy(*by).agg(F.coalesce(first(blocking & (F.col("category") == "ROLLBACK")), first(blocking)).alias("_f")).select(*by, F.col("_f.finding_id").alias("finding_id"))
