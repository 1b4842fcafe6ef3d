"""Queries that compose operators or read scripts, with the SQL that each is held against; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.catalog import _SCORED, _grown, query
from causeway.functions import text as redactions
from causeway.operators import assessment, contract, decision, evidence, extraction, graph, rollback, schema, snapshots, statements
from causeway.plans import adapters as a
from causeway.sources import contracts, sinks
from causeway.storage import materialize


@query(f"WITH {a.SCRIPTS_SQL} SELECT path, count(DISTINCT ordinal) AS n_statements FROM acts GROUP BY path")
def script_statements(t):
    """Statements of each script; quoted semicolons and comments end none."""
    return statements.statements(a.scripts(t)).groupBy("path").agg(F.count("*").alias("n_statements"))


def _script_changes(t):
    found = schema.changes(statements.statements(a.scripts(t)))
    # a script's statements as they follow each other, without the empty ones between them
    return found.drop("statement")


@query(f'WITH {a.SCRIPTS_SQL} SELECT path, ordinal, action, kind, "table", object_name, after, category, severity FROM acts')
def script_actions(t):
    """One row per action of every statement of every script."""
    return _script_changes(t)


@query(f"WITH {a.SCRIPTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE category WHEN 'DESTRUCTIVE' THEN 5 WHEN 'DATA_DEPENDENT' THEN 4 WHEN 'ADDITIVE' THEN 2 WHEN 'UNSUPPORTED' THEN 1 END DESC, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, ordinal, action) AS r FROM acts) SELECT path, kind, \"table\", object_name FROM r WHERE r = 1")
def script_primary_change(t):
    return schema.primary(_script_changes(t), ["path"]).select("path", "kind", "table", "object_name")


@query("""SELECT 't' || p_partkey AS "table", CASE c.n WHEN '?' THEN 'weird, ' || p_partkey ELSE c.n END AS "column", c.k AS data_type, c.o AS nullable, c.p AS primary_key, c.u AS is_unique FROM part, (SELECT unnest([
{n: 'id', k: 'INT', o: false, p: true, u: false}, {n: '?', k: 'INT', o: false, p: false, u: false}, {n: 'note', k: 'VARCHAR', o: true, p: false, u: false}, {n: 'd', k: 'DECIMAL', o: true, p: false, u: true},
{n: 'f', k: 'UNKNOWN', o: false, p: true, u: false}, {n: 'primary', k: 'TEXT', o: true, p: false, u: false}, {n: 'ts', k: 'TIMESTAMPTZ', o: true, p: false, u: false}, {n: 'h', k: 'DOUBLE', o: true, p: false, u: false}]) AS c)""")
def quoted_tables(t):
    """Columns of CREATE TABLE statements whose names and defaults are quoted."""
    return schema.create_tables(statements.statements(a.quoted_tables(t)))


_REACH = """cand AS (SELECT DISTINCT o, entity_id FROM {objects} JOIN p_entities ON entity_id = o UNION ALL SELECT DISTINCT o, entity_id FROM {objects} JOIN p_entities ON split_part(o, '.', 1) = split_part(entity_id, '.', 1) WHERE o NOT IN (SELECT entity_id FROM p_entities)),
reach AS (SELECT o, entity_id FROM cand UNION SELECT o, target FROM reach JOIN p_edges ON source = entity_id),
affected AS (SELECT o, count(*) AS n FROM reach GROUP BY o)"""
_STATUS = "CASE category WHEN 'DESTRUCTIVE' THEN 'UNSAFE' WHEN 'DATA_DEPENDENT' THEN CASE WHEN coalesce(n, 0) > 0 THEN 'UNSAFE' ELSE 'COMPATIBLE' END WHEN 'ADDITIVE' THEN 'SAFE' ELSE 'UNKNOWN' END"
_EXPLAINED = "CASE kind WHEN 'DROP_COLUMN' THEN 'drop_column_' || CASE WHEN coalesce(n, 0) > 0 THEN 'active_dependency' ELSE 'no_dependency' END WHEN 'DROP_TABLE' THEN 'drop_table_' || CASE WHEN coalesce(n, 0) > 0 THEN 'active_dependency' ELSE 'no_dependency' END WHEN 'ALTER_NULLABILITY' THEN 'not_null_data_dependent' WHEN 'ALTER_COLUMN_TYPE' THEN 'type_narrowing_data_dependent' WHEN 'ADD_COLUMN' THEN 'additive_safe_change' ELSE 'unsupported_change' END"


@query(f"WITH RECURSIVE {a.MIGRATION_SQL}, {a.PRODUCT_SQL}, objects AS (SELECT *, concat_ws('.', \"table\", object_name) AS o FROM changes), {_REACH.format(objects='objects')} SELECT ordinal, o AS object, coalesce(n, 0) AS n_affected, {_STATUS} AS status, {_EXPLAINED} AS explanation FROM objects LEFT JOIN affected USING (o)")
def change_impact(t):
    """What each change's object is and reaches, over all changes at once, and the deployment status that follows."""
    entities, edges = a.product(t)
    return assessment.rehearse(schema.changes(a.migration(t)), entities, edges).select("ordinal", "object", "n_affected", "status", "explanation")


@query(f"WITH RECURSIVE {a.PRODUCT_SQL}, up AS (SELECT entity_id AS a, entity_id AS b FROM p_entities WHERE entity_id NOT LIKE 't%' AND entity_id NOT LIKE 'client%' UNION SELECT a, target FROM up JOIN p_edges ON source = b WHERE target NOT LIKE 'client%') SELECT entity_id AS node, coalesce((SELECT min(x.b) FROM up x JOIN up y ON y.a = x.b AND y.b = x.a WHERE x.a = entity_id), entity_id) AS component FROM p_entities")
def entity_cycles(t):
    """The cycle that each entity is part of, named by its least entity; entities in no cycle name themselves."""
    entities, edges = a.product(t)
    return graph.strong_components(edges, entities.select(F.col("entity_id").alias("node")))


def _evidence(t) -> assessment.Evidence:
    by = ("variant", "request")
    entities, edges = a.product(t)
    # statements are read once, however many sources of findings ask for their changes
    scopes, changes = a.variants(t), a.requested(t, materialize(schema.changes(a.migration(t)), "changes"))
    of_request = lambda df, key: df.withColumn("request", F.col(key) % a.REQUESTS).join(scopes, "request")
    old, new = a.operations(t, False), a.operations(t, True)
    keys = old.select("path", "method", "key").unionByName(new.select("path", "method", "key")).distinct()
    contracts = of_request(contract.endpoints(old, new).join(keys, ["path", "method"]), "key").filter("request % 8 <> 7")
    registry = keys.select("path", "method", F.concat(F.lit("api.N"), (F.col("key") % 25).cast("string")).alias("entity"), F.col("key").alias("ordinal"))
    known = scopes.filter("request % 12 NOT IN (5, 11)")
    deps = a.dependencies(t).join(known)
    lacking = scopes.filter("request % 12 = 5").select(*by, F.lit(False).alias("old_application"), *[F.lit(True).alias(c) for c in ("deployment_context", "old_schema", "new_schema", "old_api", "new_api")], F.array().cast("array<string>").alias("dynamic_dependencies"))
    back = assessment.schema_rollback(changes.join(known, list(by), "left_semi"), a.columns(t, False), deps, by).unionByName(rollback.missing_evidence(lacking, *by).select(*by, "dependency", "rule_id", "severity", "status"))
    components = scopes.filter("request % 10 = 9").withColumn("component", F.lit("deployment_rehearsal")).unionByName(scopes.filter("request % 8 = 7").withColumn("component", F.lit("api_contract")))
    return assessment.Evidence(by, scopes, changes, entities, edges, contracts, registry, back, scopes.filter("request % 12 = 11"), components)


_RUN = f"""WITH RECURSIVE {a.MIGRATION_SQL}, {a.OPERATIONS_SQL}, {a.COLUMNS_SQL}, {a.DEPENDENCIES_SQL}, {a.PRODUCT_SQL}, {a.REQUESTS_SQL}, {_REACH.format(objects='primaries')},
{_grown('SELECT DISTINCT origin FROM targets', 2, 'p_edges')}, {_SCORED.format(k=100)},
rehearsed AS (SELECT p.*, {_STATUS} AS status FROM primaries p LEFT JOIN affected USING (o)),
rolled AS (SELECT scope, o, CASE kind WHEN 'DROP_COLUMN' THEN 'RB-SCHEMA-REMOVED-OLD-DEPENDENCY' WHEN 'ALTER_COLUMN_TYPE' THEN 'RB-SCHEMA-TYPE-CHANGED' END AS rule_id FROM scoped JOIN deps ON dependency = o JOIN old_columns c ON c."table" = scoped."table" AND c."column" = object_name
  WHERE request % 12 NOT IN (5, 11) AND (kind = 'DROP_COLUMN' OR (kind = 'ALTER_COLUMN_TYPE' AND data_type <> after))),
lacks AS (SELECT scope, 'deployment_rehearsal' AS component FROM scopes WHERE request % 10 = 9 UNION ALL SELECT scope, 'api_contract' FROM scopes WHERE request % 8 = 7 UNION ALL SELECT scope, 'blast_radius' FROM scopes WHERE scope NOT IN (SELECT scope FROM targets)),
findings AS (
  SELECT scope, 'blast:' || entity || ':' || (row_number() OVER (PARTITION BY scope ORDER BY origin, severity DESC, hops, entity, string_split(path, '>')) - 1) AS finding_id, 'BLAST_RADIUS' AS category, 'BLAST-DOWNSTREAM-IMPACT' AS rule_id, level AS severity, 1::DOUBLE AS confidence, false AS blocking, NULL::VARCHAR AS uncertainty, entity FROM targets JOIN blast USING (origin)
  UNION ALL SELECT scope, sha256(o || '|' || kind)[1:16], 'DATABASE', kind, severity, CASE WHEN status = 'UNKNOWN' THEN 0.5 ELSE 1 END, status = 'UNSAFE', CASE WHEN status = 'UNKNOWN' THEN 'deployment status is unknown' END, nullif(o, 'UNKNOWN') FROM rehearsed
  UNION ALL SELECT scope, 'api:' || rule_id || ':' || (row_number() OVER (PARTITION BY scope ORDER BY path, method, rule_id) - 1), 'API_CONTRACT', rule_id, CASE WHEN rule_id LIKE '%REMOVED' THEN 'HIGH' ELSE 'LOW' END, 1, rule_id LIKE '%REMOVED', NULL, method || ' ' || path FROM api
  UNION ALL SELECT scope, 'rollback:' || rule_id || ':' || o, 'ROLLBACK', rule_id, CASE WHEN rule_id LIKE '%REMOVED%' THEN 'CRITICAL' ELSE 'MEDIUM' END, 1, rule_id LIKE '%REMOVED%', NULL, o FROM rolled
  UNION ALL SELECT scope, 'rollback:RB-MISSING-OLD-APPLICATION:old_application', 'ROLLBACK', 'RB-MISSING-OLD-APPLICATION', 'MEDIUM', 0, false, 'rollback evidence is unknown', NULL FROM scopes WHERE request % 12 = 5
  UNION ALL SELECT scope, 'rollback:unknown', 'ROLLBACK', 'RB-UNKNOWN', 'MEDIUM', 0, false, 'rollback evidence is unavailable', NULL FROM scopes WHERE request % 12 = 11
  UNION ALL SELECT scope, 'missing:' || component, 'DYNAMIC_REFERENCE', 'ANALYZER-UNAVAILABLE', 'MEDIUM', 0, false, 'required analyzer unavailable', NULL FROM lacks)"""
_SPLIT = "split_part(scope, ':', 1) AS variant, split_part(scope, ':', 2)::BIGINT AS request"


@query(_RUN + f" SELECT {_SPLIT}, finding_id, category, rule_id, severity, confidence, blocking, uncertainty, entity, row_number() OVER (PARTITION BY scope ORDER BY category, rule_id, finding_id) - 1 AS place FROM findings")
def assessed_findings(t):
    """Findings of all six sources for every request and variant, in their order."""
    e = _evidence(t)
    return decision.in_order(assessment.findings(e, max_hops=2), *e.by).select(*e.by, "finding_id", "category", "rule_id", "severity", "confidence", "blocking", "uncertainty", "entity", F.col("place").cast("long").alias("place"))


@query(_RUN + f", {a.DECIDED_SQL} SELECT {_SPLIT}, base_risk, risk, rules, verdict FROM decided")
def assessed_verdicts(t):
    """From changes, contracts and schemas to the verdict of every request and variant, in one run."""
    e = _evidence(t)
    return decision.decide(assessment.findings(e, max_hops=2), list(e.by)).select(*e.by, "base_risk", "risk", "rules", "verdict")


@query(_RUN + f""", {a.DECIDED_SQL}, d AS (SELECT {_SPLIT}, risk, verdict, rules FROM decided),
f AS (SELECT DISTINCT {_SPLIT}, category, rule_id, coalesce(entity, finding_id) AS what FROM findings),
s AS (SELECT request, category, rule_id, what, bool_or(variant = 'proposed') AS b, bool_or(variant = 'expand') AS a FROM f GROUP BY ALL),
n AS (SELECT request, count(*) FILTER (b AND NOT a) AS n_gone, count(*) FILTER (a AND NOT b) AS n_new, count(*) FILTER (a AND b) AS n_same FROM s GROUP BY request)
SELECT request, p.risk AS risk_before, x.risk AS risk_after, x.risk - p.risk AS risk_change, p.verdict AS verdict_before, x.verdict AS verdict_after, p.rules AS rules_before, x.rules AS rules_after, n_gone, n_new, n_same
FROM (SELECT * FROM d WHERE variant = 'proposed') p JOIN (SELECT * FROM d WHERE variant = 'expand') x USING (request) JOIN n USING (request)""")
def counterfactual_run(t):
    """Every request as proposed against the same request without what it drops: both go through the whole run as rows of one plan."""
    e = _evidence(t)
    found = materialize(assessment.findings(e, max_hops=2), "assessed")
    return assessment.compare(found, decision.decide(found, list(e.by)), "variant", "proposed", "expand", ["request"])


@query(f"WITH {a.FINDINGS_SQL} SELECT r AS scope, 'analysis:no-evidence' AS finding_id, 'NO_ANALYSIS_EVIDENCE' AS rule_id, 'INFO' AS severity FROM (SELECT n_nationkey AS r FROM nation) WHERE r NOT IN (SELECT scope FROM findings)")
def silent_scopes(t):
    """Scopes without any finding, which must not look as if nothing were wrong."""
    scopes = t.nation.select(F.col("n_nationkey").cast("long").alias("scope"))
    return decision.without_evidence(scopes, a.findings(t), "scope").select("scope", "finding_id", "rule_id", "severity")


_DECIDED = f"WITH {a.FINDINGS_SQL}"
_FEEDS = "CASE WHEN category IN ('BLAST_RADIUS', 'API_CONTRACT') THEN 'blast_severity' WHEN category = 'ROLLBACK' THEN 'rollback_unsafety' ELSE 'deployment_severity' END"


@query(f"""{_DECIDED}, rule AS (SELECT scope, unnest(string_split(rules, ',')) AS r FROM decided), valued AS (SELECT scope, unnest(['blast_severity', 'deployment_severity', 'rollback_unsafety']) AS f, unnest([blast_severity, deployment_severity, rollback_unsafety]) AS v FROM decided),
fed AS (SELECT f.scope, f.finding_id, f.rule_id, f.entity FROM findings f JOIN valued v ON v.scope = f.scope AND v.f = {_FEEDS} AND v.v > 0),
chain AS (SELECT scope, 'verdict' AS node_id, 'VERDICT' AS kind, verdict AS label, 93 AS layer FROM decided UNION ALL SELECT scope, 'policy:' || r, 'POLICY_RULE', r, 92 FROM rule UNION ALL SELECT scope, 'risk:' || f, 'RISK_FEATURE', f, 91 FROM valued WHERE v > 0
  UNION ALL SELECT scope, 'finding:' || finding_id, 'FINDING', rule_id, 90 FROM fed UNION ALL SELECT DISTINCT scope, 'entity:' || entity, 'SOURCE_SYMBOL', entity, 0 FROM fed)
SELECT *, row_number() OVER (PARTITION BY scope ORDER BY layer, node_id, label) - 1 AS place FROM chain""")
def verdict_chain(t):
    """Of every scope the nodes that led to its verdict, in the order of layer and id."""
    found, by = a.findings(t), ["scope"]
    decided = decision.decide(found, by)
    return evidence.verdict_chain(evidence.nodes(found, decided, by), evidence.edges(found, decided, by), by).withColumn("place", F.col("place").cast("long"))


def _claims(t):
    """A claim per finding, of which every fifth names a wrong finding, every seventh a wrong risk and every eleventh a wrong entity."""
    found = a.findings(t)
    key = F.split("finding_id", ":")[1].cast("long")
    rows = found.join(decision.decide(found, ["scope"]).select("scope", "risk", "verdict"), "scope").withColumn("k", key)
    name = lambda wrong, right: F.when(wrong, F.concat(right, F.lit("0x"))).otherwise(right)
    text = F.concat(F.lit("Finding "), name(F.col("k") % 5 == 0, F.col("finding_id")), F.lit(" ("), F.col("rule_id"), F.lit(") touches "), F.when(F.col("k") % 11 == 0, F.concat(F.lit("nobody."), F.col("entity"))).otherwise(F.col("entity")), F.lit("; the risk is "), (F.col("risk") + F.when(F.col("k") % 7 == 0, 1000).otherwise(0)).cast("string"), F.lit("."))
    return rows.select("scope", F.col("k").alias("claim_id"), text.alias("text"))


@query(f"""{_DECIDED}, c AS (SELECT scope, split_part(finding_id, ':', 2)::BIGINT AS claim_id, finding_id, entity, risk FROM findings JOIN decided USING (scope))
SELECT scope, claim_id, finding_id || '0x' AS fact FROM c WHERE claim_id % 5 = 0 UNION ALL SELECT scope, claim_id, 'nobody.' || entity FROM c WHERE claim_id % 11 = 0 UNION ALL SELECT scope, claim_id, (risk + 1000)::VARCHAR FROM c WHERE claim_id % 7 = 0""")
def unfounded_claims(t):
    """What claims state in their texts and no evidence of their scope bears out: ids, rules, entities and numbers."""
    found, by = a.findings(t), ["scope"]
    return evidence.unfounded(_claims(t), evidence.known_facts(found, decision.decide(found, by), by), by)


@query(f"""{_DECIDED}, d AS (SELECT * FROM findings WHERE scope % 2 = 0 OR rule_id NOT LIKE 'DROP%'), s AS (SELECT scope, finding_id || ':expand' AS step_id, CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN severity ELSE 'LOW' END AS priority FROM d WHERE rule_id LIKE 'DROP%' UNION ALL SELECT scope, finding_id || ':verify', 'HIGH' FROM d WHERE rule_id LIKE 'DROP%'),
w AS (SELECT * FROM s UNION ALL SELECT scope, 'policy:' || split_part(rules, ',', 1), 'HIGH' FROM decided WHERE scope NOT IN (SELECT scope FROM s))
SELECT *, row_number() OVER (PARTITION BY scope ORDER BY CASE priority WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, step_id) - 1 AS place FROM w""")
def policy_steps(t):
    """Steps of every scope by priority; scopes of odd number have no destructive finding, so that the policy speaks."""
    found, by = a.findings(t), ["scope"]
    steps = decision.policy_steps(found.filter("scope % 2 = 0 OR rule_id NOT LIKE 'DROP%'"), decision.decide(found, by), by)
    return steps.withColumn("place", F.col("place").cast("long"))


@query(f"WITH {a.COLUMNS_SQL}, d AS (SELECT coalesce(o.\"table\", n.\"table\") AS \"table\", coalesce(o.\"column\", n.\"column\") AS \"column\", CASE WHEN o.\"table\" IS NULL THEN 'ADDED' WHEN n.\"table\" IS NULL THEN 'REMOVED' WHEN o.data_type = n.data_type AND o.nullable = n.nullable THEN 'UNCHANGED' ELSE 'CHANGED' END AS status FROM old_columns o FULL JOIN new_columns n ON o.\"table\" = n.\"table\" AND o.\"column\" = n.\"column\") SELECT \"table\", \"column\", status, CASE status WHEN 'REMOVED' THEN 0 WHEN 'CHANGED' THEN 1 ELSE 2 END AS rank FROM d WHERE status <> 'UNCHANGED'")
def shown_differences(t):
    """Schema differences as reports show them."""
    return schema.shown_differences(schema.difference(a.columns(t, False), a.columns(t, True))).select("table", "column", "status", "rank")


_STATS = "s AS (SELECT p_partkey, p_partkey % 3 AS nodes, p_partkey % 2 AS unsupported, p_partkey % 5 <> 0 AS has_migration, p_partkey % 7 = 0 AS migration_failed, p_partkey % 11 <> 0 AS has_target, p_partkey % 4 <> 0 AS has_contract, p_partkey % 13 = 0 AS contract_failed, ['SAFE', 'CAUTION', 'UNSAFE', 'UNKNOWN'][p_partkey % 4 + 1] AS rollback FROM part)"


def _stats(t):
    k = F.col("p_partkey")
    status = F.get(F.array(*map(F.lit, ("SAFE", "CAUTION", "UNSAFE", "UNKNOWN"))), (k % 4).cast("int"))
    stats = t.part.select("p_partkey", (k % 3).alias("nodes"), (k % 2).alias("unsupported"), (k % 5 != 0).alias("has_migration"), (k % 7 == 0).alias("migration_failed"), (k % 11 != 0).alias("has_target"), (k % 4 != 0).alias("has_contract"), (k % 13 == 0).alias("contract_failed"), status.alias("rollback"))
    return decision.capabilities(stats, ["p_partkey"])


@query(f"""WITH {_STATS} SELECT p_partkey, unnest(['source', 'database', 'blast_radius', 'api_contract', 'rollback']) AS component, CASE WHEN unnest([nodes > 0, has_migration AND NOT migration_failed, nodes > 0 AND has_target, has_contract AND NOT contract_failed, rollback <> 'UNKNOWN']) THEN 'COMPLETED' ELSE 'UNAVAILABLE' END AS stage_status FROM s""")
def stage_flags(t):
    return decision.stage_flags(_stats(t), ["p_partkey"])


@query(f"WITH {_STATS} SELECT p_partkey, nodes > 0 AND has_migration AND NOT migration_failed AND has_contract AND NOT contract_failed AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7) AS clean FROM s")
def coverage_clean(t):
    """Parts whose analyzers all ran and of which nothing was diagnosed (a returned seventh line stands for a diagnosis)."""
    lacking = _stats(t).filter("component IN ('source', 'database', 'api_contract') AND status <> 'ANALYZED'")
    diagnosed = t.lineitem.filter("l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_partkey").alias("p_partkey"))
    return decision.coverage_clean(t.part.select("p_partkey"), lacking, diagnosed, ["p_partkey"])


@query(f"WITH {a.COLUMNS_SQL}, {a.DEPENDENCIES_SQL}, f AS (SELECT p_partkey % 10 AS release, 'FORWARD' AS direction, 2 AS r FROM part WHERE p_partkey % 4 < 2 UNION ALL SELECT CAST(regexp_extract(dependency, 'c([0-9]+)', 1) AS BIGINT) % 10, 'ROLLBACK', CASE WHEN nt IS NULL THEN 3 ELSE 1 END FROM (SELECT dependency, o.data_type AS ot, o.nullable AS oin, n.data_type AS nt, n.nullable AS nin FROM deps JOIN old_columns o ON dependency = o.\"table\" || '.' || o.\"column\" LEFT JOIN new_columns n ON dependency = n.\"table\" || '.' || n.\"column\") WHERE nt IS NULL OR ot <> nt OR (oin AND NOT nin)) SELECT release, direction, count(*) AS n_findings, ['SAFE', 'CAUTION', 'UNKNOWN', 'UNSAFE'][max(r) + 1] AS status FROM f GROUP BY ALL")
def rollback_directions(t):
    """Findings about going back and about staying ahead, per release; where the new application or schema wasn't given, the latter are unknown."""
    key = F.col("p_partkey")
    requests = t.part.select((key % 10).alias("release"), (key % 4 > 0).alias("new_application"), (key % 4 != 1).alias("new_schema"))
    forward = rollback.forward_evidence(requests, "release")
    back = rollback.schema_dependencies(a.dependencies(t), a.columns(t, False), a.columns(t, True)).select((F.regexp_extract("dependency", "c([0-9]+)", 1).cast("long") % 10).alias("release"), "status", F.lit("ROLLBACK").alias("direction"))
    return rollback.by_direction(forward.select("release", "status", "direction").unionByName(back), ["release"])


def _placed(df, by, *order):
    """``df`` with ``place`` within ``by``, in an order that a report fixes."""
    return decision.numbered(df, by, [F.asc(c) for c in order]).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {a.EDGES_SQL}, {_grown(chr(39).join(['SELECT ', 'region:0', ' AS origin']), 2)} SELECT array_to_string(nodes, '>') AS path, hops::INT AS hops, row_number() OVER (ORDER BY hops, nodes) - 1 AS place FROM found")
def ordered_paths(t):
    """Paths downstream of a region in the order of length, then nodes."""
    found = graph.paths(a.edges(t, repeats=True), a.origins(t, "region:0"), 2)
    return _placed(found.select("hops", "nodes"), [], "hops", "nodes").select(F.concat_ws(">", "nodes").alias("path"), "hops", "place")


@query(f"WITH {a.EDGES_SQL} SELECT source, target, kind, row_number() OVER (ORDER BY source, target, kind) - 1 AS place FROM edges")
def ordered_edges(t):
    """All edges of the graph in their canonical order."""
    return _placed(a.edges(t), [], "source", "target", "kind")


@query("""WITH r AS (SELECT l_partkey AS file, l_linenumber AS line, l_suppkey AS "column", 'r' || l_orderkey AS text FROM lineitem) SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, "column", text) - 1 AS place FROM r""")
def ordered_references(t):
    """References of each file by line, column and text."""
    rows = t.lineitem.select(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("column"), F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("text"))
    return _placed(rows, ["file"], "line", "column", "text")


@query(f"WITH {a.COLUMNS_SQL}, {a.DEPENDENCIES_SQL}, f AS (SELECT dependency AS entity, CASE WHEN nt IS NULL THEN 'RB-SCHEMA-REMOVED-OLD-DEPENDENCY' WHEN ot <> nt THEN 'RB-SCHEMA-TYPE-CHANGED' ELSE 'RB-SCHEMA-NOT-NULL-OLD-DEPENDENCY' END AS rule_id, 'ROLLBACK' AS direction FROM (SELECT dependency, o.data_type AS ot, o.nullable AS oin, n.data_type AS nt, n.nullable AS nin FROM deps JOIN old_columns o ON dependency = o.\"table\" || '.' || o.\"column\" LEFT JOIN new_columns n ON dependency = n.\"table\" || '.' || n.\"column\") WHERE nt IS NULL OR ot <> nt OR (oin AND NOT nin)) SELECT *, row_number() OVER (ORDER BY rule_id, entity, direction) - 1 AS place FROM f")
def ordered_rollback(t):
    """Findings of rollback by rule, entity and direction."""
    found = rollback.schema_dependencies(a.dependencies(t), a.columns(t, False), a.columns(t, True))
    return _placed(found.select(F.col("dependency").alias("entity"), "rule_id", F.lit("ROLLBACK").alias("direction")), [], "rule_id", "entity", "direction")


@query(f"{_DECIDED}, r AS (SELECT DISTINCT severity FROM findings), t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'Critical' WHEN 2 THEN 'severe' END AS said FROM events) SELECT event_id, CASE WHEN upper(said) IN ('INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper(said) ELSE 'MEDIUM' END AS severity FROM t")
def severity_texts(t):
    """Severities as texts have them; what is unknown or missing is medium."""
    said = F.when(F.col("event_id") % 4 == 0, "high").when(F.col("event_id") % 4 == 1, "Critical").when(F.col("event_id") % 4 == 2, "severe")
    return t.events.select("event_id", decision.severity_of_text(said).alias("severity"))


@query(f"""WITH {a.FILES_SQL}, j AS (SELECT sha256('{{"new_sha256":' || coalesce('"' || new_sha256 || '"', 'null') || ',"old_sha256":' || coalesce('"' || old_sha256 || '"', 'null') || ',"path":"' || path || '","status":"' || status || '"}}') AS h FROM diff), l AS (SELECT h[1:4] AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM j GROUP BY 1) SELECT sha256(string_agg(h, ',' ORDER BY b)) AS sha256 FROM l""")
def change_set_digest(t):
    """One digest of all changes between two snapshots, whatever the order in which they are found."""
    return sinks.change_set_hash(snapshots.difference(a.files(t, False), a.files(t, True)))


@query("""WITH u AS (SELECT doc_id, lang, source, text AS head FROM documents), e AS (SELECT doc_id, lang, source, head, CASE WHEN head IS NULL THEN 'null' ELSE '"' || array_to_string(list_transform(string_split(head, ''), lambda c: CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN unicode(c) < 128 THEN c ELSE '\\u' || lpad(lower(hex(unicode(c))), 4, '0') END), '') || '"' END AS h FROM u)
SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"head":' || h || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS row_sha256 FROM e""")
def ascii_row_hash(t):
    """The digest of each document's ASCII JSON: letters beyond ASCII are escaped."""
    rows = t.documents.select("doc_id", "lang", "source", F.col("text").alias("head"))
    return rows.select("doc_id", F.sha2(sinks.ascii_json(sinks.sorted_struct(rows)), 256).alias("row_sha256"))


@query("""WITH k AS (SELECT 'api/' || c_nationkey || '.json' AS contract, '/c/' || c_custkey AS path, c_custkey AS k FROM customer WHERE c_custkey % 10 <> 0)
SELECT contract, path, 'POST' AS method, 'REQUEST' AS direction, unnest(['', 'next', 'v']) AS location, unnest(['object', NULL, 'string']) AS type, false AS required, unnest([0, 0, 2]) AS n_values FROM k
UNION ALL SELECT contract, path, 'POST', 'RESPONSE', unnest(['200', '200.f.' || k]), unnest(['object', 'string']), unnest([false, true]), 0 FROM k""")
def contract_nodes(t):
    """Schema nodes read from contracts in JSON; a schema that refers to itself is followed once."""
    nodes = contracts.schema_nodes(a.documents_of_contracts(t, False))
    return nodes.select("contract", "path", "method", "direction", "location", "type", "required", F.size("enum").alias("n_values"))


@query("""SELECT '/c/' || c_custkey AS path, 'POST' AS method, 'API-TYPE-NARROWED' AS rule_id, 'RESPONSE.200.f.' || c_custkey AS location, 'BREAKING' AS compatibility FROM customer WHERE c_custkey % 10 > 1 AND c_custkey % 7 = 0
UNION ALL SELECT '/c/' || c_custkey, 'POST', 'API-ENDPOINT-REMOVED', 'endpoint', 'BREAKING' FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT '/c/' || c_custkey, 'POST', 'API-ENDPOINT-ADDED', 'endpoint', 'SAFE' FROM customer WHERE c_custkey % 10 = 0""")
def contract_files_diff(t):
    """Two sets of contracts, from their texts to what changed: operations, and schema nodes of those that both have."""
    old, new = a.documents_of_contracts(t, False), a.documents_of_contracts(t, True)
    before, after = (materialize(contracts.operations(d).select("path", "method"), "operations") for d in (old, new))
    operations = contract.endpoints(before, after)
    both = before.join(after.hint("merge"), ["path", "method"], "left_semi")
    nodes = [materialize(contracts.schema_nodes(d).join(both.hint("merge"), ["path", "method"], "left_semi"), "nodes") for d in (old, new)]
    return operations.unionByName(contract.schema_nodes(*nodes))


@query("SELECT doc_id, sha256(CASE WHEN text LIKE '%Bearer %' OR text LIKE '%postgres://%' OR text LIKE '%mysql://%' THEN '[REDACTED]' ELSE text END) AS shown_sha256 FROM documents")
def redact_rollback(t):
    """Values of rollback evidence; a text with a bearer token or a connection isn't shown at all."""
    shown = redactions.redact_evidence(F.create_map(F.lit("text"), F.col("text")), redactions.ROLLBACK_MARKS)["text"]
    return t.documents.select("doc_id", F.sha2(shown, 256).alias("shown_sha256"))


_SYMBOLS = "old AS (SELECT DISTINCT p_brand || '.py' AS file, p_name AS symbol FROM part WHERE p_partkey % 10 <> 0), new AS (SELECT DISTINCT p_brand || '.py' AS file, p_name AS symbol FROM part WHERE p_partkey % 10 <> 1), c AS (SELECT *, 'REMOVED' AS kind FROM (SELECT * FROM old EXCEPT SELECT * FROM new) UNION ALL SELECT *, 'ADDED' FROM (SELECT * FROM new EXCEPT SELECT * FROM old))"


@query(f"WITH {_SYMBOLS} SELECT *, row_number() OVER (ORDER BY file, symbol, kind) - 1 AS place FROM c")
def ordered_structural_changes(t):
    """Symbols that came or went, by file, name and kind."""
    side = lambda gone: t.part.filter(F.col("p_partkey") % 10 != gone).select(F.concat("p_brand", F.lit(".py")).alias("file"), F.lit("FUNCTION").alias("kind"), F.col("p_name").alias("name")).distinct()
    old, new = side(0), side(1)
    change = lambda df, kind: df.select("file", F.col("name").alias("symbol"), F.lit(kind).alias("kind"))
    return _placed(change(snapshots.symbols_missing(old, new), "REMOVED").unionByName(change(snapshots.symbols_missing(new, old), "ADDED")), [], "file", "symbol", "kind")


@query(f"{_DECIDED} SELECT scope, 'entity:' || entity AS source, 'finding:' || finding_id AS target, 'PRODUCES' AS kind, row_number() OVER (PARTITION BY scope ORDER BY 'entity:' || entity, 'finding:' || finding_id) - 1 AS place FROM findings")
def ordered_evidence_edges(t):
    """Edges from entities to findings of every scope, by source, target and kind."""
    found, by = a.findings(t), ["scope"]
    made = evidence.edges(found, decision.decide(found, by), by).filter("kind = 'PRODUCES'")
    return _placed(made, by, "source", "target", "kind")


@query(f"""WITH {a.EXTRACTION_SQL}, e AS (SELECT DISTINCT entity_id FROM declared WHERE entity_id IS NOT NULL), h AS (SELECT sha256('{{"entity_id":"' || entity_id || '"}}') AS h FROM e), l AS (SELECT h[1:4] AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM h GROUP BY 1)
SELECT (SELECT count(DISTINCT file) FROM declared) AS n_files, (SELECT count(*) FROM declared) AS n_symbols, (SELECT count(*) FROM referred) AS n_references, (SELECT count(*) FROM referred WHERE status IN ('EXACT', 'IMPORTED', 'QUALIFIED', 'PROJECT_UNIQUE')) AS n_resolved, (SELECT count(*) FROM referred WHERE status = 'UNRESOLVED') AS n_unresolved, (SELECT count(*) FROM e) AS n_entities, (SELECT sha256(string_agg(h, ',' ORDER BY b)) FROM l) AS graph_sha256""")
def inspection(t):
    """Counts of an extraction with the digest of its entities, of which repeated ones count once."""
    entities = a.declared(t).filter("entity_id IS NOT NULL").select("entity_id").dropDuplicates()
    return extraction.inspection(a.declared(t), a.referred(t), entities, sinks.digest(entities))


@query(f"WITH {a.EDGES_SQL}, p AS (SELECT DISTINCT target AS entity, source AS origin FROM edges WHERE source LIKE 'supplier:%') SELECT entity, origin, count(*) OVER (PARTITION BY entity) AS n_origins FROM p QUALIFY n_origins >= 2")
def convergent_pairs(t):
    """Parts that several suppliers' blast radius reaches, with each of these."""
    starts = t.supplier.select(a.node("supplier", "s_suppkey").alias("origin"))
    return graph.convergence_links(graph.blast_radius(a.edges(t, repeats=True), starts, 1, 1_000_000, a.parts(t)), a.parts(t))
