"""Queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import text
from causeway.operators import contract, decision, evidence, extraction, graph, resolution, rollback, schema, snapshots
from causeway.plans import adapters as a
from causeway.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None) -> Callable:
    """Register a function of ``Tables`` with its SQL."""

    def wrap(f: Callable[[a.Tables], DataFrame]) -> Callable[[a.Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(a.Tables(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return wrap


def _grown(origins: str, hops: int, graph_name: str = "edges") -> str:
    """CTEs ``step`` and ``found`` of all simple paths up to ``hops``."""
    kinds = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in graph.WEIGHTS.items())
    level = "p{h} AS (SELECT origin, list_append(nodes, s.target) AS nodes, list_append(kinds, s.kind) AS kinds, product * s.w AS product, {h} AS hops FROM p{b} JOIN step s ON s.source = nodes[-1] WHERE NOT list_contains(nodes, s.target))"
    levels = ", ".join(level.format(h=h, b=h - 1) for h in range(1, hops + 1))
    return f"""step AS (SELECT source, target, max(kind) AS kind, CASE max(kind) {kinds} ELSE 0.5::DOUBLE END AS w FROM {graph_name} GROUP BY source, target),
origins AS ({origins}), p0 AS (SELECT origin, [origin] AS nodes, []::VARCHAR[] AS kinds, 1.0::DOUBLE AS product, 0 AS hops FROM origins),
{levels}, found AS ({' UNION ALL '.join(f'SELECT * FROM p{h}' for h in range(1, hops + 1))})"""


_SCORED = """scored AS (SELECT origin, nodes, kinds, hops, round_even(product / (1 + 0.5::DOUBLE * (hops - 1)), 6) AS severity, row_number() OVER (PARTITION BY origin ORDER BY hops, nodes) AS place FROM found),
blast AS (SELECT origin, nodes[-1] AS entity, hops::INT AS hops, array_to_string(nodes, '>') AS path, severity, CASE WHEN severity >= 0.9 THEN 'CRITICAL' WHEN severity >= 0.7 THEN 'HIGH' WHEN severity >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  CASE WHEN hops = 1 THEN 'DIRECT' ELSE 'INDIRECT' END AS category, array_to_string(kinds, ' -> ') AS reason FROM scored WHERE place <= {k})"""
_ALL_REGIONS = "SELECT 'region:' || r_regionkey AS origin FROM region"


def _blast_sql(origins: str, hops: int, k: int, tail: str) -> str:
    return f"WITH {a.EDGES_SQL}, {_grown(origins, hops)}, {_SCORED.format(k=k)} {tail}"


def _regions(t: a.Tables) -> DataFrame:
    return t.region.select(a.node("region", "r_regionkey").alias("origin"))


@query(_blast_sql("SELECT 'region:0' AS origin", 3, 1000, "SELECT * FROM blast"))
def blast_radius_region(t):
    return graph.blast_radius(a.edges(t, repeats=True), a.origins(t, "region:0"), 3, 1000)


@query(_blast_sql("SELECT 'region:0' AS origin", 3, 100, "SELECT * FROM blast"))
def blast_radius_top100(t):
    return graph.blast_radius(a.edges(t, repeats=True), a.origins(t, "region:0"), 3, 100)


@query(_blast_sql("SELECT 'supplier:0' AS origin", 2, 1000, "SELECT * FROM blast"))
def blast_radius_cycles(t):
    return graph.blast_radius(a.edges(t, repeats=True), a.origins(t, "supplier:0"), 2, 1000)


_SUMMARY = "SELECT origin, count(DISTINCT entity) FILTER (category = 'DIRECT') AS direct, count(DISTINCT entity) FILTER (category = 'INDIRECT') AS indirect, count(DISTINCT entity) AS affected, max(severity) AS max_severity FROM blast GROUP BY origin"


@query(_blast_sql("SELECT 'region:0' AS origin", 3, 1000, _SUMMARY))
def blast_radius_summary(t):
    return graph.impact_summary(blast_radius_region(t))


@query(_blast_sql(_ALL_REGIONS, 2, 500, "SELECT * FROM blast"))
def blast_radius_multi_target(t):
    return graph.blast_radius(a.edges(t, repeats=True), _regions(t), 2, 500)


@query(_blast_sql(_ALL_REGIONS, 2, 500, "SELECT count(*) FILTER (category = 'DIRECT') AS direct, count(*) FILTER (category = 'INDIRECT') AS indirect, count(DISTINCT entity) AS affected FROM blast"))
def blast_radius_merged_summary(t):
    return graph.merged_summary(blast_radius_multi_target(t))


@query(_blast_sql("SELECT 'supplier:' || s_suppkey AS origin FROM supplier", 1, 1000, "SELECT entity, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, count(DISTINCT origin)::INT AS n_origins FROM blast GROUP BY entity HAVING count(DISTINCT origin) >= 2"))
def convergence(t):
    starts = t.supplier.select(a.node("supplier", "s_suppkey").alias("origin"))
    return graph.convergence(graph.blast_radius(a.edges(t, repeats=True), starts, 1, 1000))


@query(f"WITH {a.TRANSITIONS_SQL}, {_grown(chr(39).join(['SELECT ', 'event:click', ' AS origin']), 5)} SELECT origin, array_to_string(nodes, '>') AS path, hops::INT AS hops FROM found")
def downstream_paths_events(t):
    return graph.all_paths(a.transitions(t), a.origins(t, "event:click")).select("origin", F.concat_ws(">", "nodes").alias("path"), "hops")


@query(f"WITH {a.EDGES_SQL}, {_grown(chr(39).join(['SELECT ', 'region:0', ' AS origin']), 3)} SELECT origin, hops::INT AS hops, array_to_string(nodes, '>') AS path FROM found WHERE nodes[-1] = 'part:1' ORDER BY hops, nodes LIMIT 1")
def canonical_path(t):
    return graph.canonical_path(a.edges(t, repeats=True), a.origins(t, "region:0"), "part:1", 3)


_REACH = "r0 AS (SELECT {o} AS node, 0 AS hop), r1 AS (SELECT DISTINCT target AS node, 1 AS hop FROM {e} e JOIN r0 ON e.source = r0.node), r2 AS (SELECT DISTINCT target AS node, 2 AS hop FROM {e} e JOIN r1 ON e.source = r1.node), r3 AS (SELECT DISTINCT target AS node, 3 AS hop FROM {e} e JOIN r2 ON e.source = r2.node), seen AS (SELECT node, min(hop)::INT AS hop FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY node)"


@query(f"WITH {a.EDGES_SQL}, {_REACH.format(o=repr('region:1'), e='edges')} SELECT node, hop FROM seen")
def reachable_set(t):
    return graph.reachable(a.edges(t, repeats=True), a.origins(t, "region:1"), 3)


@query(f"WITH {a.EDGES_SQL}, back AS (SELECT target AS source, source AS target FROM edges), {_REACH.format(o=repr('part:1'), e='back')} SELECT node, hop FROM seen")
def reverse_chain(t):
    return graph.reachable(graph.reversed_edges(a.edges(t, repeats=True)), a.origins(t, "part:1"), 3)


@query(f"WITH {a.EDGES_SQL}, {_REACH.format(o=repr('region:1'), e='edges')} SELECT hop, count(*) AS n_nodes, min(node) AS first_node FROM seen GROUP BY hop")
def hop_layers(t):
    return reachable_set(t).groupBy("hop").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first_node"))


@query(f"WITH {a.EDGES_SQL} SELECT source, target, max(kind) AS kind FROM parallel GROUP BY source, target")
def parallel_edge_collapse(t):
    return graph.collapse(a.edges(t, parallel=True, repeats=True), a.parts(t))


@query(f"WITH {a.EDGES_SQL}, {a.ENTITIES_SQL} SELECT DISTINCT e AS entity_id FROM (SELECT source AS e FROM edges UNION ALL SELECT target FROM edges) WHERE e NOT IN (SELECT entity_id FROM entities)")
def graph_validate_dangling(t):
    return graph.dangling(a.entities(t), a.edges(t, repeats=True), a.parts(t))


@query(f"WITH {a.EDGES_SQL}, doubled AS (SELECT * FROM edges UNION ALL SELECT * FROM edges WHERE kind = 'HTTP_CALL') SELECT source, target, kind, count(*) AS n FROM doubled GROUP BY ALL HAVING count(*) > 1")
def graph_validate_duplicates(t):
    edges = a.edges(t)
    return graph.duplicate_edges(edges.unionByName(edges.filter("kind = 'HTTP_CALL'")), a.parts(t))


@query("SELECT 'n:' || n_nationkey AS source, 'n:' || n_regionkey AS target, 'CALL' AS kind FROM nation WHERE n_nationkey = n_regionkey")
def graph_validate_self_loops(t):
    return graph.self_loops(t.nation.select(a.node("n", "n_nationkey").alias("source"), a.node("n", "n_regionkey").alias("target"), F.lit("CALL").alias("kind")))


@query(f"WITH {a.EDGES_SQL} SELECT kind, count(*) AS n_edges FROM edges GROUP BY kind")
def edge_kind_histogram(t):
    return graph.kind_histogram(a.edges(t))


@query("WITH e AS (SELECT 't' || (p_partkey // 20) || '.c' || p_partkey AS entity_id FROM part WHERE p_partkey % 2 = 0), o AS (SELECT 't' || (p_partkey // 20) || '.c' || p_partkey AS object FROM part), x AS (SELECT object, entity_id FROM o JOIN e ON object = entity_id) SELECT * FROM x UNION ALL SELECT object, entity_id FROM o JOIN e ON split_part(object, '.', 1) = split_part(entity_id, '.', 1) WHERE object NOT IN (SELECT object FROM x)")
def prefix_correlation(t):
    name = F.concat(F.lit("t"), F.floor(F.col("p_partkey") / 20).cast("string"), F.lit(".c"), F.col("p_partkey").cast("string"))
    return graph.correlate(t.part.filter("p_partkey % 2 = 0").select(name.alias("entity_id")), t.part.select(name.alias("object")))


def _diff(t):
    return snapshots.difference(a.files(t, False), a.files(t, True))


@query(f"WITH {a.FILES_SQL} SELECT path, status, old_sha256, new_sha256 FROM diff")
def snapshot_diff(t):
    return _diff(t)


@query(f"WITH {a.FILES_SQL} SELECT count(*) FILTER (status = 'ADDED') AS added, count(*) FILTER (status = 'MODIFIED') AS modified, count(*) FILTER (status = 'REMOVED') AS removed, count(*) FILTER (status = 'SAME') AS same FROM diff")
def snapshot_diff_counts(t):
    return snapshots.counts(_diff(t))


@query(f"WITH {a.FILES_SQL} SELECT path, status, old_sha256, new_sha256 FROM diff WHERE status <> 'SAME'")
def changed_only(t):
    return snapshots.changed(_diff(t))


_DOMAIN = "CASE WHEN path LIKE '%.sql' THEN 'DATABASE' WHEN path LIKE '%/openapi.yaml' THEN 'API' WHEN path LIKE '%.py' OR path LIKE '%.js' THEN 'SOURCE' WHEN path LIKE '%/settings.yml' THEN 'CONFIG' WHEN path LIKE '%/k8s/%' THEN 'DEPLOYMENT' WHEN path LIKE '%/package.json' THEN 'DEPENDENCY' ELSE 'UNKNOWN' END"


@query(f"WITH {a.FILES_SQL} SELECT {_DOMAIN} AS domain, count(*) AS n_files FROM diff WHERE status <> 'SAME' GROUP BY 1")
def changed_domains(t):
    return snapshots.changed_domains(_diff(t))


@query(f"WITH {a.FILES_SQL} SELECT path, {_DOMAIN} AS domains FROM new_files")
def domain_labels(t):
    return a.files(t, True).select("path", F.concat_ws(",", snapshots.domains(F.col("path"))).alias("domains"))


@query(f"WITH {a.FILES_SQL} SELECT CASE WHEN path LIKE 'node_modules/%' THEN 'ignored' WHEN path LIKE '%/openapi.yaml' THEN 'api_contract' WHEN path LIKE '%.py' THEN 'semantic' WHEN path LIKE '%.sql' THEN 'migration_candidate' ELSE 'other' END AS class, count(*) AS n_files FROM new_files GROUP BY 1")
def manifest_classify(t):
    return a.files(t, True).groupBy(snapshots.classify(F.col("path")).alias("class")).agg(F.count("*").alias("n_files"))


@query(f"WITH {a.FILES_SQL} SELECT 'python' AS language, count(*) AS n_files FROM new_files WHERE path LIKE '%.py'")
def language_histogram(t):
    return a.files(t, True).groupBy(snapshots.language(F.col("path")).alias("language")).agg(F.count("*").alias("n_files")).filter("language IS NOT NULL")


@query(f"WITH {a.FILES_SQL} SELECT path FROM new_files WHERE path LIKE '%/package.json'")
def framework_signals(t):
    return a.files(t, True).filter(snapshots.name_of(F.col("path")).isin(*snapshots.MARKERS)).select("path")


@query(f"WITH {a.FILES_SQL} SELECT max(path) AS path FROM new_files WHERE path LIKE '%.sql'")
def pick_migration_file(t):
    return snapshots.pick_migration(a.files(t, True))


@query(f"WITH {a.FILES_SQL} SELECT min(path) AS path FROM new_files WHERE path LIKE '%/openapi.yaml'")
def pick_contract_file(t):
    return snapshots.pick_first(a.files(t, True), "openapi.yaml")


@query("WITH e AS (SELECT event_id, event_id // 6000 AS archive, event_id % 6000 AS ordinal, CASE event_id % 97 WHEN 0 THEN '../x' WHEN 1 THEN '/abs' WHEN 2 THEN 'C:\\x' ELSE 'ok/f' || event_id END AS name, event_id % 19 = 0 AS link, event_id % 23 = 0 AS dir, CASE WHEN event_id % 211 = 0 THEN 21000000 WHEN event_id % 101 = 0 THEN 1500000 WHEN event_id % 103 = 0 THEN 1048576 ELSE (event_id * 997) % 40000 END AS fs, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 103 = 0 THEN 5000 ELSE (event_id * 31) % 50000 END AS cs FROM events), s AS (SELECT *, sum(CASE WHEN dir THEN 0 ELSE fs END) OVER (PARTITION BY archive ORDER BY ordinal) AS total FROM e) SELECT archive, ordinal, total::BIGINT AS total, CASE WHEN name LIKE '../%' OR name LIKE '/%' OR name LIKE 'C:%' THEN 'UNSAFE_PATH' WHEN dir THEN CASE WHEN ordinal >= 5000 THEN 'TOO_MANY' ELSE 'OK' END WHEN link THEN 'SYMLINK' WHEN ordinal >= 5000 THEN 'TOO_MANY' WHEN fs > 20971520 THEN 'TOO_LARGE' WHEN fs >= 1048576 AND cs > 0 AND fs > 200.0 * cs THEN 'BOMB' WHEN total > 157286400 THEN 'TOTAL' ELSE 'OK' END AS verdict FROM s")
def archive_plan(t):
    key = F.col("event_id")
    name = F.when(key % 97 == 0, "../x").when(key % 97 == 1, "/abs").when(key % 97 == 2, "C:\\x").otherwise(F.concat(F.lit("ok/f"), key.cast("string")))
    size = F.when(key % 211 == 0, 21000000).when(key % 101 == 0, 1500000).when(key % 103 == 0, 1048576).otherwise((key * 997) % 40000).cast("long")
    listing = t.events.select(F.floor(key / 6000).alias("archive"), (key % 6000).alias("ordinal"), name.alias("name"), (key % 23 == 0).alias("is_dir"), (key % 19 == 0).alias("is_symlink"), size.alias("file_size"), F.when(key % 3 == 0, 0).when(key % 103 == 0, 5000).otherwise((key * 31) % 50000).alias("compress_size"))
    return snapshots.archive_plan(listing).select("archive", "ordinal", "total", "verdict")


@query(f"WITH {a.COLUMNS_SQL} SELECT coalesce(o.\"table\", n.\"table\") AS \"table\", coalesce(o.\"column\", n.\"column\") AS \"column\", CASE WHEN o.\"table\" IS NULL THEN 'ADDED' WHEN n.\"table\" IS NULL THEN 'REMOVED' WHEN o.data_type = n.data_type AND o.nullable = n.nullable THEN 'UNCHANGED' ELSE 'CHANGED' END AS status, o.data_type AS old_type, n.data_type AS new_type FROM old_columns o FULL JOIN new_columns n ON o.\"table\" = n.\"table\" AND o.\"column\" = n.\"column\"")
def schema_diff(t):
    return schema.difference(a.columns(t, False), a.columns(t, True))


@query(f"WITH {a.MIGRATION_SQL} SELECT ordinal, kind, \"table\", object_name, after, category, severity FROM changes")
def schema_changes(t):
    return schema.changes(a.migration(t)).drop("statement", "action")


@query(f"WITH {a.COLUMNS_SQL}, {a.MIGRATION_SQL}, f AS (SELECT * FROM changes WHERE object_name IS NOT NULL) SELECT coalesce(o.\"table\", f.\"table\") AS \"table\", coalesce(o.\"column\", f.object_name) AS \"column\", CASE WHEN f.kind IN ('ADD_COLUMN', 'ALTER_COLUMN_TYPE') THEN f.after ELSE o.data_type END AS data_type, CASE WHEN f.kind = 'ALTER_NULLABILITY' THEN false ELSE coalesce(o.nullable, true) END AS nullable FROM old_columns o FULL JOIN f ON o.\"table\" = f.\"table\" AND o.\"column\" = f.object_name WHERE coalesce(f.kind, '') <> 'DROP_COLUMN' AND (o.data_type IS NOT NULL OR f.kind = 'ADD_COLUMN')")
def schema_evolution(t):
    return schema.evolve(a.columns(t, False), schema.changes(a.migration(t)))


@query(f"""WITH RECURSIVE {a.COLUMNS_SQL}, {a.SEQUENCES_SQL},
cols AS (SELECT "table", "column" FROM old_columns UNION SELECT "table", object_name FROM seq WHERE kind = 'ADD_COLUMN'),
ev AS (SELECT c."table", c."column", s.kind, s.after, row_number() OVER (PARTITION BY c."table", c."column" ORDER BY s.ordinal) AS i FROM cols c JOIN seq s ON s."table" = c."table" AND (s.object_name = c."column" OR s.kind IN ('DROP_TABLE', 'ADD_TABLE'))),
fold AS (SELECT c."table", c."column", 0::BIGINT AS i, EXISTS (SELECT 1 FROM old_columns x WHERE x."table" = c."table") AS tbl, o.data_type IS NOT NULL AS there, o.data_type, o.nullable FROM cols c LEFT JOIN old_columns o ON o."table" = c."table" AND o."column" = c."column"
  UNION ALL SELECT f."table", f."column", e.i, CASE e.kind WHEN 'DROP_TABLE' THEN false WHEN 'ADD_TABLE' THEN true ELSE f.tbl END,
    CASE WHEN e.kind IN ('DROP_TABLE', 'DROP_COLUMN') THEN false WHEN e.kind = 'ADD_COLUMN' THEN f.tbl ELSE f.there END,
    CASE WHEN e.kind IN ('ADD_COLUMN', 'ALTER_COLUMN_TYPE') THEN e.after ELSE f.data_type END,
    CASE WHEN e.kind = 'ADD_COLUMN' THEN true WHEN e.kind = 'ALTER_NULLABILITY' THEN false ELSE f.nullable END
  FROM fold f JOIN ev e ON e."table" = f."table" AND e."column" = f."column" AND e.i = f.i + 1)
SELECT "table", "column", data_type, nullable FROM fold QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY i DESC) = 1 AND tbl AND there""")
def schema_evolution_sequence(t):
    return schema.evolve(a.columns(t, False), a.change_sequences(t))


@query(f"WITH {a.MIGRATION_SQL} SELECT \"table\", ordinal, kind FROM (SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY CASE category WHEN 'DESTRUCTIVE' THEN 5 WHEN 'DATA_DEPENDENT' THEN 4 WHEN 'ADDITIVE' THEN 2 WHEN 'UNSUPPORTED' THEN 1 ELSE 0 END DESC, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, ordinal) AS r FROM changes) WHERE r = 1")
def primary_change(t):
    return schema.primary(schema.changes(a.migration(t)), ["table"]).select("table", "ordinal", "kind")


@query(f"WITH {a.MIGRATION_SQL} SELECT ordinal, CASE WHEN category = 'DESTRUCTIVE' THEN 'UNSAFE' WHEN category = 'DATA_DEPENDENT' THEN CASE WHEN ordinal % 4 = 0 THEN 'UNSAFE' ELSE 'COMPATIBLE' END WHEN category = 'ADDITIVE' THEN 'SAFE' ELSE 'UNKNOWN' END AS status, CASE kind WHEN 'DROP_COLUMN' THEN CASE WHEN ordinal % 4 = 0 THEN 'drop_column_active_dependency' ELSE 'drop_column_no_dependency' END WHEN 'DROP_TABLE' THEN CASE WHEN ordinal % 4 = 0 THEN 'drop_table_active_dependency' ELSE 'drop_table_no_dependency' END WHEN 'ALTER_NULLABILITY' THEN 'not_null_data_dependent' WHEN 'ALTER_COLUMN_TYPE' THEN 'type_narrowing_data_dependent' WHEN 'ADD_COLUMN' THEN 'additive_safe_change' ELSE 'unsupported_change' END AS explanation FROM changes")
def deployment_status(t):
    used = F.col("ordinal") % 4 == 0
    return schema.changes(a.migration(t)).select("ordinal", schema.deployment_status(F.col("category"), used).alias("status"), schema.explanation_key(F.col("kind"), used).alias("explanation"))


def _symbols(t, new):
    return t.part.filter(F.col("p_partkey") % 10 != (1 if new else 0)).select(F.concat("p_brand", F.lit(".py")).alias("file"), F.lit("FUNCTION").alias("kind"), F.col("p_name").alias("name"))


_SYMBOLS = "old AS (SELECT DISTINCT p_brand || '.py' AS file, 'FUNCTION' AS kind, p_name AS name FROM part WHERE p_partkey % 10 <> 0), new AS (SELECT DISTINCT p_brand || '.py' AS file, 'FUNCTION' AS kind, p_name AS name FROM part WHERE p_partkey % 10 <> 1)"


@query(f"WITH {_SYMBOLS} SELECT * FROM old EXCEPT SELECT * FROM new")
def symbols_removed(t):
    return snapshots.symbols_missing(_symbols(t, False).distinct(), _symbols(t, True))


@query(f"WITH {_SYMBOLS} SELECT * FROM new EXCEPT SELECT * FROM old")
def symbols_added(t):
    return snapshots.symbols_missing(_symbols(t, True).distinct(), _symbols(t, False))


@query(f"WITH {a.OPERATIONS_SQL} SELECT path, method, 'API-ENDPOINT-REMOVED' AS rule_id, 'endpoint' AS location, 'BREAKING' AS compatibility FROM old_ops WHERE key NOT IN (SELECT key FROM new_ops) UNION ALL SELECT path, method, 'API-ENDPOINT-ADDED', 'endpoint', 'SAFE' FROM new_ops WHERE key NOT IN (SELECT key FROM old_ops)")
def endpoint_diff(t):
    return contract.endpoints(a.operations(t, False), a.operations(t, True))


@query(f"WITH {a.OPERATIONS_SQL} SELECT o.path, o.method, 'API-SECURITY-REQUIRED' AS rule_id, 'security' AS location, 'CAUTION' AS compatibility FROM old_ops o JOIN new_ops n ON o.key = n.key WHERE len(o.scopes) = 0 AND len(n.scopes_new) > 0")
def security_diff(t):
    return contract.security(a.operations(t, False), a.operations(t, True))


_PARAMS = f"""WITH {a.PARAMETERS_SQL}, b AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.method, n.method) AS method, coalesce(o.name, n.name) AS name, o.location AS ol, n.location AS nl, o.required AS oreq, n.required AS nreq FROM old_params o FULL JOIN new_params n ON o.path = n.path AND o.name = n.name),
out AS (SELECT path, method, 'API-PARAM-REMOVED' AS rule_id, 'parameters.' || name AS location, 'BREAKING' AS compatibility FROM b WHERE nl IS NULL
UNION ALL SELECT path, method, 'API-REQUIRED-ADDED', 'parameters.' || name, 'BREAKING' FROM b WHERE nl IS NOT NULL AND nreq AND NOT coalesce(oreq, false)
UNION ALL SELECT path, method, 'API-PARAM-LOCATION-CHANGED', 'parameters.' || name, 'CAUTION' FROM b WHERE ol <> nl)"""


@query(_PARAMS + " SELECT * FROM out")
def param_diff(t):
    return contract.parameters(a.parameters(t, False), a.parameters(t, True))


@query(_PARAMS + " SELECT CASE max(CASE compatibility WHEN 'BREAKING' THEN 3 WHEN 'CAUTION' THEN 1 ELSE 0 END) WHEN 3 THEN 'BREAKING' WHEN 1 THEN 'CAUTION' ELSE 'SAFE' END AS status, count(*) AS n_changes FROM out")
def api_status(t):
    return contract.status(param_diff(t))


@query("WITH b AS (SELECT '/s/' || (o_orderkey // 5) AS path, 'GET' AS method, CAST(200 + o_orderkey % 5 AS VARCHAR) AS status, o_orderkey AS k FROM orders) SELECT path, method, 'API-RESPONSE-REMOVED' AS rule_id, 'responses.' || status AS location, 'BREAKING' AS compatibility FROM b WHERE k % 10 = 1 UNION ALL SELECT path, method, 'API-RESPONSE-ADDED', 'responses.' || status, 'SAFE' FROM b WHERE k % 10 = 0")
def response_diff(t):
    key = F.col("o_orderkey")
    rows = t.orders.select(F.concat(F.lit("/s/"), F.floor(key / 5).cast("string")).alias("path"), F.lit("GET").alias("method"), (200 + key % 5).cast("string").alias("status"), key.alias("k"))
    return contract.responses(rows.filter("k % 10 <> 0").drop("k"), rows.filter("k % 10 <> 1").drop("k"))


@query(f"""WITH {a.NODES_SQL}, r AS (
SELECT *, 'API-PROPERTY-REMOVED' AS rule_id, CASE WHEN direction = 'RESPONSE' THEN 'BREAKING' ELSE 'CAUTION' END AS compatibility FROM joined WHERE nt IS NULL
UNION ALL SELECT *, 'API-REQUIRED-ADDED', 'BREAKING' FROM joined WHERE ot IS NULL AND nreq
UNION ALL SELECT j.* REPLACE ('required.' || location AS location), 'API-REQUIRED-ADDED', 'BREAKING' FROM joined j WHERE nreq AND NOT coalesce(oreq, false) AND EXISTS (SELECT 1 FROM old_nodes o WHERE o.path = j.path AND o.method = j.method AND o.direction = j.direction AND o.required)
UNION ALL SELECT *, 'API-TYPE-NARROWED', 'BREAKING' FROM joined WHERE ot <> nt
UNION ALL SELECT *, 'API-ENUM-VALUE-REMOVED', 'BREAKING' FROM joined WHERE ov > 0 AND nv > 0 AND ov > nv
UNION ALL SELECT *, 'API-ENUM-CONSTRAINT-ADDED', 'BREAKING' FROM joined WHERE ov = 0 AND nv > 0)
SELECT path, method, rule_id, direction || '.' || location AS location, compatibility FROM r""")
def schema_node_diff(t):
    return contract.schema_nodes(a.nodes(t, False), a.nodes(t, True))


@query(f"""WITH RECURSIVE {a.TREES_SQL}, r AS (
SELECT *, 'API-PROPERTY-REMOVED' AS rule_id, CASE WHEN direction = 'RESPONSE' THEN 'BREAKING' ELSE 'CAUTION' END AS compatibility, names AS spot FROM walk WHERE nt IS NULL AND names[-1] <> '[]'
UNION ALL SELECT *, 'API-REQUIRED-ADDED', 'BREAKING', names FROM walk WHERE ot IS NULL AND nreq AND names[-1] <> '[]'
UNION ALL SELECT *, 'API-REQUIRED-ADDED', 'BREAKING', list_concat(names[:-2], ['required', names[-1]]) FROM walk w WHERE nreq AND NOT coalesce(oreq, false) AND EXISTS (SELECT 1 FROM old_t o WHERE o.path = w.path AND o.direction = w.direction AND len(o.names) = len(w.names) AND o.names[:-2] = w.names[:-2] AND o.required)
UNION ALL SELECT *, 'API-TYPE-NARROWED', 'BREAKING', names FROM walk WHERE ot <> nt)
SELECT path, method, rule_id, direction || '.' || array_to_string(spot, '.') AS location, compatibility FROM r""")
def schema_tree_diff(t):
    return contract.schema_nodes(a.trees(t, False), a.trees(t, True))


_RB = f"""WITH {a.COLUMNS_SQL}, {a.DEPENDENCIES_SQL}, j AS (SELECT dependency, o.data_type AS ot, o.nullable AS oin, n.data_type AS nt, n.nullable AS nin FROM deps LEFT JOIN old_columns o ON dependency = o."table" || '.' || o."column" LEFT JOIN new_columns n ON dependency = n."table" || '.' || n."column"),
rb AS (SELECT dependency, CASE WHEN ot IS NOT NULL AND nt IS NULL THEN 'RB-SCHEMA-REMOVED-OLD-DEPENDENCY' WHEN ot <> nt THEN 'RB-SCHEMA-TYPE-CHANGED' WHEN ot IS NOT NULL AND oin AND NOT nin THEN 'RB-SCHEMA-NOT-NULL-OLD-DEPENDENCY' END AS rule_id FROM j),
out AS (SELECT dependency, rule_id, CASE WHEN rule_id LIKE '%REMOVED%' THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, CASE WHEN rule_id LIKE '%REMOVED%' THEN 'UNSAFE' ELSE 'CAUTION' END AS status FROM rb WHERE rule_id IS NOT NULL)"""


@query(_RB + " SELECT * FROM out")
def rollback_schema(t):
    return rollback.schema_dependencies(a.dependencies(t), a.columns(t, False), a.columns(t, True))


@query(_RB + " SELECT CASE WHEN bool_or(status = 'UNSAFE') THEN 'UNSAFE' WHEN count(*) > 0 THEN 'CAUTION' ELSE 'SAFE' END AS status, count(*) AS n_findings FROM out")
def rollback_status(t):
    return rollback.status(rollback_schema(t))


@query(f"""WITH {a.COLUMNS_SQL}, o AS (SELECT DISTINCT "table" FROM old_columns), n AS (SELECT DISTINCT "table" FROM new_columns WHERE "table" NOT IN ('t3', 't7'))
SELECT "table" AS dependency, 'RB-SCHEMA-REMOVED-OLD-DEPENDENCY' AS rule_id, 'CRITICAL' AS severity, 'UNSAFE' AS status FROM o WHERE "table" NOT IN (SELECT "table" FROM n)""")
def rollback_table_dependencies(t):
    tables = a.columns(t, False).select(F.col("table").alias("dependency")).distinct()
    return rollback.schema_dependencies(tables, a.columns(t, False), a.columns(t, True).filter(~F.col("table").isin("t3", "t7")))


@query("""WITH r AS (SELECT c_custkey AS request, c_custkey % 2 = 0 AS app, c_custkey % 3 <> 0 AS win, c_custkey % 5 <> 0 AS os, c_custkey % 7 <> 0 AS ns, c_custkey % 4 <> 0 AS oa, c_custkey % 9 <> 0 AS na, c_custkey % 6 = 0 AS dyn FROM customer)
SELECT request, dependency, rule_id, 'MEDIUM' AS severity, 'UNKNOWN' AS status FROM (
SELECT request, 'old_application' AS dependency, 'RB-MISSING-OLD-APPLICATION' AS rule_id FROM r WHERE NOT app
UNION ALL SELECT request, 'deployment_context', 'RB-ROLLBACK-WINDOW-UNKNOWN' FROM r WHERE NOT win
UNION ALL SELECT request, 'old_schema/new_schema', 'RB-MISSING-SCHEMA-SNAPSHOT' FROM r WHERE NOT (os AND ns)
UNION ALL SELECT request, 'old_api/new_api', 'RB-MISSING-API-SNAPSHOT' FROM r WHERE NOT (oa AND na)
UNION ALL SELECT request, 'old_application.dynamic_dependencies', 'RB-DYNAMIC-DEPENDENCY' FROM r WHERE app AND dyn)""")
def rollback_missing_evidence(t):
    key = F.col("c_custkey")
    flags = {"old_application": key % 2 == 0, "deployment_context": key % 3 != 0, "old_schema": key % 5 != 0, "new_schema": key % 7 != 0, "old_api": key % 4 != 0, "new_api": key % 9 != 0}
    names = F.when(key % 6 == 0, F.array(F.lit("getattr"))).otherwise(F.array().cast("array<string>"))
    return rollback.missing_evidence(t.customer.select(key.alias("request"), *[f.alias(n) for n, f in flags.items()], names.alias("dynamic_dependencies")), "request")


@query(f"WITH {a.OPERATIONS_SQL} SELECT method || ' ' || path AS dependency, 'RB-API-ENDPOINT-REMOVED' AS rule_id, 'CRITICAL' AS severity, 'UNSAFE' AS status FROM old_ops WHERE key % 2 = 1 AND key NOT IN (SELECT key FROM new_ops)")
def rollback_api(t):
    return rollback.api_dependencies(a.operations(t, False).filter("key % 2 = 1").select("path", "method"), a.operations(t, False), a.operations(t, True))


@query(f"WITH {a.COLUMNS_SQL}, {a.DEPENDENCIES_SQL} SELECT dependency, 'RB-FORWARD-MISSING-DEPENDENCY' AS rule_id, 'UNSAFE' AS status FROM deps WHERE dependency NOT IN (SELECT \"table\" || '.' || \"column\" FROM new_columns)")
def forward_missing(t):
    return rollback.forward_missing(a.dependencies(t), a.columns(t, True))


@query(f"WITH {a.MIGRATION_SQL}, {a.DEPENDENCIES_SQL} SELECT ordinal, concat_ws('.', \"table\", object_name) AS dependency, 'EXPAND_CONTRACT_VIOLATION' AS rule_id, 'UNSAFE' AS status FROM changes WHERE kind LIKE 'DROP%' AND concat_ws('.', \"table\", object_name) IN (SELECT dependency FROM deps)")
def expand_contract(t):
    return rollback.expand_contract(schema.changes(a.migration(t)), a.dependencies(t))


@query(_RB + ", src AS (SELECT CASE WHEN p_partkey = 5 THEN '' ELSE 't' || (p_partkey % 50) || '.c' || p_partkey END AS entity, p_brand || '.py' AS source_file, p_size AS line FROM part) SELECT dependency, rule_id, source_file, line FROM out JOIN src ON entity = dependency UNION ALL SELECT NULL, NULL, source_file, line FROM src WHERE entity = ''")
def provenance_lookup(t):
    key = F.col("p_partkey")
    sources = t.part.select(F.when(key == 5, "").otherwise(F.concat(F.lit("t"), (key % 50).cast("string"), F.lit(".c"), key.cast("string"))).alias("entity"), F.concat("p_brand", F.lit(".py")).alias("source_file"), F.col("p_size").alias("line"))
    return rollback.provenance(rollback_schema(t), sources)


@query(f"WITH {a.FINDINGS_SQL} SELECT * FROM feats")
def risk_features(t):
    return decision.features(a.findings(t), ["scope"])


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, base_risk, multiplier, risk FROM risked")
def final_risk(t):
    return decision.risk(decision.features(a.findings(t), ["scope"])).select("scope", "base_risk", "multiplier", "risk")


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, risk, rules, verdict FROM decided")
def policy_verdict(t):
    return decision.decide(a.findings(t), ["scope"]).select("scope", "risk", "rules", "verdict")


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, 'COMPOUND-API-SCHEMA' AS compound, 1.08::DOUBLE AS multiplier FROM feats WHERE api_blocking AND db UNION ALL SELECT scope, 'COMPOUND-BLAST-ROLLBACK', 1.1::DOUBLE FROM feats WHERE blast_critical AND rollback_blocking UNION ALL SELECT scope, 'COMPOUND-ROLLBACK-SCHEMA', 1.12::DOUBLE FROM feats WHERE db_blocking AND removed_dependency")
def compound_risks(t):
    return decision.compound_risks(decision.features(a.findings(t), ["scope"]), ["scope"])


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, rule_id AS source, 'feature:' || lower(category) AS target, 'contributes_to' AS relation, severity AS value FROM findings UNION ALL SELECT scope, 'risk_features', 'base_risk', 'formula', base_risk::VARCHAR FROM decided UNION ALL SELECT scope, 'COMPOUND-API-SCHEMA', 'compound_adjustment', 'multiplier', '1.08' FROM feats WHERE api_blocking AND db UNION ALL SELECT scope, 'COMPOUND-BLAST-ROLLBACK', 'compound_adjustment', 'multiplier', '1.1' FROM feats WHERE blast_critical AND rollback_blocking UNION ALL SELECT scope, 'COMPOUND-ROLLBACK-SCHEMA', 'compound_adjustment', 'multiplier', '1.12' FROM feats WHERE db_blocking AND removed_dependency UNION ALL SELECT scope, 'policy', 'verdict', 'selected', verdict FROM decided")
def evidence_chain(t):
    found = a.findings(t)
    return decision.evidence_chain(found, decision.decide(found, ["scope"]), ["scope"])


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, finding_id, severity, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY severity DESC, finding_id DESC) AS place FROM findings) WHERE place <= 5")
def top_findings(t):
    return decision.top_findings(a.findings(t), ["scope"]).select("scope", "finding_id", "severity", "place")


@query(f"WITH {a.FINDINGS_SQL}, d AS (SELECT * FROM findings WHERE rule_id IN ('DROP_COLUMN', 'DROP_TABLE')) SELECT finding_id || ':expand' AS step_id, CASE WHEN severity IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN severity ELSE 'LOW' END AS priority FROM d UNION ALL SELECT finding_id || ':verify', 'HIGH' FROM d")
def remediation_steps(t):
    return decision.remediation(a.findings(t))


@query(f"WITH {a.FINDINGS_SQL} SELECT category, rule_id, count(*) AS n, count(DISTINCT entity) AS entities FROM findings GROUP BY category, rule_id")
def findings_by_rule(t):
    return a.findings(t).groupBy("category", "rule_id").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(password\\s*=\\s*[''\"][^''\"]+[''\"])', '<redacted>', 'gi'), '(api[_-]?key\\s*=\\s*[''\"][^''\"]+[''\"])', '<redacted>', 'gi'), '(token\\s*=\\s*[''\"][^''\"]+[''\"])', '<redacted>', 'gi'), '(secret\\s*=\\s*[''\"][^''\"]+[''\"])', '<redacted>', 'gi'), '([''\"](?:password|token|secret|api_key|api-key)[''\"]\\s*:\\s*[''\"][^''\"]+[''\"])', '<redacted>', 'gi')) AS redacted_sha256 FROM documents")
def redact_sql(t):
    return t.documents.select("doc_id", F.sha2(text.redact_sql(F.col("text")), 256).alias("redacted_sha256"))


@query("SELECT doc_id, sha256(regexp_replace(text, '((?:api[_-]?key|secret|password|token|authorization|credential)=)[^&\\s]+', '\\1<redacted>', 'gi')) AS redacted_sha256 FROM documents")
def redact_url(t):
    return t.documents.select("doc_id", F.sha2(text.redact_url(F.col("text")), 256).alias("redacted_sha256"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '(bearer\\s+[A-Za-z0-9._~+/=-]+|AKIA[0-9A-Z]{16}|eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9._-]+\\.[A-Za-z0-9._-]+)', '[REDACTED]', 'gi'), '\\b(?:postgres|mysql|mongodb(?:\\+srv)?|redis)://[^\\s]+', '[REDACTED]', 'gi')) AS redacted_sha256 FROM documents")
def redact_tokens(t):
    return t.documents.select("doc_id", F.sha2(text.redact_tokens(F.col("text")), 256).alias("redacted_sha256"))


_SERVICE = "nullif(split_part(regexp_extract(url, '^https?://([^/]*)', 1), ':', 1), '')"


@query(f"SELECT page_id, {_SERVICE} AS service FROM pages")
def service_from_url(t):
    return t.pages.select("page_id", text.service_of(F.col("url")).alias("service"))


@query(f"SELECT page_id, array_to_string(list_transform(list_filter(regexp_split_to_array({_SERVICE}, '[-_.\\s]+'), lambda w: w <> ''), lambda w: CASE WHEN lower(w) IN ('api', 'db', 'id', 'url', 'http', 'https', 'sql', 'ui', 'io', 'rpc') THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), '') AS class_name FROM pages")
def api_class_name(t):
    return t.pages.select("page_id", text.class_name(text.service_of(F.col("url"))).alias("class_name"))


_ROUTE = "WITH r AS (SELECT page_id, coalesce(" + _SERVICE + ", '') AS service, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[0-9]+', '{id}', 'g'), '^https?://[^/]*', ''), '/+$', '') AS x FROM pages), routes AS (SELECT page_id, service, CASE WHEN x = '' THEN '/' ELSE x END AS route FROM r)"


@query(_ROUTE + " SELECT page_id, service, route FROM routes")
def route_normalize(t):
    return a.routes(t)


@query(_ROUTE + ", providers AS (SELECT DISTINCT service, route FROM routes WHERE page_id % 2 = 1) SELECT page_id, count(p.service) AS n_providers, CASE WHEN count(p.service) = 1 THEN 'MATCHED' WHEN count(p.service) = 0 THEN 'UNRESOLVED' ELSE 'AMBIGUOUS' END AS state FROM routes c LEFT JOIN providers p ON c.route = p.route WHERE c.page_id % 2 = 0 GROUP BY page_id")
def route_match(t):
    callers, providers = a.calls(t)
    offers = providers.groupBy("route").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return callers.join(offers, "route", "left").select("page_id", n.alias("n_providers"), F.when(n == 1, "MATCHED").when(n == 0, "UNRESOLVED").otherwise("AMBIGUOUS").alias("state"))


@query("SELECT p_partkey, substr(sha256(concat_ws('|', p_brand, p_name)), 1, 16) AS stable_id, 'svc/' || replace(p_brand, '\\', '/') || '::FUNCTION::' || p_name AS symbol_id FROM part")
def stable_ids(t):
    return t.part.select("p_partkey", text.stable_id(F.col("p_brand"), F.col("p_name")).alias("stable_id"), text.symbol_id(F.lit("svc"), F.col("p_brand"), F.lit("FUNCTION"), F.col("p_name")).alias("symbol_id"))


@query(f"WITH {a.EDGES_SQL}, hashed AS (SELECT source, sha256(target || ':' || kind) AS h FROM edges), per AS (SELECT source, h[1:4] AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h FROM hashed GROUP BY source, h[1:4]) SELECT source, sha256(string_agg(h, ',' ORDER BY h)) AS edges_sha256 FROM per GROUP BY source")
def canonical_edge_hash(t):
    return graph.adjacency_digest(a.edges(t, repeats=True), a.parts(t), repeats=True)


@query("WITH refs AS (SELECT l_orderkey AS ref, l_linenumber AS n, l_partkey AS p FROM lineitem), i1 AS (SELECT s_suppkey AS k, count(*) AS c FROM supplier GROUP BY k), i2 AS (SELECT p_partkey AS k, count(*) AS c FROM part WHERE p_size < 25 GROUP BY k), i3 AS (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY k), j AS (SELECT ref, n, CASE WHEN i1.c IS NOT NULL THEN 1 WHEN i2.c IS NOT NULL THEN 2 WHEN i3.c IS NOT NULL THEN 3 ELSE 0 END AS level, coalesce(i1.c, i2.c, i3.c) AS hits FROM refs LEFT JOIN i1 ON i1.k = p LEFT JOIN i2 ON i2.k = p LEFT JOIN i3 ON i3.k = p % 40) SELECT ref, n, level::INT AS level, CASE WHEN hits IS NULL THEN 'UNRESOLVED' WHEN hits = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state FROM j")
def resolve_references(t):
    refs = t.lineitem.select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    symbols = [t.supplier.select(F.col("s_suppkey").alias("key")), t.part.filter("p_size < 25").select(F.col("p_partkey").alias("key")), t.customer.select(F.col("c_nationkey").alias("key"))]
    keys = [F.col("p"), F.col("p"), F.col("p") % 40]
    return resolution.resolve(refs, list(zip(keys, symbols, strict=True))).drop("p")


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, 'risk:' || CASE category WHEN 'BLAST_RADIUS' THEN 'blast_severity' WHEN 'API_CONTRACT' THEN 'blast_severity' WHEN 'ROLLBACK' THEN 'rollback_unsafety' ELSE 'deployment_severity' END AS target, count(*) AS n_edges FROM findings GROUP BY ALL")
def evidence_edges(t):
    target = F.when(F.col("category").isin("BLAST_RADIUS", "API_CONTRACT"), "risk:blast_severity").when(F.col("category") == "ROLLBACK", "risk:rollback_unsafety").otherwise("risk:deployment_severity")
    return a.findings(t).groupBy("scope", target.alias("target")).agg(F.count("*").alias("n_edges"))


@query(f"WITH {a.FINDINGS_SQL}, alt AS (SELECT scope, bool_or(blocking AND rule_id <> 'DROP_COLUMN') AS b FROM findings GROUP BY scope) SELECT d.scope, d.verdict, alt.b AS still_blocking FROM decided d JOIN alt USING (scope)")
def counterfactual_compare(t):
    found = a.findings(t)
    other = found.groupBy("scope").agg(F.bool_or(F.col("blocking") & (F.col("rule_id") != "DROP_COLUMN")).alias("still_blocking"))
    return decision.decide(found, ["scope"]).select("scope", "verdict").join(other, "scope")


@query(f"WITH {a.EDGES_SQL}, w AS (SELECT source, target, round_even(CASE max(kind) {' '.join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in graph.WEIGHTS.items())} ELSE 0.5::DOUBLE END, 6) AS severity FROM parallel GROUP BY source, target) SELECT *, CASE WHEN severity >= 0.9 THEN 'CRITICAL' WHEN severity >= 0.7 THEN 'HIGH' WHEN severity >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM w")
def impact_score(t):
    return graph.scored_edges(a.edges(t, parallel=True, repeats=True), a.parts(t))


@query(f"WITH {a.EDGES_SQL}, {_REACH.format(o="unnest(['supplier:0', 'supplier:1', 'customer:1'])", e='edges')} SELECT node, hop FROM seen")
def graph_context(t):
    return graph.reachable(a.edges(t, repeats=True), a.origins(t, "supplier:0", "supplier:1", "customer:1"), 3)


@query(f"WITH {a.FILES_SQL}, f AS (SELECT regexp_replace(path, '^docs/n([0-9]+)[.]md$', 'docs/n\\1/schema.sql') AS path FROM new_files WHERE NOT starts_with(path, 'node_modules/')), s AS (SELECT min(path) AS schema_path FROM f WHERE path LIKE '%/schema.sql') SELECT schema_path, (SELECT max(path) FROM f WHERE path LIKE '%/migration/%.sql') AS migration_path FROM s")
def pick_schema_file(t):
    files = a.files(t, True).select(F.regexp_replace("path", r"^docs/n([0-9]+)[.]md$", "docs/n$1/schema.sql").alias("path"))
    return snapshots.pick_files(files)


@query("SELECT p_partkey, t.table, t.column, t.operation FROM (SELECT p_partkey, unnest(CASE p_partkey % 5 WHEN 0 THEN [{'table': 't' || p_partkey, 'column': 'id', 'operation': 'SELECT'}, {'table': 't' || p_partkey, 'column': 'c' || p_partkey, 'operation': 'SELECT'}] WHEN 4 THEN [] ELSE [{'table': 't' || p_partkey, 'column': 'unknown', 'operation': ['UPDATE', 'INSERT', 'DELETE'][p_partkey % 5]}] END) AS t FROM part)")
def sql_literal_access(t):
    return resolution.sql_accesses(a.literals(t))


@query(f"WITH {a.MIGRATION_SQL}, {a.DEPENDENCIES_SQL}, c AS (SELECT *, concat_ws('.', \"table\", object_name) IN (SELECT dependency FROM deps) AS used FROM changes) SELECT ordinal, CASE kind WHEN 'DROP_COLUMN' THEN 'drop_column_' || CASE WHEN used THEN 'active_dependency' ELSE 'no_dependency' END WHEN 'DROP_TABLE' THEN 'drop_table_' || CASE WHEN used THEN 'active_dependency' ELSE 'no_dependency' END WHEN 'ALTER_NULLABILITY' THEN 'not_null_data_dependent' WHEN 'ALTER_COLUMN_TYPE' THEN 'type_narrowing_data_dependent' WHEN 'ADD_COLUMN' THEN 'additive_safe_change' ELSE 'unsupported_change' END AS explanation_key FROM c")
def explanation_key(t):
    used = a.dependencies(t).distinct().withColumn("used", F.lit(True))
    changes = schema.changes(a.migration(t)).withColumn("dependency", F.concat_ws(".", "table", "object_name")).join(used, "dependency", "left")
    return changes.select("ordinal", schema.explanation_key(F.col("kind"), F.coalesce("used", F.lit(False))).alias("explanation_key"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_sha256(t):
    return t.documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("SELECT doc_id, sha256(regexp_replace(text, '\\b(?:postgres|mysql|mongodb(?:\\+srv)?|redis)://[^\\s]+', '[REDACTED]', 'gi')) AS redacted_sha256 FROM documents")
def redact_connection(t):
    return t.documents.select("doc_id", F.sha2(text.redact_connection(F.col("text")), 256).alias("redacted_sha256"))


@query(_RB + f""", {a.MIGRATION_SQL}, {a.OPERATIONS_SQL},
judged AS (SELECT *, CASE category WHEN 'DESTRUCTIVE' THEN 'UNSAFE' WHEN 'ADDITIVE' THEN 'SAFE' WHEN 'UNSUPPORTED' THEN 'UNKNOWN' ELSE CASE WHEN ordinal % 4 = 0 THEN 'UNSAFE' ELSE 'COMPATIBLE' END END AS status, concat_ws('.', "table", object_name) AS o,
  row_number() OVER (PARTITION BY "table" ORDER BY CASE category WHEN 'DESTRUCTIVE' THEN 5 WHEN 'DATA_DEPENDENT' THEN 4 WHEN 'ADDITIVE' THEN 2 WHEN 'UNSUPPORTED' THEN 1 ELSE 0 END DESC, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, ordinal) AS r FROM changes),
api AS (SELECT *, 'API-ENDPOINT-REMOVED' AS rule_id, 'HIGH' AS severity, true AS blocking FROM old_ops WHERE key NOT IN (SELECT key FROM new_ops) UNION ALL SELECT *, 'API-ENDPOINT-ADDED', 'LOW', false FROM new_ops WHERE key NOT IN (SELECT key FROM old_ops))
SELECT sha256(o || '|' || kind)[1:16] AS finding_id, 'DATABASE' AS category, kind AS rule_id, severity, CASE WHEN status = 'UNKNOWN' THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS confidence, status = 'UNSAFE' AS blocking, CASE WHEN status = 'UNKNOWN' THEN 'deployment status is unknown' END AS uncertainty, nullif(o, 'UNKNOWN') AS entity FROM judged WHERE r = 1
UNION ALL SELECT 'api:' || rule_id || ':' || (row_number() OVER (ORDER BY path, method, rule_id) - 1), 'API_CONTRACT', rule_id, severity, 1, blocking, NULL, method || ' ' || path FROM api
UNION ALL SELECT 'rollback:' || rule_id || ':' || dependency, 'ROLLBACK', rule_id, severity, 1, status = 'UNSAFE', NULL, dependency FROM out""")
def findings_union(t):
    """Findings of the primary schema change of each table, of contract changes and of rollback in one table."""
    changes = schema.changes(a.migration(t)).withColumn("status", schema.deployment_status(F.col("category"), F.col("ordinal") % 4 == 0))
    return decision.from_schema(schema.primary(changes, ["table"])).unionByName(decision.from_contract(endpoint_diff(t))).unionByName(decision.from_rollback(rollback_schema(t)))


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, finding_id, (row_number() OVER (PARTITION BY scope, category ORDER BY finding_id) - 1)::INT AS place FROM findings")
def finding_positions(t):
    return decision.positions(a.findings(t), ["scope", "category"]).select("scope", "finding_id", "place")


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, finding_id, rule_id FROM findings WHERE uncertainty IS NOT NULL OR confidence = 0")
def unknowns(t):
    return decision.unknowns(a.findings(t)).select("scope", "finding_id", "rule_id")


@query(f"WITH {a.FINDINGS_SQL} SELECT DISTINCT scope, entity FROM findings")
def affected_entities(t):
    return a.findings(t).select("scope", "entity").distinct()


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, base_risk FROM risked")
def base_risk(t):
    return decision.risk(decision.features(a.findings(t), ["scope"])).select("scope", "base_risk")


_EVIDENCE = f"WITH {a.FINDINGS_SQL}, rules AS (SELECT *, unnest(string_split(rules, ',')) AS rule FROM decided), weighed AS (SELECT *, unnest(['blast_severity', 'deployment_severity', 'rollback_unsafety']) AS f, unnest([blast_severity, deployment_severity, rollback_unsafety]) AS value FROM rules)"


@query(_EVIDENCE + """ SELECT DISTINCT scope, 'entity:' || entity AS node_id, 'SOURCE_SYMBOL' AS kind, entity AS label, 0 AS layer FROM findings
UNION ALL SELECT scope, 'finding:' || finding_id, 'FINDING', rule_id, 90 FROM findings
UNION ALL SELECT scope, 'risk:' || f, 'RISK_FEATURE', f, 91 FROM (SELECT scope, unnest(['blast_severity', 'deployment_severity', 'rollback_unsafety']) AS f FROM decided)
UNION ALL SELECT scope, 'policy:' || rule, 'POLICY_RULE', rule, 92 FROM rules
UNION ALL SELECT scope, 'verdict', 'VERDICT', verdict, 93 FROM decided""")
def evidence_nodes(t):
    found = a.findings(t)
    return evidence.nodes(found, decision.decide(found, ["scope"]), ["scope"])


@query(_EVIDENCE + """ SELECT scope, 'entity:' || entity AS source, 'finding:' || finding_id AS target, 'PRODUCES' AS kind FROM findings
UNION ALL SELECT scope, 'finding:' || finding_id, 'risk:' || CASE category WHEN 'BLAST_RADIUS' THEN 'blast_severity' WHEN 'API_CONTRACT' THEN 'blast_severity' WHEN 'ROLLBACK' THEN 'rollback_unsafety' ELSE 'deployment_severity' END, 'CONTRIBUTES_TO' FROM findings
UNION ALL SELECT scope, 'risk:' || f, 'policy:' || rule, 'TRIGGERS' FROM weighed WHERE value > 0
UNION ALL SELECT scope, 'policy:' || rule, 'verdict', 'DETERMINES' FROM rules""")
def evidence_graph_edges(t):
    found = a.findings(t)
    return evidence.edges(found, decision.decide(found, ["scope"]), ["scope"])


@query(f"WITH {a.FINDINGS_SQL} SELECT DISTINCT 'f:' || l_orderkey AS evidence_id FROM lineitem WHERE 'f:' || l_orderkey NOT IN (SELECT finding_id FROM findings)")
def explanation_claims(t):
    """Claims that no finding bears out."""
    return evidence.ungrounded(t.lineitem.select(F.concat(F.lit("f:"), F.col("l_orderkey").cast("string")).alias("evidence_id")).distinct(), a.findings(t))


@query(f"WITH {a.ROUTES_SQL} SELECT method, host, route, n_candidates, CASE WHEN n_candidates = 1 THEN e END AS entity, CASE n_candidates WHEN 1 THEN 'MATCHED' WHEN 0 THEN 'UNRESOLVED' ELSE 'AMBIGUOUS' END AS state FROM matched")
def route_registry_match(t):
    return resolution.match_routes(*a.route_calls(t))


@query(f"WITH {a.ROUTES_SQL} SELECT method, host, route, n_candidates FROM matched WHERE n_candidates > 1")
def route_ambiguous(t):
    return resolution.match_routes(*a.route_calls(t)).filter("state = 'AMBIGUOUS'").select("method", "host", "route", "n_candidates")


_REGISTRY = "registry AS (SELECT path, method, 'svc.E' || (key % 7) AS entity, key AS ordinal FROM old_ops UNION ALL SELECT path, method, 'svc.F' || (key % 3), key + 1000000000 FROM old_ops WHERE key % 4 = 0)"


@query(f"WITH {a.OPERATIONS_SQL}, {_REGISTRY}, last AS (SELECT path, method, arg_max(entity, ordinal) AS entity FROM registry GROUP BY ALL) SELECT DISTINCT entity FROM last JOIN old_ops USING (path, method) WHERE key NOT IN (SELECT key FROM new_ops)")
def breaking_route_entities(t):
    old, key = a.operations(t, False), F.col("key")
    first = old.select("path", "method", F.concat(F.lit("svc.E"), (key % 7).cast("string")).alias("entity"), key.alias("ordinal"))
    second = old.filter("key % 4 = 0").select("path", "method", F.concat(F.lit("svc.F"), (key % 3).cast("string")).alias("entity"), (key + 1000000000).alias("ordinal"))
    return resolution.breaking_entities(endpoint_diff(t), first.unionByName(second))


@query(f"WITH {a.EDGES_SQL} SELECT DISTINCT 'SCHEMA' AS family, source AS dependency FROM edges WHERE kind = 'DB_READ' UNION ALL SELECT DISTINCT 'API', CASE WHEN CAST(split_part(source, ':', 2) AS BIGINT) % 2 = 1 THEN 'GET /nations/' || split_part(source, ':', 2) ELSE source END FROM edges WHERE kind = 'API_CONSUMES'")
def application_snapshot(t):
    key = F.col("n_nationkey")
    registry = t.nation.filter(key % 2 == 1).select(a.node("nation", "n_nationkey").alias("entity"), F.lit("GET").alias("method"), F.concat(F.lit("/nations/"), key.cast("string")).alias("path"), key.alias("ordinal"))
    return resolution.application_dependencies(a.edges(t), registry)


@query("WITH c AS (SELECT p_brand || '.py' AS file, CASE p_partkey % 4 WHEN 0 THEN 'Row' WHEN 1 THEN 'Order' || p_partkey || 'Service' WHEN 2 THEN 'ClientOf' || p_partkey ELSE 'Model' || p_partkey END AS name, p_partkey AS start FROM part), s AS (SELECT *, CASE WHEN regexp_matches(lower(name), 'client|service') THEN 3 ELSE 0 END + CASE WHEN name LIKE '%Service' THEN 2 ELSE 0 END - CASE WHEN name = 'Row' THEN 5 ELSE 0 END AS score FROM c) SELECT file, name FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, start DESC) AS r FROM s) WHERE r = 1")
def primary_classes(t):
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, "Row").when(key % 4 == 1, F.concat(F.lit("Order"), key.cast("string"), F.lit("Service"))).when(key % 4 == 2, F.concat(F.lit("ClientOf"), key.cast("string"))).otherwise(F.concat(F.lit("Model"), key.cast("string")))
    return resolution.primary_classes(t.part.select(F.concat("p_brand", F.lit(".py")).alias("file"), name.alias("name"), key.alias("start")))


@query(f"WITH {a.NODES_SQL} SELECT 'POST ' || replace(path, '#', '-') || '#' || location AS dependency, 'RB-API-FIELD-REMOVED' AS rule_id, 'HIGH' AS severity, 'UNSAFE' AS status FROM old_nodes o WHERE CAST(substr(location, 2) AS BIGINT) % 3 = 0 AND path IN (SELECT path FROM new_nodes) AND (path, location) NOT IN (SELECT (path, location) FROM new_nodes)")
def rollback_api_fields(t):
    old, new = (a.nodes(t, n).withColumn("path", F.replace("path", F.lit("#"), F.lit("-"))) for n in (False, True))
    deps = old.filter(F.substring("location", 2, 20).cast("long") % 3 == 0).select(F.concat("method", F.lit(" "), "path", F.lit("#"), "location").alias("dependency"))
    return rollback.api_fields(deps, old, new, new)


def _evidence(t):
    return t.lineitem.select(a.node("part", "l_partkey").alias("source"), a.node("supplier", "l_suppkey").alias("target"), F.lit("IMPORT").alias("kind"), F.concat("l_returnflag", F.lit(".py")).alias("source_file"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("matched_pattern"), F.col("l_quantity").cast("long").cast("string").alias("extracted_value"), F.col("l_orderkey").alias("ordinal"))


_ITEMS = "WITH m AS (SELECT 'part:' || l_partkey AS source, 'supplier:' || l_suppkey AS target, 'IMPORT' AS kind, l_returnflag || '.py' AS source_file, l_linenumber AS line, l_linestatus AS matched_pattern, l_quantity::BIGINT::VARCHAR AS extracted_value, max(l_orderkey) AS ordinal FROM lineitem GROUP BY ALL)"


@query(_ITEMS + " SELECT * FROM m")
def evidence_merge(t):
    return graph.merge_evidence(_evidence(t), "ordinal")


@query(_ITEMS + " SELECT source, target, kind, count(*) AS n_evidence FROM m GROUP BY ALL")
def evidence_count(t):
    return graph.evidence_count(evidence_merge(t))


@query("SELECT 'user:' || user_id AS entity, arg_max(event_type, event_id) AS kind, max(event_id) AS event_id FROM events GROUP BY user_id")
def entity_upsert(t):
    return graph.last_written(t.events.select(a.node("user", "user_id").alias("entity"), F.col("event_type").alias("kind"), "event_id"), ["entity"], "event_id")


@query("SELECT 'user:' || user_id AS entity, arg_min(event_type, event_id) AS kind, min(event_id) AS event_id FROM events GROUP BY user_id")
def entity_first_written(t):
    return graph.first_written(t.events.select(a.node("user", "user_id").alias("entity"), F.col("event_type").alias("kind"), "event_id"), ["entity"], "event_id")


@query(f"WITH RECURSIVE {a.EDGES_SQL}, up AS (SELECT target, min(source) AS parent FROM edges WHERE kind <> 'IMPORT' GROUP BY target), walk AS (SELECT 'part:' || p_partkey AS node, ['part:' || p_partkey] AS nodes FROM part UNION ALL SELECT node, list_prepend(parent, nodes) FROM walk JOIN up ON target = nodes[1] WHERE NOT list_contains(nodes, parent)) SELECT node, array_to_string(arg_max(nodes, len(nodes)), '>') AS path FROM walk GROUP BY node")
def causal_paths(t):
    kinds = tuple(k for k in graph.WEIGHTS if k != "IMPORT")
    return graph.causal_paths(a.edges(t, repeats=True), t.part.select(a.node("part", "p_partkey").alias("node")), kinds, a.parts(t))


@query(_blast_sql("SELECT 'region:0' AS origin", 3, 1000, "SELECT origin, 'blast:' || entity || ':' || (row_number() OVER (PARTITION BY origin ORDER BY severity DESC, hops, entity, string_split(path, '>')) - 1) AS finding_id, 'BLAST_RADIUS' AS category, level AS severity, 'BLAST-DOWNSTREAM-IMPACT' AS rule_id, entity FROM blast"))
def blast_findings(t):
    return decision.from_blast(blast_radius_region(t))


@query("WITH s AS (SELECT p_partkey, p_partkey % 3 AS nodes, p_partkey % 2 AS unsupported, p_partkey % 5 <> 0 AS has_migration, p_partkey % 7 = 0 AS migration_failed, p_partkey % 11 <> 0 AS has_target, p_partkey % 4 <> 0 AS has_contract, p_partkey % 13 = 0 AS contract_failed FROM part) SELECT p_partkey, unnest(['source', 'database', 'blast_radius', 'api_contract', 'rollback']) AS component, unnest([CASE WHEN nodes > 0 THEN 'ANALYZED' WHEN unsupported > 0 THEN 'UNSUPPORTED' ELSE 'UNAVAILABLE' END, CASE WHEN NOT has_migration THEN 'UNAVAILABLE' WHEN migration_failed THEN 'PARSE_ERROR' ELSE 'ANALYZED' END, CASE WHEN nodes = 0 THEN 'UNAVAILABLE' WHEN NOT has_target THEN 'NOT_APPLICABLE' ELSE 'ANALYZED' END, CASE WHEN contract_failed THEN 'PARSE_ERROR' WHEN NOT has_contract THEN 'UNAVAILABLE' ELSE 'ANALYZED' END, 'UNKNOWN']) AS status FROM s")
def capability_matrix(t):
    k = F.col("p_partkey")
    stats = t.part.select("p_partkey", (k % 3).alias("nodes"), (k % 2).alias("unsupported"), (k % 5 != 0).alias("has_migration"), (k % 7 == 0).alias("migration_failed"), (k % 11 != 0).alias("has_target"), (k % 4 != 0).alias("has_contract"), (k % 13 == 0).alias("contract_failed"), F.lit("UNKNOWN").alias("rollback"))
    return decision.capabilities(stats, ["p_partkey"])


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, unnest(['blast_severity', 'deployment_severity', 'rollback_unsafety']) AS feature, unnest([floor(100::DOUBLE * 0.4::DOUBLE * blast_severity + 0.5::DOUBLE)::BIGINT, floor(100::DOUBLE * 0.35::DOUBLE * deployment_severity + 0.5::DOUBLE)::BIGINT, floor(100::DOUBLE * 0.25::DOUBLE * rollback_unsafety + 0.5::DOUBLE)::BIGINT]) AS points FROM feats")
def risk_contributions(t):
    return decision.contributions(decision.features(a.findings(t), ["scope"]), ["scope"])


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, CASE category WHEN 'DATABASE' THEN 'primary' WHEN 'BLAST_RADIUS' THEN 'blast' WHEN 'ROLLBACK' THEN 'rollback' WHEN 'API_CONTRACT' THEN 'api' ELSE 'other' END AS report_group, count(*) AS n_findings, count(*) FILTER (blocking) AS n_blocking FROM findings GROUP BY ALL")
def report_groups(t):
    return decision.report_groups(a.findings(t), ["scope"])


@query(f"WITH {a.FINDINGS_SQL}, b AS (SELECT scope, finding_id, row_number() OVER (PARTITION BY scope ORDER BY category = 'ROLLBACK' DESC, category, rule_id, finding_id) AS r FROM findings WHERE blocking) SELECT DISTINCT f.scope, b.finding_id FROM findings f LEFT JOIN b ON f.scope = b.scope AND r = 1")
def root_cause(t):
    return decision.root_cause(a.findings(t), ["scope"])


@query(f"WITH {a.FINDINGS_SQL} SELECT DISTINCT scope, 'entity:' || entity AS node_id FROM findings WHERE (scope, entity) NOT IN (SELECT (scope, entity) FROM findings WHERE category <> 'ROLLBACK') UNION ALL SELECT scope, 'finding:' || finding_id FROM findings WHERE category = 'ROLLBACK'")
def evidence_delta(t):
    """Entities and findings that the graph has only with rollback analysis."""
    found, by = a.findings(t), ["scope"]
    less = found.filter("category <> 'ROLLBACK'")
    now, before = (evidence.nodes(f, decision.decide(f, by), by).filter("kind IN ('SOURCE_SYMBOL', 'FINDING')") for f in (found, less))
    return evidence.added_nodes(now, before, by).select("scope", "node_id")


@query(f"WITH {a.FINDINGS_SQL}, f AS (SELECT scope, 'risk:' || CASE category WHEN 'BLAST_RADIUS' THEN 'blast_severity' WHEN 'API_CONTRACT' THEN 'blast_severity' WHEN 'ROLLBACK' THEN 'rollback_unsafety' ELSE 'deployment_severity' END AS feature, finding_id, entity FROM findings) SELECT scope, feature, 'finding:' || finding_id AS node_id FROM f UNION ALL SELECT DISTINCT scope, feature, 'entity:' || entity FROM f")
def feature_lineage(t):
    return evidence.lineage(evidence_graph_edges(t), ["scope"])


_SHOWN = "SELECT page_id, CASE WHEN url LIKE '%://%' THEN '[REDACTED]' ELSE url END AS url, '[REDACTED]' AS api_key, CASE WHEN page_id % 3 = 0 THEN '[REDACTED]' ELSE 'plain' END AS note"


@query(_SHOWN + " FROM pages")
def redact_evidence(t):
    items = F.create_map(F.lit("url"), F.col("url"), F.lit("API-Key"), F.lit("x"), F.lit("note"), F.when(F.col("page_id") % 3 == 0, "Bearer abc").otherwise("plain"))
    return t.pages.select("page_id", text.redact_evidence(items).alias("m")).select("page_id", F.col("m")["url"].alias("url"), F.col("m")["API-Key"].alias("api_key"), F.col("m")["note"].alias("note"))


@query("SELECT event_id, CASE event_id % 97 WHEN 0 THEN '../x' WHEN 1 THEN '/abs' ELSE 'C:\\x' END AS name FROM events WHERE event_id % 97 < 3")
def unsafe_paths(t):
    key = F.col("event_id")
    name = F.when(key % 97 == 0, "../x").when(key % 97 == 1, "/abs").when(key % 97 == 2, "C:\\x").otherwise(F.concat(F.lit("ok/f"), key.cast("string")))
    return t.events.select("event_id", name.alias("name")).filter(snapshots.unsafe(F.col("name")))


@query(f"""WITH {a.EXTRACTION_SQL}, files AS (SELECT DISTINCT file, CASE WHEN file LIKE '%1.py' THEN 'kotlin' ELSE 'python' END AS language FROM declared)
SELECT language, count(*) AS n_files, sum((SELECT count(*) FROM declared d WHERE d.file = f.file))::BIGINT AS n_symbols, sum((SELECT count(*) FROM referred r WHERE r.file = f.file))::BIGINT AS n_references,
  sum((SELECT count(*) FROM referred r WHERE r.file = f.file AND status IN ('EXACT', 'IMPORTED', 'QUALIFIED', 'PROJECT_UNIQUE')))::BIGINT AS n_resolved, sum((SELECT count(*) FROM referred r WHERE r.file = f.file AND status = 'UNRESOLVED'))::BIGINT AS n_unresolved FROM files f GROUP BY language""")
def extraction_counts(t):
    symbols = a.declared(t)
    files = symbols.select("file").distinct().select("file", F.when(F.col("file").endswith("1.py"), "kotlin").otherwise("python").alias("language"))
    return extraction.counts(files, symbols, a.referred(t))


@query(f"WITH {a.EXTRACTION_SQL} SELECT file, entity_id FROM firsts")
def primary_entities(t):
    return extraction.primary_entities(a.declared(t))


@query(f"""WITH {a.EXTRACTION_SQL} SELECT DISTINCT f.entity_id AS source, d.entity_id AS target, 'IMPORT' AS kind FROM referred r JOIN firsts f ON f.file = r.file JOIN declared d ON d.symbol_id = r.resolved_symbol_id
WHERE r.status IN ('EXACT', 'IMPORTED', 'QUALIFIED') AND r.import_kind IN ('import', 'from_import') AND d.entity_id IS NOT NULL AND f.entity_id <> d.entity_id""")
def import_edges(t):
    return extraction.import_edges(a.referred(t), a.declared(t))


@query(f"WITH {_SYMBOLS}, failed AS (SELECT DISTINCT p_brand || '.py' AS file FROM part WHERE p_brand LIKE '%3'), c AS (SELECT *, 'REMOVED' AS change FROM (SELECT * FROM old EXCEPT SELECT * FROM new) UNION ALL SELECT *, 'ADDED' FROM (SELECT * FROM new EXCEPT SELECT * FROM old)) SELECT * FROM c WHERE file NOT IN (SELECT file FROM failed)")
def structural_changes(t):
    files = t.part.select(F.concat("p_brand", F.lit(".py")).alias("file"), F.when(F.col("p_brand").endswith("3"), "FAILED").otherwise("SUCCESS").alias("status"))
    return extraction.structural_changes(_symbols(t, False), _symbols(t, True), files, files.filter("status = 'SUCCESS'"))


@query("""SELECT 't' || p_partkey AS "table", c.n AS "column", c.k AS data_type, c.o AS nullable, c.p AS primary_key, c.u AS is_unique FROM part,
(SELECT unnest([{n: 'id', k: 'BIGINT', o: false, p: true, u: false}, {n: 'c', k: 'VARCHAR', o: false, p: false, u: false}, {n: 'price', k: 'DECIMAL', o: true, p: false, u: true}, {n: 'note', k: 'TEXT', o: true, p: false, u: false}]) AS c) WHERE p_partkey % 5 <> 0""".replace("c.n AS", "CASE c.n WHEN 'c' THEN 'c' || p_partkey ELSE c.n END AS"))
def created_tables(t):
    return schema.create_tables(a.create_statements(t))


@query("SELECT r_regionkey, r_name, sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}') AS deterministic_hash FROM region")
def report_hash(t):
    return sinks.with_hash(t.region.select("r_regionkey", "r_name", F.lit("old").alias("deterministic_hash")))


@query("SELECT sum(len(regexp_split_to_array(p_type, ' '))) ::BIGINT AS n_evidence FROM part WHERE p_partkey % 3 <> 0")
def evidence_total(t):
    return graph.evidence_total(t.part.select(F.when(F.col("p_partkey") % 3 != 0, F.split("p_type", " ")).alias("provenance")))


@query(f"WITH {a.EDGES_SQL}, {a.ENTITIES_SQL}, w AS (SELECT 'part:' || (p_partkey * 2) AS origin FROM part) SELECT origin FROM w WHERE origin IN (SELECT entity_id FROM entities)")
def known_targets(t):
    return graph.known_targets(t.part.select(F.concat(F.lit("part:"), (F.col("p_partkey") * 2).cast("string")).alias("origin")), a.entities(t))


@query(f"WITH {a.FINDINGS_SQL} SELECT scope, count(DISTINCT entity) AS n_affected FROM findings WHERE category = 'BLAST_RADIUS' GROUP BY scope")
def explained_blast(t):
    return decision.explained_blast(a.findings(t), ["scope"])


def _impact(t):
    changes = t.supplier.filter("s_suppkey < 8").select(F.when(F.col("s_suppkey") % 2 == 0, "DROP_COLUMN").otherwise("ADD_COLUMN").alias("kind"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") * 3 - 3).cast("string")).alias("schema_object"))
    return changes, graph.paths(a.edges(t, repeats=True), a.origins(t, "supplier:0", "nation:1"), 2), a.entities(t).filter("entity_id NOT LIKE '%9'")


_IMPACT = f"""WITH {a.EDGES_SQL}, {a.ENTITIES_SQL}, {_grown("SELECT unnest(['supplier:0', 'nation:1']) AS origin", 2)}, e AS (SELECT * FROM entities WHERE entity_id NOT LIKE '%9'),
changes AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'DROP_COLUMN' ELSE 'ADD_COLUMN' END AS kind, 'supplier:' || (s_suppkey * 3 - 3) AS schema_object FROM supplier WHERE s_suppkey < 8)"""


@query(_IMPACT + """, met AS (SELECT unnest(nodes) AS entity_id, unnest(range(len(nodes))) AS layer FROM found UNION ALL SELECT schema_object, 0 FROM changes)
SELECT DISTINCT 'change:' || kind || ':' || schema_object AS node_id, 'CHANGE' AS kind, kind AS label, 0 AS layer FROM changes
UNION ALL SELECT 'entity:' || m.entity_id, CASE e.kind WHEN 'DATABASE' THEN 'SCHEMA_ENTITY' WHEN 'SERVICE' THEN 'SERVICE' WHEN 'API' THEN 'API_ENDPOINT' WHEN 'CLIENT' THEN 'CLIENT' ELSE 'SOURCE_SYMBOL' END, m.entity_id, min(layer)::INT FROM met m JOIN e ON e.entity_id = m.entity_id GROUP BY m.entity_id, e.kind""")
def evidence_impact_nodes(t):
    return evidence.impact_nodes(*_impact(t))


@query(_IMPACT + """, s AS (SELECT DISTINCT origin, nodes[i] AS a, nodes[i + 1] AS b, kinds[i] AS label FROM (SELECT *, unnest(range(1, len(kinds) + 1)) AS i FROM found))
SELECT DISTINCT 'change:' || kind || ':' || schema_object AS source, 'entity:' || schema_object AS target, 'AFFECTS' AS kind, kind AS label, schema_object AS via_target FROM changes WHERE schema_object IN (SELECT entity_id FROM e)
UNION ALL SELECT 'entity:' || a, 'entity:' || b, 'DEPENDS_ON', label, origin FROM s WHERE a IN (SELECT entity_id FROM e) AND b IN (SELECT entity_id FROM e)""")
def evidence_impact_edges(t):
    return evidence.impact_edges(*_impact(t))


@query(_IMPACT + """, s AS (SELECT DISTINCT nodes[i] AS a, nodes[i + 1] AS b FROM (SELECT *, unnest(range(1, len(kinds) + 1)) AS i FROM found)), n AS (SELECT entity_id FROM e WHERE entity_id LIKE '%1')
SELECT a AS source, b AS target FROM s WHERE a IN (SELECT entity_id FROM n) AND b IN (SELECT entity_id FROM n)""")
def evidence_drawn_edges(t):
    _, found, entities = _impact(t)
    edges = found.select("nodes", F.posexplode("kinds").alias("i", "k")).select(F.get("nodes", F.col("i")).alias("source"), F.get("nodes", F.col("i") + 1).alias("target")).distinct()
    return evidence.drawn(edges, entities.filter("entity_id LIKE '%1'").select(F.col("entity_id").alias("node_id")), [])


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' http://Svc' || c_custkey || '.Local:8080 ' WHEN 1 THEN 'https://API.x' WHEN 2 THEN 'plain' END AS h, CASE c_custkey % 4 WHEN 0 THEN ' post ' WHEN 1 THEN '' WHEN 2 THEN 'Put' END AS m, CASE c_custkey % 7 WHEN 0 THEN ' select' WHEN 1 THEN 'insert' WHEN 2 THEN 'Delete ' WHEN 3 THEN 'db_write' WHEN 4 THEN 'merge' WHEN 5 THEN 'DB_READ' END AS o FROM customer)
SELECT c_custkey, lower(split_part(replace(replace(trim(h), 'http://', ''), 'https://', ''), ':', 1)) AS host, upper(trim(CASE WHEN coalesce(m, '') = '' THEN 'GET' ELSE m END)) AS method,
  CASE WHEN upper(trim(coalesce(o, ''))) IN ('SELECT', 'DB_READ') THEN 'DB_READ' WHEN upper(trim(coalesce(o, ''))) IN ('INSERT', 'UPDATE', 'DELETE', 'DB_WRITE') THEN 'DB_WRITE' ELSE upper(trim(coalesce(o, ''))) END AS operation FROM v""")
def call_keys(t):
    key = F.col("c_custkey")
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (key % n).cast("int"))
    host = F.when(key % 4 == 0, F.concat(F.lit(" http://Svc"), key.cast("string"), F.lit(".Local:8080 "))).otherwise(pick(4, "", "https://API.x", "plain", None))
    operation = pick(7, " select", "insert", "Delete ", "db_write", "merge", "DB_READ", None)
    return t.customer.select("c_custkey", text.host(host).alias("host"), text.method(pick(4, " post ", "", "Put", None)).alias("method"), text.db_operation(operation).alias("operation"))


@query("""WITH v AS (SELECT p_partkey, '/a/' || (p_partkey % 3) || '/{id}' AS x, CASE p_partkey % 4 WHEN 0 THEN '/a/' || (p_partkey % 6) || '/7' WHEN 1 THEN '/a/{n}/b' WHEN 2 THEN '/a/1' ELSE '/{k}/2/z' END AS y FROM part)
SELECT p_partkey, len(str_split(x, '/')) = len(str_split(y, '/')) AND len(list_filter(list_zip(str_split(x, '/'), str_split(y, '/')), lambda z: NOT coalesce(z[1] = z[2] OR z[1] LIKE '{%}' OR z[2] LIKE '{%}', false))) = 0 AS fits FROM v""")
def route_pairs(t):
    key = F.col("p_partkey")
    left = F.concat(F.lit("/a/"), (key % 3).cast("string"), F.lit("/{id}"))
    right = F.when(key % 4 == 0, F.concat(F.lit("/a/"), (key % 6).cast("string"), F.lit("/7"))).when(key % 4 == 1, "/a/{n}/b").when(key % 4 == 2, "/a/1").otherwise("/{k}/2/z")
    return t.part.select("p_partkey", text.route_matches(left, right).alias("fits"))


@query("SELECT 'part:' || p_partkey AS entity_id, 2 AS n FROM part WHERE p_partkey % 4 = 0")
def graph_validate_entities(t):
    rows = t.part.select(a.node("part", "p_partkey").alias("entity_id"))
    return graph.duplicate_entities(rows.unionByName(t.part.filter("p_partkey % 4 = 0").select(a.node("part", "p_partkey").alias("entity_id"))))


@query(f"WITH {a.COLUMNS_SQL}, {a.DEPENDENCIES_SQL}, m AS (SELECT count(*) AS m FROM deps WHERE dependency NOT IN (SELECT \"table\" || '.' || \"column\" FROM new_columns)) SELECT CASE WHEN (SELECT count(*) FROM deps) = 0 THEN 'SAFE' WHEN m > 0 THEN 'UNSAFE' ELSE 'UNKNOWN' END AS status FROM m")
def rollback_forward_status(t):
    return rollback.forward_status(a.dependencies(t), forward_missing(t))


from causeway import scenarios  # noqa: E402, F401  (registers its queries here)
