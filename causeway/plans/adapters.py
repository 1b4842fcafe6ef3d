"""The model's relations, derived from the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


#: Line items to a partition of the graph.
LINES = 200_000


def parts(t: Tables) -> int:
    """Partitions for work on all edges, in proportion to the tables that edges come from."""
    return 1 + (t.lineitem.count() + t.orders.count()) // LINES


def edges(t: Tables, parallel: bool = False, repeats: bool = False) -> DataFrame:
    """The release graph: regions, nations, customers, suppliers, orders and parts. With ``repeats``, an edge comes once per line item."""

    def edge(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))

    supplied, ordered = (t.lineitem.select(*c) if repeats else t.lineitem.select(*c).repartition(parts(t), *c).distinct() for c in (("l_suppkey", "l_partkey"), ("l_orderkey", "l_partkey")))
    made = [
        edge(t.nation, node("region", "n_regionkey"), node("nation", "n_nationkey"), "CONFIG_DEPENDENCY"),
        edge(t.supplier, node("nation", "s_nationkey"), node("supplier", "s_suppkey"), "HTTP_CALL"),
        edge(t.customer, node("nation", "c_nationkey"), node("customer", "c_custkey"), "API_CONSUMES"),
        edge(t.orders, node("customer", "o_custkey"), node("order", "o_orderkey"), "DB_WRITE"),
        edge(supplied, node("supplier", "l_suppkey"), node("part", "l_partkey"), "DB_READ"),
        edge(supplied, node("part", "l_partkey"), node("supplier", "l_suppkey"), "IMPORT"),
        edge(ordered, node("order", "l_orderkey"), node("part", "l_partkey"), "CALL"),
    ]
    if parallel:
        made.append(edge(t.customer.filter("c_custkey % 2 = 1"), node("nation", "c_nationkey"), node("customer", "c_custkey"), "IMPORT"))
    return reduce(DataFrame.unionByName, made)


EDGES_SQL = """
supplied AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
ordered AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
edges AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'CONFIG_DEPENDENCY' AS kind FROM nation
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'HTTP_CALL' FROM supplier
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'API_CONSUMES' FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'DB_WRITE' FROM orders
  UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'DB_READ' FROM supplied
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'IMPORT' FROM supplied
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CALL' FROM ordered),
parallel AS (
  SELECT * FROM edges
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'IMPORT' FROM customer WHERE c_custkey % 2 = 1)"""


def entities(t: Tables) -> DataFrame:
    """All nodes but the orders of customers whose key is divisible by 13, so that some edges dangle."""
    kept = t.orders.filter("o_custkey % 13 <> 0")
    parts = [df.select(node(kind, key).alias("entity_id"), F.lit(label).alias("kind")) for df, kind, key, label in ((t.region, "region", "r_regionkey", "CONFIG"), (t.nation, "nation", "n_nationkey", "SERVICE"), (t.customer, "customer", "c_custkey", "CLIENT"), (t.supplier, "supplier", "s_suppkey", "SERVICE"), (kept, "order", "o_orderkey", "API"), (t.part, "part", "p_partkey", "DATABASE"))]
    return reduce(DataFrame.unionByName, parts)


ENTITIES_SQL = """
entities AS (
  SELECT 'region:' || r_regionkey AS entity_id, 'CONFIG' AS kind FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'SERVICE' FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'CLIENT' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'SERVICE' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'API' FROM orders WHERE o_custkey % 13 <> 0
  UNION ALL SELECT 'part:' || p_partkey, 'DATABASE' FROM part)"""


def origins(t: Tables, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in ids], "origin string")


def transitions(t: Tables) -> DataFrame:
    """What event follows what, of one user."""
    from pyspark.sql import Window

    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = t.events.select("event_type", after.alias("after")).filter("after IS NOT NULL AND after <> event_type").distinct()
    return pairs.select(F.concat(F.lit("event:"), "event_type").alias("source"), F.concat(F.lit("event:"), "after").alias("target"), F.lit("CALL").alias("kind"))


TRANSITIONS_SQL = """
follows AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events),
edges AS (SELECT DISTINCT 'event:' || event_type AS source, 'event:' || after AS target, 'CALL' AS kind FROM follows WHERE after IS NOT NULL AND after <> event_type)"""

PATHS = ("db/migration/m{}.sql", "api/v{}/openapi.yaml", "src/app/mod{}.py", "conf/e{}/settings.yml", "node_modules/x{}/a.js", "deploy/k8s/d{}.yaml", "svc/s{}/package.json", "docs/n{}.md")


def files(t: Tables, new: bool) -> DataFrame:
    """A snapshot of files made of orders."""
    key = F.col("o_orderkey")
    path = reduce(lambda out, i: F.when(key % len(PATHS) == i, F.concat(F.lit(PATHS[i].split("{}")[0]), key.cast("string"), F.lit(PATHS[i].split("{}")[1]))).otherwise(out), range(len(PATHS)), F.lit(""))
    content = F.concat("o_orderstatus", F.lit("|"), "o_orderpriority", F.when((key % 7 == 0) & F.lit(new), "*").otherwise(""))
    return t.orders.filter(key % 10 != (1 if new else 0)).select(path.alias("path"), F.sha2(content, 256).alias("sha256"))


_PATH_SQL = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{p.split('{}')[0]}' || o_orderkey || '{p.split('{}')[1]}'" for i, p in enumerate(PATHS)) + " END"
FILES_SQL = f"""
old_files AS (SELECT {_PATH_SQL} AS path, sha256(o_orderstatus || '|' || o_orderpriority) AS sha256 FROM orders WHERE o_orderkey % 10 <> 0),
new_files AS (SELECT {_PATH_SQL} AS path, sha256(o_orderstatus || '|' || o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN '*' ELSE '' END) AS sha256 FROM orders WHERE o_orderkey % 10 <> 1),
diff AS (
  SELECT coalesce(o.path, n.path) AS path, o.sha256 AS old_sha256, n.sha256 AS new_sha256,
    CASE WHEN o.path IS NULL THEN 'ADDED' WHEN n.path IS NULL THEN 'REMOVED' WHEN o.sha256 = n.sha256 THEN 'SAME' ELSE 'MODIFIED' END AS status
  FROM old_files o FULL JOIN new_files n ON o.path = n.path)"""


def columns(t: Tables, new: bool) -> DataFrame:
    key = F.col("p_partkey")
    kind = F.when(F.lit(new) & (key % 7 == 0), "TEXT").otherwise(F.upper(F.substring_index("p_type", " ", 1)))
    nullable = (F.col("p_size") % 2 == 0) & ~(F.lit(new) & (key % 4 == 0))
    return t.part.filter(key % 10 != (1 if new else 0)).select(F.concat(F.lit("t"), (key % 50).cast("string")).alias("table"), F.concat(F.lit("c"), key.cast("string")).alias("column"), kind.alias("data_type"), nullable.alias("nullable"))


COLUMNS_SQL = """
old_columns AS (SELECT 't' || (p_partkey % 50) AS "table", 'c' || p_partkey AS "column", upper(split_part(p_type, ' ', 1)) AS data_type, p_size % 2 = 0 AS nullable FROM part WHERE p_partkey % 10 <> 0),
new_columns AS (SELECT 't' || (p_partkey % 50) AS "table", 'c' || p_partkey AS "column", CASE WHEN p_partkey % 7 = 0 THEN 'TEXT' ELSE upper(split_part(p_type, ' ', 1)) END AS data_type, p_size % 2 = 0 AND NOT p_partkey % 4 = 0 AS nullable FROM part WHERE p_partkey % 10 <> 1)"""


#: Statements to a task: a table of keys is a small file, which one task would read, and statements are long in the reading.
STATEMENTS = 4_000


def keys_of_parts(t: Tables) -> DataFrame:
    """``p_partkey``, dealt evenly."""
    return t.part.select("p_partkey").repartition(1 + t.part.count() // STATEMENTS)


def migration(t: Tables) -> DataFrame:
    """Statements (ordinal, statement) over columns of parts."""
    key = F.col("p_partkey")
    table, column = F.concat(F.lit("t"), (key % 50).cast("string")), F.concat(F.lit("c"), key.cast("string"))
    of = F.concat(F.lit("ALTER TABLE "), table)
    forms = [F.concat(of, F.lit(" DROP COLUMN "), column), F.concat(of, F.lit(" ADD COLUMN n"), key.cast("string"), F.lit(" integer")), F.concat(of, F.lit(" ALTER COLUMN "), column, F.lit(" SET NOT NULL")), F.concat(of, F.lit(" ALTER COLUMN "), column, F.lit(" TYPE bigint")), F.concat(F.lit("CREATE INDEX i"), key.cast("string")), F.concat(F.lit("DROP TABLE IF EXISTS old"), key.cast("string"))]
    text = reduce(lambda out, i: F.when(key % 6 == i, forms[i]).otherwise(out), range(6), F.lit(""))
    return keys_of_parts(t).select(key.alias("ordinal"), text.alias("statement"))


MIGRATION_SQL = """
changes AS (
  SELECT p_partkey AS ordinal,
    CASE p_partkey % 6 WHEN 0 THEN 'DROP_COLUMN' WHEN 1 THEN 'ADD_COLUMN' WHEN 2 THEN 'ALTER_NULLABILITY' WHEN 3 THEN 'ALTER_COLUMN_TYPE' WHEN 4 THEN 'UNSUPPORTED_SCHEMA_CHANGE' ELSE 'DROP_TABLE' END AS kind,
    CASE p_partkey % 6 WHEN 4 THEN 'UNKNOWN' WHEN 5 THEN 'old' || p_partkey ELSE 't' || (p_partkey % 50) END AS "table",
    CASE p_partkey % 6 WHEN 1 THEN 'n' || p_partkey WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 'c' || p_partkey END AS object_name,
    CASE p_partkey % 6 WHEN 1 THEN 'INT' WHEN 3 THEN 'BIGINT' END AS after,
    CASE p_partkey % 6 WHEN 0 THEN 'DESTRUCTIVE' WHEN 5 THEN 'DESTRUCTIVE' WHEN 1 THEN 'ADDITIVE' WHEN 4 THEN 'UNSUPPORTED' ELSE 'DATA_DEPENDENT' END AS category,
    CASE p_partkey % 6 WHEN 0 THEN 'HIGH' WHEN 5 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 4 THEN 'INFO' ELSE 'MEDIUM' END AS severity
  FROM part)"""


def operations(t: Tables, new: bool) -> DataFrame:
    key = F.col("c_custkey")
    path = F.concat(F.lit("/"), F.lower("c_mktsegment"), F.lit("/"), key.cast("string"))
    verb = F.get(F.array(*map(F.lit, ("GET", "POST", "PUT", "DELETE"))), (key % 4).cast("int"))
    scopes = F.when(F.lit(new) & (key % 5 == 0), F.array(F.lit("oauth"), F.lit("mfa"))).when(key % 3 == 0, F.array(F.lit("oauth"))).otherwise(F.array().cast("array<string>"))
    return t.customer.filter(key % 10 != (1 if new else 0)).select(path.alias("path"), verb.alias("method"), scopes.alias("security"), key.alias("key"))


OPERATIONS_SQL = """
ops AS (SELECT c_custkey AS key, '/' || lower(c_mktsegment) || '/' || c_custkey AS path, ['GET', 'POST', 'PUT', 'DELETE'][c_custkey % 4 + 1] AS method, CASE WHEN c_custkey % 3 = 0 THEN ['oauth'] ELSE [] END AS scopes, CASE WHEN c_custkey % 5 = 0 THEN ['oauth', 'mfa'] WHEN c_custkey % 3 = 0 THEN ['oauth'] ELSE [] END AS scopes_new FROM customer),
old_ops AS (SELECT * FROM ops WHERE key % 10 <> 0), new_ops AS (SELECT * FROM ops WHERE key % 10 <> 1)"""


def parameters(t: Tables, new: bool) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.filter(key % 10 != (1 if new else 0)).select(
        F.concat(F.lit("/o/"), F.floor(key / 4).cast("string")).alias("path"), F.lit("GET").alias("method"), F.concat(F.lit("p"), (key % 4).cast("string")).alias("name"),
        F.when(F.lit(new) & (key % 7 == 0), "header").otherwise("query").alias("location"), ((F.col("o_orderstatus") == "F") | (F.lit(new) & (key % 11 == 0))).alias("required"),
    )


PARAMETERS_SQL = """
old_params AS (SELECT '/o/' || (o_orderkey // 4) AS path, 'GET' AS method, 'p' || (o_orderkey % 4) AS name, 'query' AS location, o_orderstatus = 'F' AS required FROM orders WHERE o_orderkey % 10 <> 0),
new_params AS (SELECT '/o/' || (o_orderkey // 4) AS path, 'GET' AS method, 'p' || (o_orderkey % 4) AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'header' ELSE 'query' END AS location, o_orderstatus = 'F' OR o_orderkey % 11 = 0 AS required FROM orders WHERE o_orderkey % 10 <> 1)"""


def nodes(t: Tables, new: bool) -> DataFrame:
    """Flattened schema nodes made of parts."""
    key = F.col("p_partkey")
    values = F.transform(F.sequence(F.lit(1), 1 + F.col("p_size") % 5), lambda x: x.cast("string"))
    values = F.when(key % 3 == 0, F.array().cast("array<string>") if not new else F.when(key % 2 == 0, values).otherwise(F.array().cast("array<string>"))).otherwise(F.slice(values, 1, 2) if new else values)
    return t.part.filter(key % 10 != (1 if new else 0)).select(
        F.concat(F.lit("/b/"), F.lower("p_brand")).alias("path"), F.lit("POST").alias("method"), F.when(key % 2 == 0, "RESPONSE").otherwise("REQUEST").alias("direction"), F.concat(F.lit("f"), key.cast("string")).alias("location"),
        F.when(F.lit(new) & (key % 7 == 0), "integer").otherwise("string").alias("type"), ((F.col("p_size") % 4 == 0) | (F.lit(new) & (key % 11 == 0))).alias("required"), values.alias("enum"),
    )


NODES_SQL = """
base AS (SELECT *, '/b/' || lower(p_brand) AS path, 'POST' AS method, CASE WHEN p_partkey % 2 = 0 THEN 'RESPONSE' ELSE 'REQUEST' END AS direction, 'f' || p_partkey AS location, 1 + p_size % 5 AS n FROM part),
old_nodes AS (SELECT path, method, direction, location, 'string' AS type, p_size % 4 = 0 AS required, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE n END AS n FROM base WHERE p_partkey % 10 <> 0),
new_nodes AS (SELECT path, method, direction, location, CASE WHEN p_partkey % 7 = 0 THEN 'integer' ELSE 'string' END AS type, p_size % 4 = 0 OR p_partkey % 11 = 0 AS required, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN n ELSE 0 END ELSE least(n, 2) END AS n FROM base WHERE p_partkey % 10 <> 1),
joined AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.method, n.method) AS method, coalesce(o.direction, n.direction) AS direction, coalesce(o.location, n.location) AS location, o.type AS ot, n.type AS nt, o.required AS oreq, n.required AS nreq, o.n AS ov, n.n AS nv
  FROM old_nodes o FULL JOIN new_nodes n ON o.path = n.path AND o.method = n.method AND o.direction = n.direction AND o.location = n.location)"""


def findings(t: Tables) -> DataFrame:
    """One finding per event, in 20 scopes."""
    kind, key = F.col("event_type"), F.col("event_id")
    category = F.when(kind == "view", "BLAST_RADIUS").when(kind == "click", "DATABASE").when(kind == "purchase", "API_CONTRACT").otherwise("ROLLBACK")
    rule = F.when(kind == "view", "BLAST-DOWNSTREAM-IMPACT").when(kind == "click", F.when(key % 3 == 0, "DROP_COLUMN").otherwise("ADD_COLUMN")).when(kind == "purchase", "API-PARAM-REMOVED").otherwise(F.when(key % 2 == 0, "RB-SCHEMA-REMOVED-OLD-DEPENDENCY").otherwise("EXPAND_CONTRACT_VIOLATION"))
    level = F.get(F.array(*map(F.lit, ("INFO", "LOW", "MEDIUM", "HIGH"))), (key % 4).cast("int"))
    level = F.when(key % 211 == 0, "CRITICAL").otherwise(level)
    return t.events.select(
        (F.col("user_id") % 20).alias("scope"), F.concat(F.lit("f:"), key.cast("string")).alias("finding_id"), category.alias("category"), level.alias("severity"), F.when(key % 5 == 0, 0.5).otherwise(1.0).alias("confidence"), rule.alias("rule_id"),
        ((kind == "error") | (key % 101 == 0)).alias("blocking"), F.when(key % 397 == 0, "unknown").alias("uncertainty"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("entity"),
    )


FINDINGS_SQL = """
findings AS (
  SELECT user_id % 20 AS scope, 'f:' || event_id AS finding_id,
    CASE event_type WHEN 'view' THEN 'BLAST_RADIUS' WHEN 'click' THEN 'DATABASE' WHEN 'purchase' THEN 'API_CONTRACT' ELSE 'ROLLBACK' END AS category,
    CASE WHEN event_id % 211 = 0 THEN 'CRITICAL' ELSE ['INFO', 'LOW', 'MEDIUM', 'HIGH'][event_id % 4 + 1] END AS severity,
    CASE WHEN event_id % 5 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
    CASE event_type WHEN 'view' THEN 'BLAST-DOWNSTREAM-IMPACT' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'DROP_COLUMN' ELSE 'ADD_COLUMN' END WHEN 'purchase' THEN 'API-PARAM-REMOVED'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'RB-SCHEMA-REMOVED-OLD-DEPENDENCY' ELSE 'EXPAND_CONTRACT_VIOLATION' END END AS rule_id,
    event_type = 'error' OR event_id % 101 = 0 AS blocking, CASE WHEN event_id % 397 = 0 THEN 'unknown' END AS uncertainty, 'user:' || user_id AS entity
  FROM events),
worth AS (SELECT *, confidence * CASE severity WHEN 'CRITICAL' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.75::DOUBLE WHEN 'MEDIUM' THEN 0.5::DOUBLE WHEN 'LOW' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score FROM findings),
feats AS (
  SELECT scope,
    round_even(coalesce(max(score) FILTER (category = 'BLAST_RADIUS'), 0.0::DOUBLE), 6) AS blast_severity, round_even(coalesce(max(score) FILTER (category IN ('DATABASE', 'API_CONTRACT')), 0.0::DOUBLE), 6) AS deployment_severity,
    round_even(coalesce(max(score) FILTER (category = 'ROLLBACK'), 0.0::DOUBLE), 6) AS rollback_unsafety, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
    count(*) FILTER (rule_id IN ('DROP_COLUMN', 'DROP_TABLE')) AS destructive, count(*) FILTER (category = 'API_CONTRACT' AND blocking) AS breaking_api,
    count(*) FILTER (category = 'ROLLBACK' AND (rule_id LIKE 'RB-%' OR starts_with(rule_id, 'EXPAND_'))) AS rollback_violations, count(*) FILTER (uncertainty IS NOT NULL OR confidence = 0) AS unknown,
    count(*) FILTER (category = 'AMBIGUITY') AS ambiguous, count(*) FILTER (category = 'DYNAMIC_REFERENCE') AS unresolved, count(DISTINCT entity) AS affected,
    bool_or(category = 'DATABASE' AND blocking) AS db_blocking, bool_or(rule_id = 'RB-SCHEMA-REMOVED-OLD-DEPENDENCY') AS removed_dependency, bool_or(category = 'API_CONTRACT' AND blocking) AS api_blocking,
    bool_or(category = 'DATABASE') AS db, bool_or(category = 'BLAST_RADIUS' AND severity = 'CRITICAL') AS blast_critical, bool_or(category = 'ROLLBACK' AND blocking) AS rollback_blocking,
    bool_or(blocking AND severity = 'CRITICAL' AND confidence >= 0.75) AS critical_blocking
  FROM worth GROUP BY scope),
based AS (SELECT *, round_even(100::DOUBLE * (0.4::DOUBLE * blast_severity + 0.35::DOUBLE * deployment_severity + 0.25::DOUBLE * rollback_unsafety), 0)::BIGINT AS base_risk,
  round_even(least(1.5::DOUBLE, 1.0::DOUBLE * CASE WHEN api_blocking AND db THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN blast_critical AND rollback_blocking THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN db_blocking AND removed_dependency THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END), 6) AS multiplier FROM feats),
risked AS (SELECT *, least(100, round_even(base_risk * multiplier, 0))::BIGINT AS risk FROM based),
stops AS (SELECT *, concat_ws(',', CASE WHEN critical_blocking THEN 'CRITICAL_BLOCKING_FINDING' END, CASE WHEN rollback_unsafety >= 1 AND destructive > 0 THEN 'UNSAFE_ROLLBACK_DESTRUCTIVE_CHANGE' END, CASE WHEN risk >= 70 THEN 'RISK_THRESHOLD_70' END) AS stop FROM risked),
decided AS (SELECT *, CASE WHEN stop <> '' THEN stop WHEN unknown > 0 THEN 'REQUIRED_EVIDENCE_UNKNOWN' WHEN risk >= 40 THEN 'RISK_THRESHOLD_40' ELSE 'NO_BLOCKING_FINDING_LOW_RISK' END AS rules,
  CASE WHEN stop <> '' THEN 'DO_NOT_DEPLOY' WHEN unknown > 0 THEN 'UNKNOWN' WHEN risk >= 40 THEN 'CAUTION' ELSE 'SAFE' END AS verdict FROM stops)"""


def dependencies(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.filter(key % 3 == 0).select(F.concat(F.lit("t"), (key % 50).cast("string"), F.lit(".c"), key.cast("string")).alias("dependency"))


DEPENDENCIES_SQL = """deps AS (SELECT 't' || (p_partkey % 50) || '.c' || p_partkey AS dependency FROM part WHERE p_partkey % 3 = 0)"""


def routes(t: Tables) -> DataFrame:
    """Service and normalised route of every page's url."""
    from causeway.functions import text

    url = F.col("url")
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "[0-9]+", "{n}")
    return t.pages.select("page_id", F.coalesce(text.service_of(url), F.lit("")).alias("service"), text.route(path).alias("route"))


def calls(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Consumers and providers of routes: pages with even and odd keys."""
    rows = routes(t)
    return rows.filter("page_id % 2 = 0"), rows.filter("page_id % 2 = 1").select("service", "route").distinct()


def literals(t: Tables) -> DataFrame:
    """SQL texts of programs, one per part."""
    key = F.col("p_partkey").cast("string")
    forms = [F.concat(F.lit("SELECT id, c"), key, F.lit(" from t"), key, F.lit(" WHERE x = 1")), F.concat(F.lit(" update t"), key, F.lit(" SET a = 2")), F.concat(F.lit("INSERT into t"), key, F.lit(" VALUES (1)")), F.concat(F.lit("DELETE FROM t"), key), F.lit("VACUUM")]
    return t.part.select("p_partkey", F.get(F.array(*forms), (F.col("p_partkey") % 5).cast("int")).alias("statement"))


def route_calls(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Calls and providers (with entities) of routes with and without parameters, from urls of pages with even and odd keys."""
    from causeway.functions import text

    key, plain = F.col("page_id"), F.regexp_replace("url", r"[?#].*$", "")
    path = F.when(key % 5 < 3, F.regexp_replace(plain, "/[0-9]+", "/{n}")).otherwise(plain)
    verb = F.when(key % 3 == 0, "POST").otherwise("GET")
    rows = t.pages.select("page_id", verb.alias("method"), F.coalesce(text.service_of(F.col("url")), F.lit("")).alias("service"), text.route(path).alias("route"))
    calls = rows.filter("page_id % 2 = 0").select("method", F.when(key % 4 == 0, F.col("service")).otherwise("").alias("host"), "route")
    entity = F.concat("service", F.lit(".C"), (key % 5).cast("string"), F.when(key % 7 == 0, "Client").otherwise(""))
    return calls, rows.filter("page_id % 2 = 1").select("method", F.col("service").alias("host"), "route", entity.alias("entity"))


ROUTES_SQL = """
plain AS (SELECT page_id, coalesce(nullif(split_part(regexp_extract(url, '^https?://([^/]*)', 1), ':', 1), ''), '') AS service, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '/+$', '') AS x FROM pages),
shaped AS (SELECT *, CASE WHEN x = '' THEN '/' WHEN page_id % 5 < 3 THEN regexp_replace(x, '/[0-9]+', '/{id}', 'g') ELSE x END AS route FROM plain),
calls AS (SELECT DISTINCT method, CASE WHEN page_id % 4 = 0 THEN service ELSE '' END AS host, route, string_split(route, '/') AS a FROM shaped WHERE page_id % 2 = 0),
offers AS (SELECT DISTINCT method, service AS host, string_split(route, '/') AS b, service || '.C' || (page_id % 5) || CASE WHEN page_id % 7 = 0 THEN 'Client' ELSE '' END AS entity FROM shaped WHERE page_id % 2 = 1),
pairs AS (SELECT c.method, c.host, c.route, o.entity FROM calls c LEFT JOIN offers o ON c.method = o.method AND (c.host = '' OR c.host = o.host) AND len(a) = len(b)
  AND len(list_filter(range(1, len(a) + 1), lambda i: NOT (a[i] = b[i] OR regexp_matches(a[i], '^[{].*[}]$') OR regexp_matches(b[i], '^[{].*[}]$')))) = 0),
found AS (SELECT method, host, route, count(DISTINCT entity) AS n, min(entity) AS one, count(DISTINCT entity) FILTER (entity NOT LIKE '%Client') AS m, min(entity) FILTER (entity NOT LIKE '%Client') AS other FROM pairs GROUP BY ALL),
matched AS (SELECT method, host, route, CASE WHEN m > 0 THEN m ELSE n END AS n_candidates, coalesce(other, one) AS e FROM found)"""


def change_sequences(t: Tables) -> DataFrame:
    """Many changes per column and table, one per order, with tables dropped and made again, and some that never were."""
    key = F.col("o_orderkey")
    p = key % 211
    kind = (key * 31 + F.floor(key / 211) * 17) % 9
    rare = p % 13 == 0
    name = F.when(kind == 6, F.when(rare & (F.floor(key / 211) % 5 == 0), "DROP_TABLE").otherwise("ALTER_NULLABILITY")).when(kind == 7, F.when(rare, "ADD_TABLE").otherwise("ADD_COLUMN"))
    name = name.when(kind == 0, "ADD_COLUMN").when(kind == 3, "DROP_COLUMN").when(kind == 4, "UNSUPPORTED_SCHEMA_CHANGE").when(kind.isin(2, 5), "ALTER_COLUMN_TYPE").otherwise("ALTER_NULLABILITY")
    table = F.concat(F.when(p % 17 == 0, "u").otherwise("t"), (p % 50).cast("string"))
    out = t.orders.select(key.alias("ordinal"), name.alias("kind"), table.alias("table"), F.concat(F.lit("c"), p.cast("string")).alias("object_name"), F.concat(F.lit("T"), (key % 5).cast("string")).alias("after"))
    of_table = F.col("kind").isin("DROP_TABLE", "ADD_TABLE", "UNSUPPORTED_SCHEMA_CHANGE")
    return out.select("ordinal", "kind", "table", F.when(~of_table, F.col("object_name")).alias("object_name"), F.when(F.col("kind").isin("ADD_COLUMN", "ALTER_COLUMN_TYPE"), F.col("after")).alias("after"))


SEQUENCES_SQL = """
raw AS (SELECT o_orderkey AS ordinal, o_orderkey % 211 AS p, o_orderkey // 211 AS q, (o_orderkey * 31 + (o_orderkey // 211) * 17) % 9 AS k FROM orders),
named AS (SELECT ordinal, p, CASE k WHEN 0 THEN 'ADD_COLUMN' WHEN 3 THEN 'DROP_COLUMN' WHEN 4 THEN 'UNSUPPORTED_SCHEMA_CHANGE' WHEN 2 THEN 'ALTER_COLUMN_TYPE' WHEN 5 THEN 'ALTER_COLUMN_TYPE'
  WHEN 6 THEN CASE WHEN p % 13 = 0 AND q % 5 = 0 THEN 'DROP_TABLE' ELSE 'ALTER_NULLABILITY' END WHEN 7 THEN CASE WHEN p % 13 = 0 THEN 'ADD_TABLE' ELSE 'ADD_COLUMN' END ELSE 'ALTER_NULLABILITY' END AS kind FROM raw),
seq AS (SELECT ordinal, kind, CASE WHEN p % 17 = 0 THEN 'u' ELSE 't' END || (p % 50) AS "table", CASE WHEN kind NOT IN ('DROP_TABLE', 'ADD_TABLE', 'UNSUPPORTED_SCHEMA_CHANGE') THEN 'c' || p END AS object_name, CASE WHEN kind IN ('ADD_COLUMN', 'ALTER_COLUMN_TYPE') THEN 'T' || (ordinal % 5) END AS after FROM named)"""


def trees(t: Tables, new: bool) -> DataFrame:
    """Nested schema nodes: an object per ten parts, a property per part, items and a property in them per property."""
    key, group = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    gone, hidden = (1, 3) if new else (0, 2)
    none = F.array().cast("array<string>")
    base = t.part.filter(group % 5 != gone).select(key.alias("k"), group.alias("g"))
    place = [F.concat(F.lit("/t/"), (F.col("g") % 7).cast("string")).alias("path"), F.lit("POST").alias("method"), F.when(F.col("g") % 2 == 0, "RESPONSE").otherwise("REQUEST").alias("direction")]
    top = F.concat(F.lit("g"), F.col("g").cast("string"))
    leaf = F.concat(top, F.lit(".f"), F.col("k").cast("string"))
    required = (F.col("k") % 3 == 0) | (F.lit(new) & (F.col("k") % 4 == 0))
    tops = base.select("g").distinct().select(*place, top.alias("location"), F.lit("object").alias("type"), (F.col("g") % 3 == 0).alias("required"), none.alias("enum"))
    held = base.filter(F.col("k") % 8 != hidden)
    leaves = held.select(*place, leaf.alias("location"), F.lit("array").alias("type"), required.alias("required"), none.alias("enum"))
    items = held.filter(F.col("k") % 9 != hidden)
    arrays = items.select(*place, F.concat(leaf, F.lit(".[]")).alias("location"), F.lit("object").alias("type"), F.lit(False).alias("required"), none.alias("enum"))
    inner = items.select(*place, F.concat(leaf, F.lit(".[].x")).alias("location"), F.lit("string").alias("type"), (F.lit(new) & (F.col("k") % 2 == 0)).alias("required"), none.alias("enum"))
    return tops.unionByName(leaves).unionByName(arrays).unionByName(inner)


def _trees_sql(name: str, gone: int, hidden: int, new: bool) -> str:
    place = "'/t/' || (g % 7) AS path, 'POST' AS method, CASE WHEN g % 2 = 0 THEN 'RESPONSE' ELSE 'REQUEST' END AS direction"
    base = f"(SELECT p_partkey AS k, p_partkey // 10 AS g FROM part WHERE (p_partkey // 10) % 5 <> {gone})"
    return f"""{name} AS (SELECT DISTINCT {place}, ['g' || g] AS names, 'object' AS type, g % 3 = 0 AS required FROM {base}
UNION ALL SELECT {place}, ['g' || g, 'f' || k], 'array', k % 3 = 0 OR ({new} AND k % 4 = 0) FROM {base} WHERE k % 8 <> {hidden}
UNION ALL SELECT {place}, ['g' || g, 'f' || k, '[]'], 'object', false FROM {base} WHERE k % 8 <> {hidden} AND k % 9 <> {hidden}
UNION ALL SELECT {place}, ['g' || g, 'f' || k, '[]', 'x'], 'string', {new} AND k % 2 = 0 FROM {base} WHERE k % 8 <> {hidden} AND k % 9 <> {hidden})"""


#: Walks both schemas from the top: only nodes that stand on both sides are gone into.
TREES_SQL = f"""{_trees_sql("old_t", 0, 2, False)}, {_trees_sql("new_t", 1, 3, True)},
j AS (SELECT coalesce(o.path, n.path) AS path, coalesce(o.method, n.method) AS method, coalesce(o.direction, n.direction) AS direction, coalesce(o.names, n.names) AS names, o.type AS ot, n.type AS nt, o.required AS oreq, n.required AS nreq
  FROM old_t o FULL JOIN new_t n ON o.path = n.path AND o.method = n.method AND o.direction = n.direction AND o.names = n.names),
walk AS (SELECT *, 1 AS depth FROM j WHERE len(names) = 1 UNION ALL SELECT j.*, depth + 1 FROM walk w JOIN j ON j.path = w.path AND j.method = w.method AND j.direction = w.direction AND len(j.names) = depth + 1 AND j.names[:depth] = w.names WHERE w.ot IS NOT NULL AND w.nt IS NOT NULL)"""


def declared(t: Tables) -> DataFrame:
    """Symbols (file, symbol_id, kind, name, line, column, entity_id), one per part; only classes are entities."""
    key = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, ("CLASS", "FUNCTION", "DATA_CLASS", "METHOD"))), (key % 4).cast("int"))
    return t.part.select(F.concat("p_brand", F.lit(".py")).alias("file"), F.concat(F.lit("s"), key.cast("string")).alias("symbol_id"), kind.alias("kind"), "p_name", F.col("p_size").alias("line"), (key % 7).cast("int").alias("column"), F.when(key % 2 == 0, F.concat(F.lit("svc."), (key % 50).cast("string"))).alias("entity_id"))


def referred(t: Tables) -> DataFrame:
    """References (file, status, import_kind, resolved_symbol_id), one per line item."""
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    pick = lambda k, *names: F.get(F.array(*map(F.lit, names)), (k % len(names)).cast("int"))
    rows = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return rows.select(F.concat("p_brand", F.lit(".py")).alias("file"), pick(key, "EXACT", "UNRESOLVED", "IMPORTED", "AMBIGUOUS", "QUALIFIED").alias("status"), pick(key, "import", "call", "from_import").alias("import_kind"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("resolved_symbol_id"))


EXTRACTION_SQL = """
declared AS (SELECT p_brand || '.py' AS file, 's' || p_partkey AS symbol_id, ['CLASS', 'FUNCTION', 'DATA_CLASS', 'METHOD'][p_partkey % 4 + 1] AS kind, p_size AS line, p_partkey % 7 AS "column", CASE WHEN p_partkey % 2 = 0 THEN 'svc.' || (p_partkey % 50) END AS entity_id FROM part),
referred AS (SELECT p_brand || '.py' AS file, ['EXACT', 'UNRESOLVED', 'IMPORTED', 'AMBIGUOUS', 'QUALIFIED'][(l_orderkey * 7 + l_linenumber) % 5 + 1] AS status, ['import', 'call', 'from_import'][(l_orderkey * 7 + l_linenumber) % 3 + 1] AS import_kind, 's' || l_suppkey AS resolved_symbol_id FROM lineitem JOIN part ON p_partkey = l_partkey),
firsts AS (SELECT DISTINCT file, first_value(entity_id) OVER (PARTITION BY file ORDER BY line, "column", symbol_id) AS entity_id FROM declared WHERE kind IN ('CLASS', 'DATA_CLASS') AND entity_id IS NOT NULL)"""


def create_statements(t: Tables) -> DataFrame:
    """CREATE TABLE statements of four columns and a table constraint, one per part, among others."""
    key = F.col("p_partkey").cast("string")
    made = F.concat(F.lit("create table if not exists t"), key, F.lit(" (id bigint PRIMARY KEY, c"), key, F.lit(" Varchar(20) not null, price DECIMAL(10, 2) UNIQUE, note text DEFAULT coalesce('a', lower('b')), FOREIGN KEY (id) REFERENCES u (id, x))"))
    return keys_of_parts(t).select(F.when(F.col("p_partkey") % 5 == 0, F.lit("CREATE INDEX i ON t (id)")).otherwise(made).alias("statement"))


def scripts(t: Tables) -> DataFrame:
    """Migration scripts (path, text), one per part: several statements, ALTERs of several actions, quotes, comments, and a null text."""
    k = F.col("p_partkey").cast("string")
    table = F.concat(F.lit("t"), (F.col("p_partkey") % 50).cast("string"))
    texts = (
        ("-- drops; of ", k, "\nALTER TABLE ", table, " DROP COLUMN c", k, ", DROP d", k, ";\nDROP INDEX IF EXISTS i", k, ";"),
        ("/* a; b\n' */ ALTER TABLE IF EXISTS s.", table, " ADD \"weird; ", k, "\" integer DEFAULT 'x;y, z', ADD COLUMN n", k, " DECIMAL(10, 2) DEFAULT f(1, 2); SELECT 'a; b' -- c;\n"),
        ("alter table \"T, ", k, "\" alter \"c ", k, "\" set not null, ALTER COLUMN d TYPE double precision USING d::double precision;;"),
        ("DROP VIEW v", k, " ; DROP TABLE \"old, ", k, "\" CASCADE"),
        ("ALTER TABLE ", table, " ADD CONSTRAINT k CHECK (a > 0, b), RENAME TO u, ALTER q DROP NOT NULL; CREATE TABLE z (a int)"),
    )
    text = F.lit(None).cast("string")
    for i, parts in enumerate(texts):
        text = F.when(F.col("p_partkey") % 6 == i, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise(text)
    return keys_of_parts(t).select(F.concat(F.lit("db/m"), k, F.lit(".sql")).alias("path"), text.alias("text"))


def _row(**fields: str) -> str:
    return "{" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + "}"


def _scripts_sql() -> str:
    """What each script says, statement by statement and action by action, written from what it was made of."""
    t, k = "('t' || (p_partkey % 50))", "p_partkey"

    def action(statement: int, place: int, kind: str, table: str, name: str = "NULL", after: str = "NULL") -> str:
        return _row(o=str(statement), a=str(place), kind=f"'{kind}'", t=table, n=f"{name}::VARCHAR", f=f"{after}::VARCHAR")

    cases = (
        (action(0, 0, "DROP_COLUMN", t, f"'c' || {k}"), action(0, 1, "DROP_COLUMN", t, f"'d' || {k}"), action(1, 0, "DROP_TABLE", f"'i' || {k}")),
        (action(0, 0, "ADD_COLUMN", t, f"'weird; ' || {k}", "'INT'"), action(0, 1, "ADD_COLUMN", t, f"'n' || {k}", "'DECIMAL'"), action(1, 0, "UNSUPPORTED_SCHEMA_CHANGE", "'UNKNOWN'")),
        (action(0, 0, "ALTER_NULLABILITY", f"'T, ' || {k}", f"'c ' || {k}"), action(0, 1, "ALTER_COLUMN_TYPE", f"'T, ' || {k}", "'d'", "'DOUBLE'")),
        (action(0, 0, "DROP_TABLE", f"'v' || {k}"), action(1, 0, "DROP_TABLE", f"'old, ' || {k}")),
        (*[action(0, i, "UNSUPPORTED_SCHEMA_CHANGE", t) for i in range(3)], action(1, 0, "UNSUPPORTED_SCHEMA_CHANGE", "'UNKNOWN'")),
    )
    said = " ".join(f"WHEN {i} THEN [{', '.join(c)}]" for i, c in enumerate(cases))
    return f"""said AS (SELECT p_partkey, 'db/m' || p_partkey || '.sql' AS path, unnest(CASE p_partkey % 6 {said} END) AS x FROM part),
acts AS (SELECT p_partkey, path, x.o::INT AS ordinal, x.a::INT AS action, x.kind AS kind, x.t AS "table", x.n AS object_name, x.f AS after,
  CASE WHEN x.kind LIKE 'DROP%' THEN 'DESTRUCTIVE' WHEN x.kind = 'ADD_COLUMN' THEN 'ADDITIVE' WHEN x.kind LIKE 'ALTER%' THEN 'DATA_DEPENDENT' ELSE 'UNSUPPORTED' END AS category,
  CASE WHEN x.kind LIKE 'DROP%' THEN 'HIGH' WHEN x.kind = 'ADD_COLUMN' THEN 'LOW' WHEN x.kind LIKE 'ALTER%' THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM said)"""


SCRIPTS_SQL = _scripts_sql()


def quoted_tables(t: Tables) -> DataFrame:
    """CREATE TABLE statements, one per part, with quoted names, defaults that hold commas and types of several words."""
    k = F.col("p_partkey").cast("string")
    body = (
        "create table \"s x\".t", k, " (id INTEGER primary key, \"weird, ", k, "\" INT4 not null, note VARCHAR DEFAULT 'a, b c NOT NULL', d numeric(10, 2) check (d is not null and d in (1, (2), 3)) unique, e, ",
        "f primary key, constraint pk primary key (id, d), \"primary\" text, ts timestamp with time zone default (now(), 1), /* g int, */ h double precision) partition by (x)",
    )
    return keys_of_parts(t).select(F.lit("p").alias("path"), F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in body]).alias("text"))


REQUESTS = 40


def product(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of a product: columns that services read, services that call the API of their nation, clients that consume it, and
    services that consume an API themselves, so that there are cycles."""

    def edge(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))

    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    column = lambda c: F.concat(F.lit("t"), (F.col(c) % 50).cast("string"), F.lit(".c"), F.col(c).cast("string"))
    entities = [t.part.filter("p_partkey % 9 <> 4").select(column("p_partkey").alias("entity_id")), t.supplier.select(named("svc.S", "s_suppkey").alias("entity_id")), t.nation.select(named("api.N", "n_nationkey").alias("entity_id")), t.customer.select(named("client.C", "c_custkey").alias("entity_id"))]
    read = t.lineitem.filter("l_partkey % 9 <> 4").select("l_partkey", "l_suppkey").distinct()
    consumed = t.supplier.filter("s_suppkey % 4 = 0").select("s_suppkey", ((F.col("s_suppkey") * 7 + 3) % 25).alias("n"))
    edges = [edge(read, column("l_partkey"), named("svc.S", "l_suppkey"), "DB_READ"), edge(t.supplier, named("svc.S", "s_suppkey"), named("api.N", "s_nationkey"), "HTTP_CALL"), edge(t.customer, named("api.N", "c_nationkey"), named("client.C", "c_custkey"), "API_CONSUMES"), edge(consumed, named("api.N", "n"), named("svc.S", "s_suppkey"), "API_CONSUMES")]
    return reduce(DataFrame.unionByName, entities), reduce(DataFrame.unionByName, edges)


PRODUCT_SQL = """
p_entities AS (SELECT 't' || (p_partkey % 50) || '.c' || p_partkey AS entity_id FROM part WHERE p_partkey % 9 <> 4 UNION ALL SELECT 'svc.S' || s_suppkey FROM supplier UNION ALL SELECT 'api.N' || n_nationkey FROM nation UNION ALL SELECT 'client.C' || c_custkey FROM customer),
p_edges AS (SELECT DISTINCT 't' || (l_partkey % 50) || '.c' || l_partkey AS source, 'svc.S' || l_suppkey AS target, 'DB_READ' AS kind FROM lineitem WHERE l_partkey % 9 <> 4
  UNION ALL SELECT 'svc.S' || s_suppkey, 'api.N' || s_nationkey, 'HTTP_CALL' FROM supplier UNION ALL SELECT 'api.N' || c_nationkey, 'client.C' || c_custkey, 'API_CONSUMES' FROM customer
  UNION ALL SELECT 'api.N' || ((s_suppkey * 7 + 3) % 25), 'svc.S' || s_suppkey, 'API_CONSUMES' FROM supplier WHERE s_suppkey % 4 = 0)"""


def variants(t: Tables) -> DataFrame:
    """Requests 0 to 39, each as proposed and as an expansion that drops nothing."""
    return t.spark.range(REQUESTS).select(F.col("id").alias("request"), F.explode(F.array(F.lit("expand"), F.lit("proposed"))).alias("variant"))


def requested(t: Tables, changes: DataFrame) -> DataFrame:
    """``changes`` by variant and request; every tenth request has no migration."""
    rows = changes.withColumn("request", F.col("ordinal") % REQUESTS).filter("request % 10 <> 9")
    return rows.join(variants(t), "request").filter("variant = 'proposed' OR category <> 'DESTRUCTIVE'")


# Every eighth request has no contract, the old application of some is unknown, and of others whether they roll back.
REQUESTS_SQL = f"""
scopes AS (SELECT v || ':' || r AS scope, v AS variant, r AS request FROM range({REQUESTS}) AS x(r), (VALUES ('expand'), ('proposed')) AS y(v)),
scoped AS (SELECT scope, request, concat_ws('.', "table", object_name) AS o, c.* FROM changes c JOIN scopes ON request = ordinal % {REQUESTS} WHERE request % 10 <> 9 AND (variant = 'proposed' OR category <> 'DESTRUCTIVE')),
primaries AS (SELECT * FROM scoped QUALIFY row_number() OVER (PARTITION BY scope ORDER BY CASE category WHEN 'DESTRUCTIVE' THEN 5 WHEN 'DATA_DEPENDENT' THEN 4 WHEN 'ADDITIVE' THEN 2 WHEN 'UNSUPPORTED' THEN 1 ELSE 0 END DESC, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END DESC, ordinal) = 1),
api AS (SELECT scope, key, path, method, CASE WHEN key % 10 = 1 THEN 'API-ENDPOINT-REMOVED' ELSE 'API-ENDPOINT-ADDED' END AS rule_id FROM ops JOIN scopes ON request = key % {REQUESTS} WHERE key % 10 < 2 AND request % 8 <> 7),
targets AS (SELECT scope, o AS origin FROM scoped WHERE o IN (SELECT entity_id FROM p_entities) UNION SELECT scope, 'api.N' || (key % 25) FROM api WHERE rule_id = 'API-ENDPOINT-REMOVED' AND 'api.N' || (key % 25) IN (SELECT entity_id FROM p_entities))"""


#: The part of the SQL of findings that goes from findings to verdicts.
DECIDED_SQL = FINDINGS_SQL[FINDINGS_SQL.index("worth AS") :]


def documents_of_contracts(t: Tables, new: bool) -> DataFrame:
    """API contracts in JSON (path, text), one per nation: an operation per customer, whose body refers to a schema that refers to itself."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("f."), key.cast("string"))
    ref = '"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Node"}}}'
    kept = t.customer.filter(key % 10 != (1 if new else 0))
    operation = F.concat(F.lit('"/c/'), key.cast("string"), F.lit('":{"post":{"operationId":"c'), key.cast("string"), F.lit('","requestBody":{'), F.lit(ref), F.lit('},"responses":{"200":{"content":{"application/json":{"schema":{"type":"object","required":["'), name, F.lit('"],"properties":{"'), name, F.lit('":{"type":"'), F.when(F.lit(new) & (key % 7 == 0), "integer").otherwise("string"), F.lit('"}}}}}}}}}'))
    whole = kept.select("c_nationkey", key.alias("k"), operation.alias("o")).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("k", "o"))).alias("a"))
    node = '{"type":"object","properties":{"next":{"$ref":"#/components/schemas/Node"},"v":{"type":"string","enum":["a","b"]}}}'
    return whole.select(F.concat(F.lit("api/"), F.col("c_nationkey").cast("string"), F.lit(".json")).alias("path"), F.concat(F.lit('{"openapi":"3.0.0","components":{"schemas":{"Node":' + node + '}},"paths":{'), F.array_join(F.transform("a", lambda x: x["o"]), ","), F.lit("}}")).alias("text"))
