"""Operators on small graphs and findings with known answers."""

import random

from pyspark.sql import functions as F

from causeway.functions import text
from causeway.operators import decision, evidence, graph, rollback, schema, snapshots


def edges(spark, *rows):
    return spark.createDataFrame(rows, "source string, target string, kind string")


def start(spark, x):
    return spark.createDataFrame([(x,)], "origin string")


def test_chain_scores(spark):
    e = edges(spark, ("a", "b", "DB_READ"), ("b", "c", "HTTP_CALL"), ("c", "d", "API_CONSUMES"))
    got = {r["entity"]: (r["severity"], r["level"]) for r in graph.blast_radius(e, start(spark, "a")).collect()}
    assert got == {"b": (0.9, "CRITICAL"), "c": (0.45, "MEDIUM"), "d": (0.286875, "LOW")}


def test_cycle_and_diamond(spark):
    e = edges(spark, ("a", "b", "CALL"), ("b", "a", "CALL"), ("a", "c", "CALL"), ("b", "d", "CALL"), ("c", "d", "CALL"))
    got = [r["path"] for r in graph.blast_radius(e, start(spark, "a")).orderBy("path").collect()]
    assert got == ["a>b", "a>b>d", "a>c", "a>c>d"]
    assert [r["path"] for r in graph.blast_radius(e, start(spark, "a"), max_paths=1).collect()] == ["a>b"]


def test_parallel_edges_take_greatest_kind(spark):
    e = edges(spark, ("a", "b", "HTTP_CALL"), ("a", "b", "IMPORT"))
    assert [r["kind"] for r in graph.collapse(e).collect()] == ["IMPORT"]


def test_unknown_is_never_safe(spark):
    kinds = "scope int, category string, severity string, confidence double, rule_id string, blocking boolean, uncertainty string, entity string"
    found = spark.createDataFrame([
        (1, "ROLLBACK", "MEDIUM", 0.0, "RB-UNKNOWN", False, "missing", None),
        (2, "DATABASE", "LOW", 1.0, "ADD_COLUMN", False, None, "t.c"),
        (3, "DATABASE", "HIGH", 1.0, "DROP_COLUMN", True, None, "t.c"),
        (3, "ROLLBACK", "CRITICAL", 1.0, "RB-SCHEMA-REMOVED-OLD-DEPENDENCY", True, None, "t.c"),
        (3, "BLAST_RADIUS", "CRITICAL", 1.0, "BLAST-DOWNSTREAM-IMPACT", False, None, "s"),
    ], kinds)
    got = {r["scope"]: (r["verdict"], r["base_risk"], r["risk"]) for r in decision.decide(found, ["scope"]).collect()}
    assert got == {1: ("UNKNOWN", 0, 0), 2: ("SAFE", 9, 9), 3: ("DO_NOT_DEPLOY", 91, 100)}


def test_migration_statements(spark):
    files = spark.createDataFrame([("m.sql", "-- note\nALTER TABLE t DROP COLUMN a;\nalter table t alter column b set not null; SELECT 1;")], "path string, text string")
    got = [(r["kind"], r["table"], r["object_name"]) for r in schema.changes(schema.statements(files)).orderBy("ordinal").collect()]
    assert got == [("DROP_COLUMN", "t", "a"), ("ALTER_NULLABILITY", "t", "b"), ("UNSUPPORTED_SCHEMA_CHANGE", "UNKNOWN", None)]


def test_routes(spark):
    df = spark.createDataFrame([("/u/{name}/", "http://h:80/u/7"), ("/u", "/u/7")], "a string, b string")
    got = [r[0] for r in df.select(text.route_matches(text.route(F.col("a")), text.route(F.col("b")))).collect()]
    assert got == [True, False]


def test_empty_inputs(spark):
    none = edges(spark)
    assert graph.blast_radius(none, start(spark, "a")).count() == 0
    assert rollback.status(spark.createDataFrame([], "status string")).collect()[0]["status"] == "SAFE"
    empty = spark.createDataFrame([], "path string, sha256 string")
    assert snapshots.difference(empty, empty).count() == 0


SCRIPT = """-- note; not a statement
ALTER TABLE t DROP COLUMN a, DROP COLUMN b;
DROP INDEX i; DROP VIEW IF EXISTS v; ALTER TABLE t DROP c; ALTER TABLE IF EXISTS only s.t ADD x numeric(10, 2) DEFAULT f(1, 2), add column "weird col" varchar(3) DEFAULT 'x;y, z' NOT NULL,
 ALTER y SET NOT NULL, ALTER COLUMN z TYPE double precision USING z::double precision, ADD CONSTRAINT k CHECK (a > 0, b), ALTER q DROP NOT NULL, ALTER q SET DEFAULT 1;
/* block ; 'comment */ alter table "my; table" alter "Col A" set data type timestamp with time zone; SELECT 1;
ALTER TABLE t RENAME TO u; ALTER TABLE t ADD COLUMN IF NOT EXISTS key2 bool; ALTER TABLE t DROP COLUMN IF EXISTS primary_id CASCADE"""


def test_actions_of_statements(spark):
    files = spark.createDataFrame([("m", SCRIPT), ("n", None), ("e", " ;; "), ("u", "DROP TABLE 'unclosed")], "path string, text string")
    rows = schema.changes(schema.statements(files)).filter("path = 'm'").orderBy("ordinal", "action").collect()
    unsupported = ("UNSUPPORTED_SCHEMA_CHANGE", "t", None, None)
    assert [(r["kind"], r["table"], r["object_name"], r["after"]) for r in rows] == [
        ("DROP_COLUMN", "t", "a", None), ("DROP_COLUMN", "t", "b", None), ("DROP_TABLE", "i", None, None), ("DROP_TABLE", "v", None, None), ("DROP_COLUMN", "t", "c", None),
        ("ADD_COLUMN", "t", "x", "DECIMAL"), ("ADD_COLUMN", "t", "weird col", "VARCHAR"), ("ALTER_NULLABILITY", "t", "y", None), ("ALTER_COLUMN_TYPE", "t", "z", "DOUBLE"), unsupported, unsupported, unsupported,
        ("ALTER_COLUMN_TYPE", "my; table", "Col A", "TIMESTAMPTZ"), ("UNSUPPORTED_SCHEMA_CHANGE", "UNKNOWN", None, None), unsupported, ("ADD_COLUMN", "t", "key2", "BOOLEAN"), ("DROP_COLUMN", "t", "primary_id", None),
    ]
    assert schema.statements(files).filter("path IN ('n', 'e')").count() == 0


def test_long_scripts(spark):
    columns = ", ".join(f"c{i} decimal(10, {i % 9}) default f({i}, '{i},')" for i in range(20_000))
    drops = ", ".join(f"DROP COLUMN c{i}" for i in range(20_000))
    files = spark.createDataFrame([("a", f"CREATE TABLE t ({columns}); " + "(" * 50_000 + ";"), ("b", f"ALTER TABLE t {drops}; " + "/* ' */ ; " * 20_000)], "path string, text string")
    assert schema.create_tables(schema.statements(files)).filter("data_type = 'DECIMAL'").count() == 20_000
    assert schema.changes(schema.statements(files)).filter("kind = 'DROP_COLUMN'").count() == 20_000


def test_evolution_equals_a_fold(spark):
    """Random histories, one change after the other."""
    rng = random.Random(2)
    old = {("t", "a"): ("INT", True), ("t", "b"): ("TEXT", False), ("u", "a"): ("INT", True)}
    for _ in range(6):
        history = [(i, *rng.choice([("ADD_COLUMN", "t"), ("DROP_COLUMN", "t"), ("ALTER_COLUMN_TYPE", "t"), ("ALTER_NULLABILITY", "t"), ("DROP_TABLE", "t"), ("ADD_TABLE", "t"), ("ADD_COLUMN", "u"), ("DROP_TABLE", "u"), ("ADD_TABLE", "v"), ("ADD_COLUMN", "v")]), rng.choice("abc"), rng.choice(["X", "Y", None])) for i in range(14)]
        tables = {t: {} for t, _ in old}
        for (t, c), v in old.items():
            tables[t][c] = v
        for _, kind, t, c, after in history:
            if kind == "DROP_TABLE":
                tables.pop(t, None)
            elif kind == "ADD_TABLE":
                tables.setdefault(t, {})
            elif t in tables:
                cols = tables[t]
                if kind == "DROP_COLUMN":
                    cols.pop(c, None)
                elif kind == "ADD_COLUMN":
                    cols[c] = (after or "UNKNOWN", True)
                elif c in cols:
                    cols[c] = (after or cols[c][0], cols[c][1]) if kind == "ALTER_COLUMN_TYPE" else (cols[c][0], False)
        rows = [(i, k, t, None if k.endswith("TABLE") else c, f if k in ("ADD_COLUMN", "ALTER_COLUMN_TYPE") else None) for i, k, t, c, f in history]
        changed = spark.createDataFrame(rows, "ordinal long, kind string, table string, object_name string, after string")
        columns = spark.createDataFrame([(*k, *v) for k, v in old.items()], "table string, column string, data_type string, nullable boolean")
        got = {(r["table"], r["column"]): (r["data_type"], r["nullable"]) for r in schema.evolve(columns, changed).collect()}
        assert got == {(t, c): v for t, cols in tables.items() for c, v in cols.items()}


def test_impact_over_cycles(spark):
    rng = random.Random(4)
    names = [f"t{i % 4}.c{i}" for i in range(12)] + [f"s{i}" for i in range(20)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(45)}
    e = edges(spark, *[(x, y, "CALL") for x, y in pairs])
    reach = {n: {n} for n in names}
    for _ in names:
        for x, y in pairs:
            for r in reach.values():
                if x in r:
                    r.add(y)
    entities = spark.createDataFrame([(n,) for n in names], "entity_id string")
    got = {r["node"]: r["component"] for r in graph.strong_components(e, entities.withColumnRenamed("entity_id", "node")).collect()}
    assert got == {n: min(m for m in reach[n] if n in reach[m]) for n in names}
    objects = ["t0.c0", "t1.zz", "t9.c1", "t3"]
    counts = {r["object"]: (r["n_entities"], r["n_affected"]) for r in graph.impact(spark.createDataFrame([(x,) for x in objects], "object string"), entities, e).collect()}
    named = {o: [o] if o in names else [n for n in names if n.split(".")[0] == o.split(".")[0]] for o in objects}
    assert counts == {o: (len(ns), len(set().union(*[reach[n] for n in ns]))) for o, ns in named.items()}


def test_what_texts_state(spark):
    text = "Finding f:12 (DROP_COLUMN) and rollback:RB-X:t.c touch user:7 and t1.c2; risk 45, 3 more, verdict DO_NOT_DEPLOY by policy:RISK_THRESHOLD_70 at 0.5."
    got = spark.createDataFrame([(text,), (None,)], "t string").select(evidence.stated(F.col("t")).alias("s")).collect()
    assert set(got[0]["s"]) == {"f:12", "DROP_COLUMN", "rollback:RB-X:t.c", "user:7", "t1.c2", "45", "3", "DO_NOT_DEPLOY", "policy:RISK_THRESHOLD_70", "0.5"}
