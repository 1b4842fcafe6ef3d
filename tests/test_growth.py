"""Work that grows with the input and not with the square of a group's size."""

import json
import random

import pandas as pd
import pyarrow as pa

from causeway.operators import graph


def _edges(spark, *rows):
    return spark.createDataFrame(rows, "source string, target string, kind string")


def _counting(monkeypatch):
    """Numbers of rows that ``graph`` writes, by label."""
    written, write = {}, graph.materialize

    def counted(df, label):
        out = write(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    return written


def test_impact_of_objects_of_one_table(spark, monkeypatch):
    written, n = _counting(monkeypatch), 200
    columns, clients = [f"t.c{i}" for i in range(n)], [f"client{i}" for i in range(n)]
    e = _edges(spark, *[(c, "svc", "DB_READ") for c in columns], ("svc", "api", "HTTP_CALL"), ("api", "svc", "API_CONSUMES"), *[("api", c, "API_CONSUMES") for c in clients])
    entities = spark.createDataFrame([(x,) for x in [*columns, *clients, "svc", "api"]], "entity_id string")
    objects = [*columns, *[f"t.gone{i}" for i in range(n)], "client3", "none"]
    got = {r["object"]: (r["n_entities"], r["n_affected"]) for r in graph.impact(spark.createDataFrame([(x,) for x in objects], "object string"), entities, e).collect()}
    assert got == {**{c: (1, n + 3) for c in columns}, **{f"t.gone{i}": (n, 2 * n + 2) for i in range(n)}, "client3": (1, 1), "none": (0, 0)}
    assert max(written.values()) <= 8 * n


def test_impact_counts_pendants_once(spark):
    # t names a pendant, the end of a chain of them and what leads to both
    e = _edges(spark, ("t.a", "t.b", "CALL"), ("t.b", "t.c", "CALL"), ("t.b", "x", "CALL"), ("t.a", "y", "CALL"), ("z", "t.a", "CALL"))
    entities = spark.createDataFrame([(x,) for x in ("t.a", "t.b", "t.c", "x", "y", "z")], "entity_id string")
    got = {r["object"]: r["n_affected"] for r in graph.impact(spark.createDataFrame([(x,) for x in ("t.zz", "t.b", "t.c", "z")], "object string"), entities, e).collect()}
    assert got == {"t.zz": 5, "t.b": 3, "t.c": 1, "z": 6}


def test_nodes_on_no_cycle_stay_out_of_the_search(spark, monkeypatch):
    written, n = _counting(monkeypatch), 200
    e = _edges(spark, *[(f"c{i}", f"s{i % 3}", "DB_READ") for i in range(n)], ("s0", "s1", "CALL"), ("s1", "s0", "CALL"), ("s1", "s2", "CALL"), *[("s2", f"k{i}", "CALL") for i in range(n)])
    got = {r["node"]: r["component"] for r in graph.strong_components(e, spark.createDataFrame([("alone",)], "node string")).collect()}
    assert got == {**{f"c{i}": f"c{i}" for i in range(n)}, **{f"k{i}": f"k{i}" for i in range(n)}, "s0": "s0", "s1": "s0", "s2": "s2", "alone": "alone"}
    assert all(rows < n for label, rows in written.items() if label != "links")


def test_loosely_edited_copies_make_few_pairs(spark, monkeypatch):
    from causeway.llm import minhash

    rng, written, write = random.Random(3), {}, minhash.materialize

    def counted(df, label):
        out = write(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    # a group of copies whose edits make any two of them less similar than 0.8, and one copy that is nearer to the first
    original = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(80):
        at = rng.randrange(260)
        texts.append([*original[:at], *[f"e{i}x{k}" for k in range(40)], *original[at + 40 :]])
    texts.append([*texts[0][:-4], "near", "copy", "of", "it"])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    doc, hashes, weights = minhash.shingles(pa.array([t for _, t in rows]))
    sets = [(hashes[doc == i], weights[doc == i]) for i, _ in rows]
    near = {(i, j) for i, _ in rows for j in range(i) if minhash.similarity(*sets[i], *sets[j]) >= minhash.THRESHOLD}
    least = {i: i for i, _ in rows}
    for _ in rows:
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    assert (80, 0) in near and got == least
    assert written["more1"] <= 4 * len(rows) < len(rows) ** 2 / 10


def test_contracts_hand_on_nodes_in_parts(spark, monkeypatch):
    from causeway.sources import contracts

    seen = []

    class Handed:
        """Runs the function of ``mapInPandas`` here and looks at what it yields."""

        def select(self, *columns):
            return self

        def mapInPandas(self, flat, schema):
            seen.extend(flat(iter([pd.DataFrame({"path": ["a.json", "b.json"], "text": [text, text]})])))

    operation = {"post": {"requestBody": {"content": {"application/json": {"schema": {"type": "object", "properties": {"v": {"type": "string"}}}}}}}}
    text = json.dumps({"paths": {f"/c/{i}": operation for i in range(50)}})
    monkeypatch.setattr(contracts, "HANDED", 10, raising=False)
    contracts.schema_nodes(Handed())
    assert sum(len(x) for x in seen) == 200 and max(len(x) for x in seen) <= 11


def test_differing_contracts_are_not_broadcast(spark):
    from causeway.operators import contract

    old, new = (spark.createDataFrame([(f"/c/{i}", "POST") for i in r], "path string, method string") for r in (range(5), range(2, 7)))
    found = contract.endpoints(old, new)
    assert sorted((r["path"], r["rule_id"]) for r in found.collect()) == [("/c/0", "API-ENDPOINT-REMOVED"), ("/c/1", "API-ENDPOINT-REMOVED"), ("/c/5", "API-ENDPOINT-ADDED"), ("/c/6", "API-ENDPOINT-ADDED")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _same_rows(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_adjacency_is_dealt_once_and_hubs_by_bucket(spark, monkeypatch):
    rows = [("hub", f"n{i}", "CALL") for i in range(300)] + [(f"s{i}", f"n{i % 7}", "CALL") for i in range(50)]
    once, twice = _edges(spark, *rows), _edges(spark, *rows, *rows[::2])
    plain = graph.adjacency_digest(once)
    found = graph.adjacency_digest(twice, 4, repeats=True)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(source#") == 3  # one of sources, two of hubs
    assert _same_rows(found, plain)
    monkeypatch.setattr(graph, "HUB", 100)
    assert _same_rows(graph.adjacency_digest(twice, 4, repeats=True), plain)


def test_statements_of_parts_are_dealt_to_tasks(spark, monkeypatch):
    from causeway.plans import adapters as a

    t = a.Tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(a, "STATEMENTS", 50, raising=False)
    for made in (a.migration, a.create_statements, a.scripts, a.quoted_tables):
        assert made(t).rdd.getNumPartitions() == 1 + t.part.count() // 50


def test_depths_are_worked_out_at_parentheses_alone(spark, monkeypatch):
    from causeway.operators import statements
    from pyspark.sql import functions as F

    line = "CREATE TABLE x ( a int , b DECIMAL ( 1 , ( 2 ) ) UNIQUE , c " + "word " * 500 + ")"
    shown = spark.range(1).select(statements.runs(F.lit(line)).alias("r")).select(F.size("r"), statements.outside(F.slice("r", 3, 9)))
    assert shown.first() == (12, "a int , b DECIMAL UNIQUE , c " + ("word " * 500).strip())
    stmts = spark.createDataFrame([('create table x (a int, "b,\n(c" text not null, d numeric(1, (2)))',)], "statement string")
    assert [(r["column"], r["data_type"]) for r in statements.create_tables(stmts).collect()] == [("a", "INT"), ("b,\n(c", "TEXT"), ("d", "DECIMAL")]


def test_edges_are_dealt_in_proportion_to_the_tables(spark, monkeypatch):
    from causeway import catalog, scenarios
    from causeway.plans import adapters as a

    t = a.Tables(spark, "/root/testdata/sf0.001")
    before = {q: q(t).collect() for q in (catalog.graph_validate_duplicates, catalog.graph_validate_dangling, catalog.impact_score, catalog.parallel_edge_collapse, scenarios.convergent_pairs)}
    monkeypatch.setattr(a, "LINES", 200, raising=False)
    n = 1 + (t.lineitem.count() + t.orders.count()) // 200
    for q, rows in before.items():
        found = q(t)
        assert f", {n}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString(), q.__name__
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows))


def test_places_are_given_without_dealing_again(spark, monkeypatch):
    from causeway.operators import decision
    from pyspark.sql import functions as F

    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 > 0, (F.col("id") * 37) % 101).alias("v"), "id")
    found = decision.numbered(rows, ["g"], [F.asc("v"), F.desc("id")])
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    for g in range(3):
        want = sorted((r for r in rows.collect() if r["g"] == g), key=lambda r: (r["v"] is not None, r["v"] or 0, -r["id"]))
        assert [r["id"] for r in found.filter(F.col("g") == g).orderBy("place").collect()] == [r["id"] for r in want]
        assert sorted(r["place"] for r in found.filter(F.col("g") == g).collect()) == list(range(len(want)))
