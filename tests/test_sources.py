"""Sources and sinks on small folders."""

import hashlib
import json
import zipfile

from causeway.operators import contract, resolution, schema, snapshots
from causeway.sources import archives, contracts, files, sinks, store
from pyspark.sql import functions as F


def test_scan_and_manifest(spark, tmp_path):
    for name, content in {"app/a.py": "x = 1", "node_modules/b/c.js": "", "db/migrations/001.sql": "DROP TABLE old;", "schema.sql": "", "db/late/schema.sql": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    found = files.scan(spark, str(tmp_path))
    got = {r["path"]: (r["class"], r["language"]) for r in files.manifest(found).collect()}
    assert set(got) == {"app/a.py", "db/migrations/001.sql", "schema.sql", "db/late/schema.sql"} and got["app/a.py"] == ("semantic", "python")
    assert tuple(snapshots.pick_files(found).collect()[0]) == ("db/late/schema.sql", "db/migrations/001.sql")
    assert [r["kind"] for r in schema.changes(schema.statements(files.texts(found, ".sql"))).collect()] == ["DROP_TABLE"]
    none = found.filter("false")
    assert tuple(snapshots.pick_files(none).collect()[0]) == (None, None)


def test_archives(spark, tmp_path):
    for name, entries in {"good.zip": {"a/b.py": "1", "c.txt": ""}, "bad.zip": {"../up": "1", "ok": "2"}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for path, content in entries.items():
                z.writestr(path, content)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = sorted((r["path"], bytes(r["content"])) for r in archives.extract(spark, str(tmp_path)).collect())
    assert got == [("a/b.py", b"1"), ("c.txt", b"")]


def test_contracts(spark):
    def document(required, **more):
        parameter = {"name": "q", "in": "query", "required": required}
        return json.dumps({"openapi": "3.0.0", "paths": {"/u": {"parameters": [parameter], "get": {"operationId": "u", "parameters": [{"name": "k", "in": "header"}], "responses": {"200": {}}, "security": [{"key": []}]}, "x-note": "n"}, **more}})

    docs = spark.createDataFrame([("old", document(False, **{"/v": {"post": {}}})), ("new", document(True))], "path string, text string")
    old, new = docs.filter("path = 'old'"), docs.filter("path = 'new'")
    assert [tuple(r) for r in contracts.operations(new).collect()] == [("new", "/u", "GET", "u", ["key"])]
    assert sorted((r["name"], r["location"], r["required"]) for r in contracts.parameters(new).collect()) == [("k", "header", False), ("q", "query", True)]
    assert [r["status"] for r in contracts.responses(old).collect()] == ["200"]
    assert [r["rule_id"] for r in contract.parameters(contracts.parameters(old), contracts.parameters(new)).collect()] == ["API-REQUIRED-ADDED"]
    assert [(r["rule_id"], r["path"]) for r in contract.endpoints(contracts.operations(old), contracts.operations(new)).select("rule_id", "path").collect()] == [("API-ENDPOINT-REMOVED", "/v")]


def test_digest_ignores_order(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("b"))
    one, two = (sinks.digest(x).collect()[0][0] for x in (df, df.repartition(5, "b").select("b", "id")))
    assert one == two != sinks.digest(df.filter("id < 99")).collect()[0][0]
    sinks.write_canonical(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 100


def test_resolution_levels(spark):
    refs = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "name string")
    first, second = (spark.createDataFrame([(x,) for x in xs], "key string") for xs in ("a", "abb"))
    got = {r["name"]: (r["level"], r["state"]) for r in resolution.resolve(refs, [(F.col("name"), first), (F.col("name"), second)]).collect()}
    assert got == {"a": (1, "RESOLVED"), "b": (2, "AMBIGUOUS"), "c": (0, "UNRESOLVED"), None: (0, "UNRESOLVED")}


def test_refused_archives_have_a_row(spark, tmp_path):
    for name, size in (("small", 10), ("large", 5000)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("a.txt", b"x" * size)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    rows = archives.unpack(spark, str(tmp_path), max_file=1000, max_archive=4000).collect()
    got = {r["archive"].rsplit("/", 1)[1]: (r["path"], r["content"] and len(r["content"]), r["refused"]) for r in rows}
    assert got == {"small.zip": ("a.txt", 10, None), "large.zip": (None, None, "ARCHIVE_TOO_LARGE"), "broken.zip": (None, None, "NOT_AN_ARCHIVE")}


def test_entries_that_lie_do_not_end_the_job(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "lies.zip", "w") as z:
        z.writestr("a.txt", b"x" * 50)
        z.writestr("b.txt", b"y" * 20)
    raw = bytearray((tmp_path / "lies.zip").read_bytes())
    raw[raw.index(b"x" * 50)] = 0
    (tmp_path / "lies.zip").write_bytes(bytes(raw))
    rows = archives.unpack(spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["refused"]) for r in rows) == [("a.txt", "UNREADABLE"), ("b.txt", None)]


def test_schema_nodes_follow_references(spark):
    pet = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "enum": ["a", "b"]}, "mother": {"$ref": "#/components/schemas/Pet"}, "tags": {"type": "array", "items": {"type": "string"}}}}
    body = {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Pet"}}}}
    whole = {"components": {"schemas": {"Pet": pet}}, "paths": {"/p": {"post": {"requestBody": body, "responses": {"200": body}}}}}
    docs = spark.createDataFrame([("a.json", json.dumps(whole)), ("b.json", "no json"), ("c.json", None)], "path string, text string")
    got = {(r["direction"], r["location"]): (r["type"], r["required"], r["enum"]) for r in contracts.schema_nodes(docs).collect()}
    want = {"": ("object", False, []), "name": ("string", True, ["a", "b"]), "mother": (None, False, []), "tags": ("array", False, []), "tags.[]": ("string", False, [])}
    assert got == {(d, f"{at}.{k}".strip(".")): v for d, at in (("REQUEST", ""), ("RESPONSE", "200")) for k, v in want.items()}


def test_archives_beyond_a_cell_and_of_many_entries(spark, tmp_path):
    # the first bytes are a hole in the file, so that it is larger than any cell and takes no room
    with open(tmp_path / "huge.zip", "wb") as f:
        f.seek(2_300_000_000)
        with zipfile.ZipFile(f, "w") as z:
            z.writestr("deep/a.txt", b"x" * 10)
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(100_000):
            z.writestr(f"f{i}", str(i))
    most = {"max_archive": 1 << 40, "max_entries": 200_000}
    rows = archives.unpack(spark, str(tmp_path), **most)
    n = rows.filter("refused IS NULL AND archive LIKE '%many.zip'").agg(F.count("*"), F.sum(F.decode("content", "UTF-8").cast("long"))).first()
    assert tuple(n) == (100_000, sum(range(100_000)))
    assert [(r["path"], len(r["content"])) for r in rows.filter("archive LIKE '%huge.zip'").collect()] == [("deep/a.txt", 10)]
    verdicts = {r["archive"].rsplit("/", 1)[1]: r["refused"] for r in archives.unpack(spark, str(tmp_path)).collect()}
    assert verdicts == {"huge.zip": "ARCHIVE_TOO_LARGE", "many.zip": "TOO_MANY"}


def test_entry_that_holds_more_than_it_may(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 5000)
    raw = (tmp_path / "a.zip").read_bytes().replace((5000).to_bytes(4, "little"), (50).to_bytes(4, "little"))
    (tmp_path / "a.zip").write_bytes(raw)
    assert [r["refused"] for r in archives.unpack(spark, str(tmp_path), max_file=1000).collect()][0] in ("TOO_LARGE", "UNREADABLE")


def test_written_archives_are_the_same_each_time(spark, tmp_path):
    files = spark.createDataFrame([("one.zip", f"d/{i:03}.txt", f"text {i}".encode()) for i in range(300)] + [("two.zip", "é", b"x"), ("two.zip", "empty", None)], "archive string, path string, content binary")
    new = spark.createDataFrame([("one.zip", "d/007.txt", b"replaced"), ("one.zip", "not there", b"x")], files.schema)
    made = [sorted(tuple(r) for r in archives.write_archives(archives.replaced(files.repartition(n), new), str(tmp_path / f"out{n}")).collect()) for n in (1, 7)]
    assert made[0] == made[1] and [r[:2] for r in made[0]] == [("one.zip", 300), ("two.zip", 2)]
    a, b = ((tmp_path / f"out{n}" / "one.zip").read_bytes() for n in (1, 7))
    assert a == b and len(a) == made[0][0][2] and hashlib.sha256(a).hexdigest() == made[0][0][3]
    with zipfile.ZipFile(tmp_path / "out1" / "one.zip") as z:
        assert z.namelist() == sorted(z.namelist()) and z.read("d/007.txt") == b"replaced" and z.read("d/008.txt") == b"text 8"
    back = archives.extract(spark, str(tmp_path / "out7"))
    assert back.count() == 302


def test_folders_are_listed_in_tasks(spark, tmp_path):
    for name, content in {"a/b/c d.txt": "1", "a/e%20.txt": "", "f": "22", "a/b/g/h": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "none").mkdir()
    assert sorted((r["path"], r["size"]) for r in store.list_files(spark, str(tmp_path)).collect()) == [("a/b/c d.txt", 1), ("a/b/g/h", 0), ("a/e%20.txt", 0), ("f", 2)]
    assert sorted((r["path"], bytes(r["content"])) for r in files.scan(spark, f"file://{tmp_path}").collect()) == [("a/b/c d.txt", b"1"), ("a/b/g/h", b""), ("a/e%20.txt", b""), ("f", b"22")]


def test_ascii_json_equals_the_standard_library(spark):
    values = ["plain", "é ß \u00a0", "日本", "💡𐀀\U0010ffff", "\" \\ \n\t\r", "", None]
    rows = spark.createDataFrame([(i, v, None) for i, v in enumerate(values)], "b int, a string, c string")
    got = {r["b"]: r["j"] for r in rows.select("b", sinks.ascii_json(sinks.sorted_struct(rows)).alias("j")).collect()}
    assert got == {i: json.dumps({"a": v, "b": i, "c": None}, sort_keys=True, separators=(",", ":"), ensure_ascii=True) for i, v in enumerate(values)}


def test_digest_tree_grows(spark, monkeypatch):
    hashes = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    small = sinks.digest_of(hashes).first()[0]
    monkeypatch.setattr(sinks, "FAN", 0.01)
    deep = sinks.digest_of(hashes).first()[0]
    assert small != deep == sinks.digest_of(hashes.repartition(5)).first()[0]


def test_graph_document(spark):
    entities = spark.createDataFrame([("b", "é"), ("a", "x")], "entity_id string, kind string")
    edges = spark.createDataFrame([("b", "a", "CALL"), ("a", "b", "IMPORT"), ("a", "b", "CALL")], "source string, target string, kind string")
    rows = sorted((r["section"], r["place"], r["line"]) for r in sinks.graph_document(entities, edges).collect())
    assert rows == [("edges", 0, '{"kind":"CALL","source":"a","target":"b"}'), ("edges", 1, '{"kind":"IMPORT","source":"a","target":"b"}'), ("edges", 2, '{"kind":"CALL","source":"b","target":"a"}'), ("nodes", 0, '{"entity_id":"a","kind":"x"}'), ("nodes", 1, '{"entity_id":"b","kind":"\\u00e9"}')]


def test_property_names_with_dots(spark):
    def document(*names):
        schema = {"type": "object", "properties": {n: {"type": "string"} for n in names}}
        return json.dumps({"paths": {"/p": {"get": {"responses": {"200": {"content": {"application/json": {"schema": schema}}}}}}}})

    nodes = [contracts.schema_nodes(spark.createDataFrame([("c", document(*n))], "path string, text string")) for n in (("a.b", "a"), ("a",))]
    found = contract.schema_nodes(*nodes).select("rule_id", "location", "compatibility").collect()
    assert [tuple(r) for r in found] == [("API-PROPERTY-REMOVED", "RESPONSE.200.a.b", "BREAKING")]
