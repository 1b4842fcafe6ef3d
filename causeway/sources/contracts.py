"""API contracts in JSON as rows of operations, parameters and responses, as ``operators.contract`` compares them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The methods that make an operation.
METHODS = ("get", "put", "post", "delete", "patch", "head", "options")
_PARAMETERS = "array<struct<name string, `in` string, required boolean>>"


def _part(column: str, path: str, kind: str) -> Column:
    return F.from_json(F.get_json_object(column, path), kind)


def _operations(contracts: DataFrame) -> DataFrame:
    """``contract, path, method, operation, shared``: each operation as JSON, with the parameters of its whole path."""
    paths = contracts.select(F.col("path").alias("contract"), F.explode(_part("text", "$.paths", "map<string,map<string,string>>")).alias("path", "methods"))
    rows = paths.select("contract", "path", F.col("methods")["parameters"].alias("shared"), F.explode("methods").alias("m", "operation"))
    return rows.filter(F.lower("m").isin(*METHODS)).select("contract", "path", F.upper("m").alias("method"), "operation", "shared")


def operations(contracts: DataFrame) -> DataFrame:
    """``contract, path, method, operation_id, security`` of contracts (path, text)."""
    schemes = F.flatten(F.transform(_part("operation", "$.security", "array<map<string,string>>"), F.map_keys))
    return _operations(contracts).select("contract", "path", "method", F.get_json_object("operation", "$.operationId").alias("operation_id"), F.array_sort(F.array_distinct(F.coalesce(schemes, F.array().cast("array<string>")))).alias("security"))


def parameters(contracts: DataFrame) -> DataFrame:
    """``contract, path, method, name, location, required``; an operation's own parameter comes before one of its path with its name and place."""
    none = F.array().cast(_PARAMETERS)
    own = F.coalesce(_part("operation", "$.parameters", _PARAMETERS), none)
    rows = _operations(contracts).select("contract", "path", "method", own.alias("own"), F.coalesce(F.from_json("shared", _PARAMETERS), none).alias("shared"))
    rest = F.filter("shared", lambda p: ~F.exists("own", lambda o: (o["name"] == p["name"]) & (o["in"] == p["in"])))
    return rows.select("contract", "path", "method", F.explode(F.concat("own", rest)).alias("p")).select("contract", "path", "method", F.col("p.name").alias("name"), F.col("p.in").alias("location"), F.coalesce("p.required", F.lit(False)).alias("required"))


def responses(contracts: DataFrame) -> DataFrame:
    """``contract, path, method, status``."""
    return _operations(contracts).select("contract", "path", "method", F.explode(F.map_keys(_part("operation", "$.responses", "map<string,string>"))).alias("status"))


NODES = "contract string, path string, method string, direction string, location string, names array<string>, type string, required boolean, enum array<string>"


def _resolved(value: object, components: dict, seen: frozenset) -> object:
    """``value`` with references into ``components`` replaced by what they name; one that is met again within itself stays."""
    if isinstance(value, list):
        return [_resolved(x, components, seen) for x in value]
    if not isinstance(value, dict):
        return value
    ref, found = value.get("$ref"), None
    if isinstance(ref, str) and ref.startswith("#/components/") and ref not in seen:
        found, seen = components, seen | {ref}
        for name in ref.split("/")[2:]:
            found = found.get(name) if isinstance(found, dict) else None
    own = {k: _resolved(v, components, seen) for k, v in value.items() if not (k == "$ref" and isinstance(found, dict))}
    return {**_resolved(found, components, seen), **own} if isinstance(found, dict) else own


def _body(part: object) -> object:
    """The schema of the first media type that has one."""
    content = part.get("content") if isinstance(part, dict) else None
    return next((c["schema"] for _, c in sorted((content or {}).items()) if isinstance(c, dict) and c.get("schema") is not None), None)


def _nodes(schema: object, names: list[str], required: bool) -> Iterator[tuple]:
    if not isinstance(schema, dict):
        return
    yield ".".join(names), names, schema.get("type"), required, [v if isinstance(v, str) else json.dumps(v) for v in schema.get("enum", [])]
    needed = schema.get("required") or []
    for name, part in (schema.get("properties") or {}).items():
        yield from _nodes(part, [*names, name], name in needed)
    yield from _nodes(schema.get("items"), [*names, "[]"], False)


#: Nodes that a task hands on at once.
HANDED = 20_000


def schema_nodes(contracts: DataFrame) -> DataFrame:
    """Nodes of the request and response schemas of contracts (path, text), as ``operators.contract.schema_nodes`` compares them.

    ``names`` (and ``location``, which joins them by dots) lead down to a node; those of responses start with their status. References within the contract are followed, but not into themselves. A contract
    is one row, of which a task holds one at a time as objects, and ``HANDED`` nodes or those of one more operation; a text that is no JSON object has no nodes.
    """

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for contract, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    whole = json.loads(text or "")
                except ValueError:
                    continue
                if not isinstance(whole, dict):
                    continue
                parts = whole.get("components") if isinstance(whole.get("components"), dict) else {}
                for path, methods in (whole.get("paths") or {}).items():
                    for method, operation in methods.items() if isinstance(methods, dict) else ():
                        if method.lower() not in METHODS or not isinstance(operation, dict):
                            continue
                        found = _resolved({k: operation.get(k) or {} for k in ("requestBody", "responses")}, parts, frozenset())
                        of = [("REQUEST", [], found["requestBody"])]
                        of += [("RESPONSE", [str(status)], r) for status, r in found["responses"].items()] if isinstance(found["responses"], dict) else []
                        rows += [(contract, path, method.upper(), side, *node) for side, at, part in of for node in _nodes(_body(part), at, False)]
                        if len(rows) >= HANDED:
                            yield table(rows)
                            rows = []
        if rows:
            yield table(rows)

    return contracts.select("path", "text").mapInPandas(flat, NODES)
