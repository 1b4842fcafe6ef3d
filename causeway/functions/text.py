"""Redaction, routes, names and stable identities, as expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of secrets that reports must not show.
SQL_SECRETS = (
    r"(?i)(password\s*=\s*['\"][^'\"]+['\"])",
    r"(?i)(api[_-]?key\s*=\s*['\"][^'\"]+['\"])",
    r"(?i)(token\s*=\s*['\"][^'\"]+['\"])",
    r"(?i)(secret\s*=\s*['\"][^'\"]+['\"])",
    r"(?i)(['\"](?:password|token|secret|api_key|api-key)['\"]\s*:\s*['\"][^'\"]+['\"])",
    r"(?i)(super-secret-token)",
)
URL_SECRET = r"(?i)((?:api[_-]?key|secret|password|token|authorization|credential)=)[^&\s]+"
TOKEN_SECRET = r"(?i)(bearer\s+[A-Za-z0-9._~+/=-]+|AKIA[0-9A-Z]{16}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9._-]+\.[A-Za-z0-9._-]+)"
CONNECTION = r"(?i)\b(?:postgres|mysql|mongodb(?:\+srv)?|redis)://[^\s]+"
# Words of a host that are written in capitals.
ACRONYMS = ("api", "db", "id", "url", "http", "https", "sql", "ui", "io", "rpc")


def redact_sql(text: Column) -> Column:
    for pattern in SQL_SECRETS:
        text = F.regexp_replace(text, pattern, "<redacted>")
    return text


def redact_url(text: Column) -> Column:
    return F.regexp_replace(text, URL_SECRET, "$1<redacted>")


def redact_tokens(text: Column) -> Column:
    return redact_connection(F.regexp_replace(text, TOKEN_SECRET, "[REDACTED]"))


def redact_connection(text: Column) -> Column:
    return F.regexp_replace(text, CONNECTION, "[REDACTED]")


def host(value: Column) -> Column:
    """Lower-case host without scheme and port."""
    plain = F.replace(F.replace(F.trim(value), F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    return F.lower(F.substring_index(plain, ":", 1))


def method(value: Column) -> Column:
    return F.upper(F.trim(F.when(F.coalesce(value, F.lit("")) == "", "GET").otherwise(value)))


def route(value: Column) -> Column:
    """Path without scheme and host, parameters named {id}, no slash at the end."""
    plain = F.trim(value)
    rest = F.regexp_replace(plain, "^https?://", "")
    inner = F.when(plain.rlike("^https?://"), F.when(rest.contains("/"), F.regexp_replace(rest, "^[^/]*", "")).otherwise("/")).otherwise(plain)
    inner = F.when(inner.startswith("/"), inner).otherwise(F.concat(F.lit("/"), inner))
    inner = F.regexp_replace(F.regexp_replace(inner, r"\{[^}]+\}", "{id}"), "/+$", "")
    return F.when(inner == "", "/").otherwise(inner)


def route_matches(a: Column, b: Column) -> Column:
    """Normalized routes agree segment by segment; a parameter on either side fits anything."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: (p == q) | p.rlike(r"^\{.*\}$") | q.rlike(r"^\{.*\}$"))
    return (F.size(x) == F.size(y)) & F.when(F.size(x) == F.size(y), F.forall(same, lambda s: F.coalesce(s, F.lit(False)))).otherwise(False)


def service_of(url: Column) -> Column:
    """Host of a url without scheme and port; null if there is none."""
    rest = F.regexp_replace(F.trim(url), "^.*?https?://", "")
    name = F.trim(F.substring_index(F.substring_index(rest, "/", 1), ":", 1))
    return F.when(name != "", name)


def class_name(service: Column) -> Column:
    """Words of a host joined with capitals; known acronyms in capitals throughout."""
    words = F.filter(F.split(F.trim(service), r"[-_.\s]+"), lambda w: w != "")
    cased = F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))))
    return F.when(F.size(words) > 0, F.array_join(cased, ""))


def db_operation(value: Column) -> Column:
    op = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(op.isin("SELECT", "DB_READ"), "DB_READ").when(op.isin("INSERT", "UPDATE", "DELETE", "DB_WRITE"), "DB_WRITE").otherwise(op)


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def symbol_id(service: Column, path: Column, kind: Column, name: Column) -> Column:
    return F.concat(service, F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")), F.lit("::"), kind, F.lit("::"), name)


def schema_object(table: Column, name: Column) -> Column:
    return F.concat_ws(".", table, name)


# Keys of evidence whose values are never shown, and what marks a value that is not shown under any key.
SECRET_KEY = r"(?i)(password|token|secret|api[_-]?key|authorization|database_url)"
DECISION_MARKS, ROLLBACK_MARKS = ("Bearer ", "://"), ("Bearer ", "postgres://", "mysql://")


def redact_evidence(evidence: Column, marks: tuple[str, ...] = DECISION_MARKS) -> Column:
    """A map of strings without the values of secret keys and those that hold one of ``marks``; null values stay null."""
    def hidden(key: Column, value: Column) -> Column:
        test = key.rlike(SECRET_KEY)
        for mark in marks:
            test = test | F.coalesce(value.contains(mark), F.lit(False))
        return test

    return F.transform_values(evidence, lambda k, v: F.when(hidden(k, v), "[REDACTED]").otherwise(v))
