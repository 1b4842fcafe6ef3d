"""Reads statements of migrations and schemas: scripts into statements, ALTER into actions, CREATE TABLE into columns.

A script is an array of segments (plain text, quoted text, comments, semicolons), a statement an array of tokens; the depth of
parentheses is a running value over its tokens. Quoted text never ends a statement, opens a comment or separates columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.arrays import let, running

_QUOTED = r"""'[^']*+'|"[^"]*+"|`[^`]*+`"""
_COMMENT = r"--[^\n]*+|/\*(?s:.*?)\*/"
SEGMENT = rf"{_QUOTED}|{_COMMENT}|;|[^'\"`;/-]++|."
TOKEN = rf"{_QUOTED}|[\w$]++|\S"
#: A name in the form of ``tokens``: \x01 and hexadecimal digits for a quoted one.
ID = r"(?:\x01[0-9A-F]*+|[\p{L}_][\w$]*+)"
#: A name of a table, of which the last part counts.
PATH = rf"(?:{ID} \. )*+({ID})"
# Words that start a constraint and not a column, and words that follow a column's name where it has no type.
CONSTRAINTS = "PRIMARY|FOREIGN|UNIQUE|CHECK|CONSTRAINT|KEY|INDEX|EXCLUDE|PARTITION|LIKE|PERIOD"
UNTYPED = "PRIMARY|NOT|NULL|UNIQUE|DEFAULT|REFERENCES|CHECK|COLLATE|GENERATED|CONSTRAINT"
# Spellings of types and the names under which they are known.
TYPES = {
    "BOOL": "BOOLEAN", "BYTE": "TINYINT", "SHORT": "SMALLINT", "INT2": "SMALLINT", "INTEGER": "INT", "INT4": "INT", "INT8": "BIGINT", "LONG": "BIGINT",
    "DEC": "DECIMAL", "NUMERIC": "DECIMAL", "FIXED": "DECIMAL", "REAL": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE", "CHARACTER": "CHAR", "VARCHAR2": "VARCHAR",
    "STR": "TEXT", "STRING": "TEXT", "CLOB": "TEXT", "LONGVARCHAR": "TEXT", "BLOB": "VARBINARY", "BYTEA": "VARBINARY",
}


def statements(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per statement of ``files`` (path, text), with its place; comments and empty statements go. A null text has no statement."""

    def plain(s: Column) -> Column:
        blank = F.when(s.rlike(r"^(?:--|/\*)"), " ").when(s == ";", "\x00")
        return blank.when(s.rlike("^['\"`]."), s).otherwise(F.regexp_replace(s, r"\s+", " "))

    segments = F.regexp_extract_all(F.replace(F.col(text), F.lit("\x00"), F.lit(" ")), F.lit(SEGMENT), F.lit(0))
    parts = files.select("path", F.posexplode(F.split(F.array_join(F.transform(segments, plain), ""), "\x00")).alias("ordinal", "s"))
    return parts.select("path", "ordinal", F.trim("s").alias("statement")).filter("statement <> ''")


def tokens(statement: Column) -> Column:
    """The tokens of a statement: words, single signs, ``''`` for a string, and quoted names in a form that has no signs."""

    def masked(x: Column) -> Column:
        name = F.concat(F.lit("\x01"), F.hex(F.encode(F.substring(x, F.lit(2), F.length(x) - 2), "UTF-8")))
        return F.when(x.rlike("^'[^']*'$"), "''").when(x.rlike("(?s)^[\"`].*[\"`]$"), name).otherwise(x)

    # a line break within a quoted name would hide it from the patterns
    return F.transform(F.regexp_extract_all(F.replace(statement, F.lit("\x01"), F.lit(" ")), F.lit(TOKEN), F.lit(0)), masked)


def named(name: Column) -> Column:
    """A name as it was written, without quotes."""
    return F.when(name.startswith("\x01"), F.decode(F.unhex(F.substring(name, F.lit(2), F.length(name))), "UTF-8")).otherwise(name)


def depths(toks: Column) -> Column:
    """For each token: how many parentheses are open after it."""
    step = F.transform(toks, lambda t: F.when(t == "(", 1).when(t == ")", -1).otherwise(0))
    return running(step, F.lit(0), lambda a, b: a + b)


def runs(line: Column) -> Column:
    """Tokens joined by spaces, cut at parentheses: depths change there alone, so that far fewer than all tokens are gone through."""
    return F.regexp_extract_all(line, F.lit("[()]|[^()]++"), F.lit(0))


def outside(pieces: Column) -> Column:
    """What stands outside of all parentheses of ``pieces`` (as by ``runs``), its tokens joined by spaces."""
    kept = let(pieces, lambda t: let(depths(t), lambda d: F.array_join(F.filter(t, lambda x, i: (F.get(d, i) == 0) & (x != ")")), " ")))
    return F.trim(F.regexp_replace(kept, " +", " "))


def at_top(flat: Column) -> Column:
    """array<string>: the stretches of ``flat`` (as by ``outside``) between commas."""
    return F.transform(F.split(flat, ","), lambda s: F.trim(s))


def type_name(spelled: Column) -> Column:
    """The type at the start of ``spelled`` (tokens outside of parentheses); UNKNOWN without one."""
    s = F.upper(spelled)
    word = F.regexp_extract(s, r"^[\p{L}_][\w$]*", 0)
    out = word
    for spelling, name in TYPES.items():
        out = F.when(word == spelling, name).otherwise(out)
    out = F.when(s.rlike("^DOUBLE PRECISION"), "DOUBLE").when(s.rlike("^CHAR(?:ACTER)? VARYING"), "VARCHAR").when(s.rlike("^TIMESTAMP WITH TIME ZONE"), "TIMESTAMPTZ").otherwise(out)
    return F.when(s.rlike(rf"^(?:{UNTYPED})\b") | (word == ""), "UNKNOWN").otherwise(out)


_DROP = rf"(?i)^DROP (?:MATERIALIZED |TEMPORARY )?(?:TABLE|VIEW|INDEX|SCHEMA|DATABASE|SEQUENCE|FUNCTION|PROCEDURE|COLUMN) (?:CONCURRENTLY )?(?:IF EXISTS )?{PATH}"
_ALTER = rf"(?i)^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?{PATH} (.+)$"
_ADD = rf"(?i)^ADD (?:COLUMN (?:IF NOT EXISTS )?|(?:IF NOT EXISTS )?(?!(?:{CONSTRAINTS}|COLUMN)\b))({ID}) (?!\W)(.+)$"
_DROP_COLUMN = rf"(?i)^DROP (?:COLUMN (?:IF EXISTS )?|(?:IF EXISTS )?(?!(?:{CONSTRAINTS}|COLUMN|TABLE|NOT|DEFAULT)\b))({ID})(?: CASCADE| RESTRICT)?$"
_DROP_TABLE = rf"(?i)^DROP TABLE (?:IF EXISTS )?{PATH}"
_NOT_NULL = rf"(?i)^ALTER (?:COLUMN )?({ID}) SET NOT NULL$"
_TYPE = rf"(?i)^ALTER (?:COLUMN )?({ID}) (?:SET DATA )?(?:TYPE )?(?!(?:SET|DROP|ADD|COMMENT|RESTART|RENAME|RESET)\b)([\p{{L}}_].*)$"


def actions(stmts: DataFrame) -> DataFrame:
    """``stmts`` (statement) with ``action`` (its place in the statement), kind, table, object_name and after: one row per action of an ALTER TABLE,
    one for any other statement.

    DROP of any object is DROP_TABLE; what no form fits is UNSUPPORTED_SCHEMA_CHANGE, of the table where it is an action. Of a name of
    several parts the last counts. A null statement has no row.
    """
    cut = stmts.filter("statement IS NOT NULL").withColumn("__t", tokens(F.col("statement")))
    cut = cut.withColumns({"__head": F.array_join(F.slice("__t", 1, 64), " "), "__line": F.array_join("__t", " ")})
    flat = F.when(F.col("__line").rlike("[()]"), outside(runs(F.col("__line")))).otherwise(F.col("__line"))
    cut = cut.select(*stmts.columns, "__head", flat.alias("__flat"))
    is_alter = F.col("__head").rlike(_ALTER)
    parts = cut.select(*stmts.columns, F.posexplode(F.when(is_alter, at_top(F.col("__flat"))).otherwise(F.array("__flat"))).alias("action", "__p"), F.when(is_alter, F.regexp_extract("__head", _ALTER, 1)).alias("__of"))
    # the first action stands behind the table's name
    parts = parts.withColumn("__a", F.when(F.col("__of").isNotNull() & (F.col("action") == 0), F.regexp_extract("__p", _ALTER, 2)).otherwise(F.col("__p")))
    a, of = F.col("__a"), F.col("__of")
    inside = of.isNotNull()
    forms = [
        (inside & a.rlike(_DROP_COLUMN), "DROP_COLUMN", of, F.regexp_extract(a, _DROP_COLUMN, 1), None),
        (inside & a.rlike(_DROP_TABLE), "DROP_TABLE", F.regexp_extract(a, _DROP_TABLE, 1), None, None),
        (inside & a.rlike(_NOT_NULL), "ALTER_NULLABILITY", of, F.regexp_extract(a, _NOT_NULL, 1), None),
        (inside & a.rlike(_TYPE), "ALTER_COLUMN_TYPE", of, F.regexp_extract(a, _TYPE, 1), type_name(F.regexp_extract(a, _TYPE, 2))),
        (inside & a.rlike(_ADD), "ADD_COLUMN", of, F.regexp_extract(a, _ADD, 1), type_name(F.regexp_extract(a, _ADD, 2))),
        (~inside & a.rlike(_DROP), "DROP_TABLE", F.regexp_extract(a, _DROP, 1), None, None),
    ]
    none = F.lit(None).cast("string")
    kind, table, name, after = F.lit("UNSUPPORTED_SCHEMA_CHANGE"), F.coalesce(of, F.lit("UNKNOWN")), none, none
    for hit, k, t, n, f in reversed(forms):
        kind, table = F.when(hit, k).otherwise(kind), F.when(hit, t).otherwise(table)
        name, after = F.when(hit, none if n is None else n).otherwise(name), F.when(hit, none if f is None else f).otherwise(after)
    return parts.select(*stmts.columns, "action", kind.alias("kind"), named(table).alias("table"), named(name).alias("object_name"), after.alias("after"))


_CREATE = rf"(?i)^CREATE (?:OR REPLACE )?(?:TEMP |TEMPORARY |UNLOGGED )?TABLE (?:IF NOT EXISTS )?{PATH} \("
_COLUMN = rf"(?i)^(?!(?:{CONSTRAINTS})\b)({ID}) (.+)$"


def create_tables(stmts: DataFrame) -> DataFrame:
    """``table, column, data_type, nullable, primary_key, is_unique`` of the CREATE TABLE statements in ``stmts`` (statement); others go.

    Types lose their parameters; constraints of a whole table make no columns, and what stands in parentheses or quotes is no constraint.
    """
    made = stmts.withColumn("__t", tokens(F.col("statement")))
    made = made.select(F.array_join(F.slice("__t", 1, 64), " ").alias("__head"), runs(F.array_join("__t", " ")).alias("__r"))
    # what stands between the first parenthesis and the one that closes it
    rest = F.slice("__r", F.array_position("__r", "(").cast("int") + 1, F.size("__r"))
    body = let(rest, lambda t: let(depths(t), lambda d: F.slice(t, 1, F.coalesce(F.nullif(F.array_position(d, -1).cast("int"), F.lit(0)) - 1, F.size(t)))))
    # no filter, which would make the tokens twice: other statements have nothing to explode
    columns = F.when(F.col("__head").rlike(_CREATE), at_top(outside(body)))
    parts = made.select(F.regexp_extract("__head", _CREATE, 1).alias("__table"), F.explode(columns).alias("__c")).filter(F.col("__c").rlike(_COLUMN))
    spelled = F.regexp_extract("__c", _COLUMN, 2)
    key, unique = spelled.rlike(r"(?i)\bPRIMARY KEY\b"), spelled.rlike(r"(?i)\bUNIQUE\b")
    return parts.select(named(F.col("__table")).alias("table"), named(F.regexp_extract("__c", _COLUMN, 1)).alias("column"), type_name(spelled).alias("data_type"), (~key & ~spelled.rlike(r"(?i)\bNOT NULL\b")).alias("nullable"), key.alias("primary_key"), unique.alias("is_unique"))
