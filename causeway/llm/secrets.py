"""Secret scans: base patterns, and high entropy in a sliding window over candidate strings.

A candidate is a run of characters of keys that has letters. It is cut at stretches of an allow-list (long runs, counted alphabets,
placeholders, dates), so that no window touches them and the pieces between them are scored like candidates. The character class of a
piece (hexadecimal, letters and digits of one case, of both cases, with symbols) sets the threshold. A window of ``WINDOW``
characters goes over it; counts of the characters inside are kept as one enters and one leaves, and with them the sum of c*log2(c),
from which the entropy follows. UUIDs and names made of words are no candidates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import read_table, text_of
from causeway.llm.spans import all_matches, counted, gaps, joined, let, placed, running, touching, with_spans

KINDS = ("assign", "access", "hex", "entropy")
PATTERNS = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    r"AKIA[A-Z0-9]{14,}+",
    r"[0-9a-f]{16,}+",
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Bits per character from which a window of a class counts as random.
THRESHOLDS = (("^[0-9A-Fa-f]+$", 3.0), ("^[0-9a-z]+$", 3.4), ("^[0-9A-Z]+$", 3.4), ("^[0-9A-Za-z]+$", 3.6), ("", 3.8))
#: Window starts that are scored at a time.
STEP = 4000
#: A word of one case, capitalised or in camel case; one of a single case that fills a window is none.
_NAME = r"(?>(?:[A-Z]?[a-z]{1,18}|[A-Z]{1,19}|[a-z]{0,19}(?:[A-Z][a-z]{2,18}+)++)(?![A-Za-z]))"
#: What is allowed as a whole: UUIDs, words joined by separators with a short number, and only words and symbols.
ALLOW = (
    r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$",
    rf"^(?:{_NAME}[-_/])++{_NAME}?[0-9]{{0,4}}$",
    rf"^[-_/=+]*+(?:{_NAME}[-_/=+]++)*+{_NAME}?$",
)
_LETTERS = "".join(f"(?:{c}" for c in "ijklmnopqrstuvwxyz") + ")?+" * 18
#: Stretches at which a candidate is cut: runs of one character, counted alphabets, placeholders that stand alone, a leading date.
STRETCH = rf"(.)\1{{7,}}+|(?i:0123456789(?:abcdef)?+|abcdefgh{_LETTERS})|(?<![A-Za-z0-9])(?i:example|placeholder|changeme|x{{4,}})(?![A-Za-z0-9])[-_/=]*+|^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}[-_/=]*+"


def valid(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.length(F.regexp_extract(value, r"""^[A-Za-z_]+["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$""", 1)) >= 12
    return F.lit(True)


def top_entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits per character, of any window of ``value`` (ASCII), by counts kept as the window moves.

    A character that enters meets its equals among the ``window - 1`` before it, one that leaves those after it; each changes the sum of
    c*log2(c) by what its count tells. The terms are whole numbers of 2**-20 bits, so that the running sum is exact.
    """
    terms = F.array(*[F.lit(round(c * math.log2(c) * 2**20) if c else 0).cast("long") for c in range(window + 1)])
    full = F.least(F.length(value), F.lit(window))

    def lowest(chars: Column) -> Column:
        equals = lambda x, first, n: F.size(F.filter(F.slice(chars, first, n), lambda y: y == x))
        growth = lambda c: F.get(terms, c + 1) - F.get(terms, c)
        enters = F.transform(chars, lambda x, i: growth(equals(x, F.greatest(i - (window - 2), F.lit(1)), F.least(i, F.lit(window - 1)))))
        leaves = F.transform(chars, lambda x, i: growth(equals(x, i + 2, F.lit(window - 1))))
        moved = let(leaves, lambda out: F.transform(enters, lambda x, i: x - F.when(i >= window, F.get(out, i - window)).otherwise(F.lit(0).cast("long"))))
        sums = running(moved, F.lit(0).cast("long"), lambda a, b: a + b)
        return F.array_min(let(sums, lambda s: F.slice(s, F.least(F.size(s), F.lit(window)), F.size(s))))

    bits = F.log2(full.cast("double")) - let(F.split(value, ""), lowest) / (full * F.lit(2.0**20))
    return F.when(F.length(value) > 0, bits).otherwise(0.0)


def allowed(value: Column) -> Column:
    return reduce(lambda a, b: a | b, [value.rlike(pattern) for pattern in ALLOW])


def looks_random(value: Column, window: int = WINDOW) -> Column:
    limit = F.lit(THRESHOLDS[-1][1])
    for pattern, bits in reversed(THRESHOLDS[:-1]):
        limit = F.when(value.rlike(pattern), F.lit(bits)).otherwise(limit)
    last = F.floor((F.length(value) - window) / STEP).cast("int")
    part = lambda k: F.substring(value, k * STEP + 1, F.lit(STEP + window - 1))
    scored = (F.length(value) >= window) & value.rlike("[A-Za-z]") & ~allowed(value)
    return F.when(scored, F.exists(F.sequence(F.lit(0), last), lambda k: top_entropy(part(k), window) >= limit)).otherwise(False)


def pieces(found: Column) -> Column:
    """The pieces of the spans ``found`` between stretches of the allow-list; none of a span that is allowed as a whole."""
    cut = F.transform(
        F.filter(found, lambda s: ~allowed(s["value"])),
        lambda s: F.struct(s["start"].alias("start"), F.split(s["value"], STRETCH, -1).alias("kept"), F.concat(F.array(F.lit("")), all_matches(s["value"], STRETCH)).alias("dropped")),
    )
    moved = lambda at: lambda s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value"))
    return F.flatten(F.transform(cut, lambda c: F.transform(placed(c["kept"], c["dropped"], 3), moved(c["start"]))))


def find_secrets(docs: DataFrame, *, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``base`` and ``added`` (array<struct<start, kind, end, value>>) for every row of ``docs`` (text).

    Offsets are code points, the end exclusive. Null counts as empty; rows that repeat keep a row each; texts are read whole.
    Added spans (kind ``entropy``) never overlap base spans. An empty table gives an empty table.
    """
    rows = docs.select(*keep, text_of(docs).alias("__text"))
    based = with_spans(rows, "__text", PATTERNS, valid, [*keep, "__text"])
    based = based.withColumn("__c", all_matches(F.col("__text"), CANDIDATE)).withColumn("__g", gaps(F.col("__text"), F.col("__c"), CANDIDATE))
    cut = based.select(*keep, "base", touching(F.col("base"), placed(F.col("__c"), F.col("__g"), 3)).alias("__s"))
    cut = cut.select(*keep, "base", pieces(F.transform(F.filter("__s", lambda s: s["kind"].isNull()), lambda s: s["span"])).alias("__s"))
    return cut.select(*keep, "base", F.filter("__s", lambda s: looks_random(s["value"])).alias("added"))


def op7_secrets(spark, sf_dir):
    """Secrets in all documents."""
    found = find_secrets(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
