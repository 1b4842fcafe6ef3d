"""Source divergence audit: how far the sources of each language differ in their words, and which words set a source apart.

Terms are counted per language and source, with the number of documents, in one pass over Arrow batches: a task keeps counts, not texts, and
hands them on when they are many. The counts of a term over the sources of its language become one wide vector, an array indexed by
source; functions of arrays turn it into smoothed shares and then into one contribution per pair of sources, which partial
aggregation sums before anything is shuffled. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import materialize, read_table
from causeway.llm.spans import let

#: Runs of ASCII letters and characters outside of ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a language that a term needs, ranks of terms that are listed, the unit of shares.
MIN_DOCS, TOP, UNIT = 10, 10, 1_000_000_000


#: The bytes of UTF-8 text as terms have them: A-Z lower-cased, other letters and what is beyond ASCII as they are, anything else a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Counts that a task keeps before it hands them on.
KEPT = 500_000


def terms(text: bytes) -> list[bytes]:
    """The terms of a text (UTF-8) in their order; only A-Z are lower-cased."""
    return text.translate(_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, n_docs`` of ``docs`` (text, lang, source): occurrences, and documents (rows) that have the term."""

    def rows(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, n_docs) in counts.items():
            found = [*(pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([n_docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(found, names=["lang", "source", "term", "n", "n_docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                words = terms(text.as_py())
                n, n_docs = counts.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                n_docs.update(set(words))
            if sum(len(n) for n, _ in counts.values()) > KEPT:
                yield from rows(counts)
                counts = {}
        yield from rows(counts)

    parts = docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n long, n_docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / total), exact for any count."""
    return F.lit(1).cast("long") + F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(UNIT), total.cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances between sources, and the terms that mark them.

    A language keeps the V terms that at least ``min_docs`` of its rows have. Each group (language, source) and each language gives a kept term
    the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being the sum of its counts of kept terms; two shares are
    floor((p - q)^2 / (p + q)) apart. Part ``pair`` has, for each other source of the language, the sum over all kept terms (0 without any),
    in all ranks; part ``term`` has the first ``top`` kept terms that the group has and gives a larger share than its language. Higher values
    come first, ties by the item's UTF-8.

    Null texts, languages and sources count as ''. Repeated rows count as often as they come, groups without terms take part, other columns
    don't matter, and an empty table gives an empty table. A language of one source has no pairs. Arrays grow with the sources of one
    language, as does the result with their square; counts are exact up to 10^18.
    """
    none = F.lit("")
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), none).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    counts = term_counts(rows)
    # a term's counts over the sources of its language
    wide = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    wide = materialize(wide.filter(F.col("n_docs") >= min_docs).select("lang", "term", "total", "by"), "terms")

    sums = wide.select("lang", F.explode("by").alias("b")).groupBy("lang", "b.source").agg(F.sum("b.n").alias("n"))
    sizes = wide.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    v, n = F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0))
    slots = groups.select("lang", F.struct("source", (n + 2 * v).alias("total")).alias("slot"), (F.coalesce("n_lang", F.lit(0)) + 2 * v).alias("total_lang"))
    # one row per language, a name and a number for each of its sources
    slots = materialize(slots.groupBy("lang").agg(F.array_sort(F.collect_list("slot")).alias("slots"), F.first("total_lang").alias("total_lang")), "slots")

    def dense(by: Column, slots: Column) -> Column:
        return let(F.map_from_entries(by), lambda m: F.transform(slots, lambda s: F.coalesce(F.try_element_at(m, s["source"]), F.lit(0))))

    vectors = wide.join(slots, "lang").select("lang", "term", "slots", dense(F.col("by"), F.col("slots")).alias("n"), share(F.col("total"), F.col("total_lang")).alias("q"))
    vectors = materialize(vectors.select("lang", "term", "n", "q", F.zip_with("n", "slots", lambda n, s: share(n, s["total"])).alias("p")), "vectors")

    # one number for each pair of places, in the order (0, 1), (0, 2), ..., (1, 2), ...
    after = lambda p: F.flatten(F.transform(p, lambda a, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda b: apart(a, b))))
    one_way = vectors.select("lang", F.posexplode(let(F.col("p"), after)).alias("at", "f")).groupBy("lang", "at").agg(F.sum("f").alias("f"))
    pairs = slots.select("lang", "slots", F.posexplode("slots").alias("i", "a")).select("lang", F.size("slots").alias("s"), "i", F.col("a.source").alias("source"), F.posexplode("slots").alias("j", "b")).filter("i <> j")
    low, high = F.least("i", "j"), F.greatest("i", "j")
    at = low * F.col("s") - F.floor(low * (low + 1) / 2) + high - low - 1
    pairs = pairs.withColumn("at", at.cast("int")).join(one_way, ["lang", "at"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("b.source").alias("item"), F.coalesce("f", F.lit(0)).cast("long").alias("value"))

    marked = F.filter(F.arrays_zip("n", "p", "slots.source"), lambda s: (s["n"] > 0) & (s["p"] > F.col("q")))
    marks = vectors.join(slots, "lang").select("lang", "term", "q", F.explode(marked).alias("s"))
    marks = marks.select("lang", "s.source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("s.p"), F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return pairs.withColumn("rank", order).unionByName(marks.withColumn("rank", order).filter(F.col("rank") <= top))


def op13_source_divergence(spark, sf_dir):
    """Divergence between the sources of each language over all documents."""
    return divergence(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_OP13 = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(t) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS total FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + {UNIT}::HUGEINT * (x.n + 2) // (s.n + 2 * v.v) AS p, 1 + {UNIT}::HUGEINT * (x.total + 2) // (v.n::HUGEINT + 2 * v.v) AS q FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}"""
