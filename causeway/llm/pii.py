"""Personal data: base patterns, widened by bootstrapped contextual extraction.

Base spans are the seeds. An identifier stands in a lexical pattern, the word before it and its own shape (digits as 9, letters
as a). Patterns and instances form a graph: a pattern scores the mean score of its distinct instances, an instance that is no
seed the best score of its patterns; after a few rounds, instances of patterns with a high score and enough seeds become spans
of the pattern's kind.

Apart from shapes, the lexical contexts (the word before, the word after, both) are scored too: the share of a kind's instances among
the distinct candidates that are of a known kind or can't be of this one. Contexts with a high score and enough instances extract
candidates of any shape that pass a loose check for the kind; what they extract counts as known in the next round, so that contexts
without seeds are found as well. All scoring is joins and sums of Spark over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import materialize, read_table, text_of
from causeway.llm.simhash import keyed_rows
from causeway.llm.spans import all_matches, counted, gaps, joined, let, placed, touching, with_spans

KINDS = ("email", "ip", "card", "phone")
#: As the base patterns, in forms that take linear time on long runs. A match starts where the last one ended or at the start of a run;
#: what follows a possessive run can't begin with a character of that run, so that giving back would never help.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Spelled-out addresses, and runs of tokens with digits or @ that single spaces join.
CANDIDATE = r"(?<!\S)(?:\S++\x20(?i:at)\x20[^\s.]++(?:\x20(?i:dot)\x20[^\s.]++)++|\S+?\x20?[(\[{](?i:at)[)\]}]\x20?\S++(?:\x20?[(\[{](?i:dot)[)\]}]\x20?\S++)*+|\S*?[0-9@]\S*+(?:\x20[^\s0-9]*+[0-9]\S*+)*+)"
#: Punctuation around a candidate.
EDGE = r"""["'(<\[{,;:!?)>\]}.=]"""
#: How many digits a candidate of a kind may have.
DIGITS = ((0, 1000), (0, 1000), (12, 19), (7, 15))
#: Seeds a pattern needs, the score from which it extracts, and rounds of scoring.
MIN_SEEDS, MIN_SCORE, ROUNDS = 3, 0.8, 3


def luhn(digits: Column) -> Column:
    """The sum of the Luhn check is a multiple of 10."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: int, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == 1:
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$")
    if kind == 2:
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == 3:
        return F.length(digits).between(10, 15)
    return F.lit(True)


def candidates(found: Column, between: Column) -> Column:
    """array<struct<start, end, value, before, after>> of candidates without the punctuation around them; a bracketed area code stays."""

    def one(g: Column, s: Column, i: Column) -> Column:
        value = F.regexp_replace(s["value"], rf"^(?:(?!\([0-9]+\)){EDGE})++", "")
        start = s["start"] + F.length(s["value"]) - F.length(value)
        core = F.regexp_replace(value, rf"{EDGE}++$", "")
        before = F.substring_index(F.regexp_replace(F.rtrim(F.get(g, i)), r"\s", " "), " ", -1)
        after = F.regexp_extract(F.get(g, i + 1), r"^\s*+(\S++)", 1)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), F.lower(before).alias("before"), F.lower(after).alias("after"))

    return F.filter(let(between, lambda g: F.transform(placed(found, g, 0), lambda s, i: one(g, s, i))), lambda s: s["value"] != "")


def shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"[^\W\d_]+", "a"), "[0-9]", "9")


def looks_like(value: Column) -> tuple[Column, ...]:
    """For each kind: whether ``value`` has a form of it. No pattern repeats a group without bound, so that matching never recurses with the length."""
    # what is left of a spelled-out address without its dots
    undotted = F.regexp_replace(value, r"(?i)\x20dot\x20\S++", "")
    spelled = (undotted != value) & undotted.rlike(r"(?i)^\S++\x20at\x20\S++$")
    colons = value.rlike(r"^[0-9A-Fa-f:]++$") & value.contains("::")
    # digits, with three separators at most between two of them
    number = value.rlike(r"^[0-9][-\x20./_0-9]++(?<=[0-9])$") & ~value.rlike(r"[-\x20./_]{4}")
    phone = value.rlike(r"^[+(]*+[0-9][-\x20()./0-9]++(?:(?<=[0-9]\x20|[0-9])(?:x|ext\.?)\x20?[0-9]++|(?<=[0-9]))$") & ~value.rlike(r"[0-9][-\x20()./]{4}")
    date = value.rlike(r"^(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$")
    return (
        value.rlike(r"^[^\s@]++@[^\s@]++$") | spelled | value.rlike(r"^\S+?\x20?[(\[{]at[)\]}]\x20?\S"),
        value.rlike(r"^[0-9]++(?:(?:\.|[\[(](?:\.|dot)[\])])[0-9]++){3}(?:[:/][0-9]++)?$|^[0-9A-Fa-f]*+(?::[0-9A-Fa-f]++){7}$") | colons,
        number,
        phone & ~date,
    )


def loosely(value: Column) -> Column:
    """array<int> of the kinds that ``value`` could be of."""
    n = F.length(F.regexp_replace(value, "[^0-9]++", ""))
    # the number of digits first: what can't be of a kind isn't looked at
    fits = [F.when(n.between(*most), F.when(like, i)) for i, (most, like) in enumerate(zip(DIGITS, looks_like(value), strict=True))]
    return F.filter(F.array(*fits), lambda k: k.isNotNull())


def contextual(seen: DataFrame, min_seeds: int, min_score: float, rounds: int) -> DataFrame:
    """``context, of, n, mean``: the contexts that extract, by the column ``contexts`` of ``seen`` (value, kind, fits, contexts)."""
    edges = seen.select("value", "kind", "fits", F.explode("contexts").alias("context"))
    edges = materialize(edges.groupBy("context", "value").agg(F.max("kind").alias("kind"), F.first("fits").alias("fits")), "contexts")
    known = edges.withColumn("known", F.col("kind"))
    for k in range(max(1, rounds)):
        sums = [F.count(F.when(F.col("known") == i, 1)).alias(f"n{i}") for i in range(len(KINDS))]
        # unknown values that can't be of a kind speak against it; those that could be are neither for nor against
        sums += [F.count(F.when(F.col("known").isNull() & ~F.array_contains("fits", i), 1)).alias(f"u{i}") for i in range(len(KINDS))]
        stats = known.groupBy("context").agg(F.count("known").alias("known"), *sums)
        kinds = F.array(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(i).alias("of"), F.try_divide(f"n{i}", F.col("known") + F.col(f"u{i}")).alias("mean")) for i in range(len(KINDS))])
        best = stats.select("context", F.array_max(F.filter(kinds, lambda s: s["n"] >= min_seeds)).alias("m")).filter(F.col("m.mean") >= min_score)
        trusted = materialize(best.select("context", "m.*"), f"contexts{k}")
        if k + 1 < rounds:
            found = edges.filter("kind IS NULL").join(trusted, "context").filter(F.array_contains("fits", F.col("of")))
            found = materialize(found.groupBy("value").agg(F.max(F.struct("mean", "n", "of"))["of"].alias("found")), f"found{k}")
            known = edges.join(found, "value", "left").withColumn("known", F.coalesce("kind", "found"))
    return trusted


def find_pii(docs: DataFrame, *, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` (array<struct<start, kind, end, value>>) for every row of ``docs`` (doc_id, text).

    Offsets are code points, the end exclusive. A null text counts as empty; rows that repeat keep a row each; a null doc_id is
    kept. Added spans never overlap base spans. Texts are read whole. An empty table gives an empty table.
    """
    rows = keyed_rows(docs, F.col("doc_id"), text_of(docs).alias("text"))
    based = with_spans(rows, "text", PATTERNS, valid, ["id0", "h", "doc_id", "text"])
    based = based.withColumn("__c", all_matches(F.col("text"), CANDIDATE))
    based = based.withColumn("__g", gaps(F.col("text"), F.col("__c"), CANDIDATE))
    based = materialize(based.select("id0", "h", "doc_id", "base", touching(F.col("base"), candidates(F.col("__c"), F.col("__g"))).alias("candidates")), "base")

    seen = based.select("id0", "h", "candidates").dropDuplicates(["id0", "h"]).select("id0", "h", F.explode("candidates").alias("c")).select("id0", "h", "c.kind", "c.span.*")
    seen = materialize(seen.withColumn("shape", shape(F.col("value"))).withColumn("fits", loosely(F.col("value"))), "occurrences")
    bare = [F.regexp_replace(w, rf"^{EDGE}++|{EDGE}++$", "") for w in ("before", "after")]
    sides = F.array(F.struct(bare[0].alias("before"), F.lit(None).cast("string").alias("after")), F.struct(F.lit(None).cast("string").alias("before"), bare[1].alias("after")), F.struct(bare[0].alias("before"), bare[1].alias("after")))
    # no word at all is no context
    sides = F.filter(sides, lambda s: F.concat(F.coalesce(s["before"], F.lit("")), F.coalesce(s["after"], F.lit(""))) != "")
    seen = seen.withColumn("contexts", F.transform(sides, lambda s: F.to_json(s)))

    edges = materialize(seen.groupBy("before", "shape", "value").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.filter("kind IS NOT NULL").groupBy("before", "shape", "kind").agg(F.count("*").alias("n"))
    # a pattern has one kind, that of most of its seeds, and extracts only with enough of them
    patterns = seeds.filter(F.col("n") >= min_seeds).groupBy("before", "shape").agg(F.max(F.struct("n", "kind")).alias("m")).select("before", "shape", F.col("m.kind").alias("of"))
    graph = materialize(edges.join(patterns, ["before", "shape"]), "graph")
    scored = graph.withColumn("score", F.when(F.col("kind") == F.col("of"), 1.0).otherwise(0.0))
    trusted = None
    for k in range(rounds):
        means = scored.groupBy("before", "shape", "of").agg(F.avg("score").alias("mean"))
        trusted = materialize(means, f"patterns{k}")
        # an instance that is no seed is as good as its best pattern
        best = graph.join(trusted, ["before", "shape", "of"]).groupBy("value", "of").agg(F.max("mean").alias("best"))
        best = materialize(best.filter(F.col("best") >= min_score), f"instances{k}")
        scored = graph.join(best, ["value", "of"], "left").withColumn("score", F.when(F.col("kind") == F.col("of"), 1.0).when(F.col("kind").isNull(), F.coalesce("best", F.lit(0.0))).otherwise(0.0))
    if trusted is None:
        trusted = scored.groupBy("before", "shape", "of").agg(F.avg("score").alias("mean"))
    unknown = seen.filter("kind IS NULL")
    fresh = unknown.join(trusted.filter(F.col("mean") >= min_score), ["before", "shape"]).select("id0", "h", "start", "end", "value", "of", F.lit(2.0).alias("mean"))
    loose = unknown.filter(F.size("fits") > 0).withColumn("context", F.explode("contexts")).join(contextual(seen, min_seeds, min_score, rounds), "context")
    loose = loose.filter(F.array_contains("fits", F.col("of"))).select("id0", "h", "start", "end", "value", "of", "mean")
    # a candidate is one span: of its pattern's kind, or else of its best context's
    fresh = fresh.unionByName(loose).groupBy("id0", "h", "start", "end", "value").agg(F.max(F.struct("mean", "of"))["of"].alias("of"))
    spans = fresh.groupBy("id0", "h").agg(F.collect_set(F.struct("start", F.col("of").alias("kind"), "end", "value")).alias("added"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return based.join(spans, ["id0", "h"], "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def op6_pii(spark, sf_dir):
    """Personal data in all documents."""
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
