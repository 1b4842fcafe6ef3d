"""Quality rules: statistics of texts, and a decision list that is learned from labelled ones.

Sequential covering: a rule is a conjunction of thresholds on statistics. It grows condition by condition, each the one with the best gain on
the growing part of the labelled rows; conditions at its end that don't pay on the pruning part go again; what it covers is left
out, and the next rule starts. Candidates' counts are one aggregate over all labelled rows, so that one number per statistic and bin
reaches the driver, whatever the rows. The list becomes one conditional expression of Spark, which judges all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import SPACE, WORD, materialize, read_table, text_of
from causeway.llm.spans import let

SYMBOLS = r"[#*$%&|<>]"
WIDTH = 5
#: Bins of a statistic, conditions of a rule, rules of a list, rows a rule must cover, and how sure it must be on the pruning part.
BINS, CONDITIONS, RULES, LEAST, PRECISION = 64, 4, 16, 8, 0.9
#: Statistics of the learned rules, as SQL of the columns of ``statistics``; comparable between short and long texts.
FEATURES = {
    "mean_word": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "repeated": "n_repeat_words / n_words",
    "distinct": "n_distinct_words / n_words",
    "letters": "n_letters / word_chars",
    "upper": "n_upper / n_letters",
    "digits": "n_digits / word_chars",
    "wordless": "n_wordless / n_words",
    "sentences": "n_ends / n_words",
    "line_words": "n_words / n_lines",
}


def count_of(text: Column, pattern: str) -> Column:
    """Characters of a class in a text."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WIDTH words that a text has twice or more.

    Windows are hashed: distinct hashes tell that nothing repeats. Otherwise windows stand by 128 bits of hashes, so that equal ones are
    neighbours, and the windows that have an equal one add what they cover beyond the next.
    """

    def windows(w: Column, hashed) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: hashed([F.get(w, i + k) for k in range(WIDTH)], i))

    def covered(w: Column) -> Column:
        two = windows(w, lambda own, i: F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b"), i.alias("i")))
        same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
        found = let(F.sort_array(two), lambda s: F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), (same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))).alias("hit"))), lambda x: x["hit"]), lambda x: x["i"]))
        reach = let(F.sort_array(found), lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(WIDTH), F.coalesce(F.get(s, j + 1) - x, F.lit(WIDTH)))), F.lit(0).cast("long"), lambda a, b: a + b))
        return reach

    one = lambda w: windows(w, lambda own, i: F.xxhash64(*own))
    plain = lambda w: let(one(w), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    zero = F.lit(0).cast("long")
    return let(words, lambda w: F.when(F.size(w) < WIDTH, zero).when(plain(w), zero).otherwise(covered(w)))


def statistics(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with the counts of every whole text of ``docs``; null counts as empty, and repeated rows have a row each."""
    t = F.col("__text")
    own = docs.select(*keep, text_of(docs, text).alias("__text"))
    own = own.withColumn("__w", F.filter(F.split(t, SPACE), lambda w: w != "")).withColumn("__l", F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD)))
    words, lines = F.col("__w"), F.col("__l")
    size = lambda a: F.size(a).cast("long")
    return own.select(
        *keep, size(words).alias("n_words"), F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"), count_of(t, SYMBOLS).alias("n_symbols"),
        (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"),
        size(lines).alias("n_lines"), size(F.array_distinct(words)).alias("n_distinct_words"), count_of(t, r"\p{L}").alias("n_letters"), count_of(t, r"\p{Lu}").alias("n_upper"), count_of(t, "[0-9]").alias("n_digits"),
        size(F.filter(words, lambda w: ~w.rlike(r"\p{L}"))).alias("n_wordless"), size(F.filter(words, lambda w: w.rlike(r"[.!?]$"))).alias("n_ends"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def feature(name: str) -> Column:
    """A statistic, 0 where it isn't defined."""
    over, under = FEATURES[name].split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, of=feature) -> Column:
        return of(self.name) > self.limit if self.above else of(self.name) <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in their order; the first that holds rejects a text. What no rule covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rule(self) -> Column:
        """The number (from 1) of the first rule that holds, or 0."""
        out = F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(conjunction(rule), i).otherwise(out)
        return out

    def kept(self) -> Column:
        return self.rule() == 0

    def __str__(self) -> str:
        return "\n".join([*(f"reject if {' and '.join(map(str, r))}" for r in self.rules), "keep"])


def conjunction(rule: tuple[Condition, ...], of=feature) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.holds(of)
    return out


def learn(labelled: DataFrame, *, bins: int = BINS, conditions: int = CONDITIONS, rules: int = RULES, least: int = LEAST, precision: float = PRECISION) -> DecisionList:
    """A list that rejects rows with ``good`` false of ``labelled`` (``statistics``, good boolean, split long: a third, by split, prunes).

    All rows with a label count; a null label doesn't, and no rows, or of one kind, give an empty list. Limits are quantiles of the
    statistics. A rule is kept if at least ``precision`` of what it covers on the pruning part is bad; learning ends with the first that is not.
    """
    named = {n: f"f{i}" for i, n in enumerate(FEATURES)}
    of = lambda name: F.col(named[name])
    rows = labelled.filter("good IS NOT NULL").select(*[feature(n).alias(c) for n, c in named.items()], "good", (F.pmod("split", F.lit(3)) == 0).alias("prunes"))
    rows = materialize(rows, "labelled")
    cuts = rows.agg(*[F.percentile_approx(c, [k / bins for k in range(1, bins)], 100 * bins).alias(c) for c in named.values()], F.count("*").alias("n")).first()
    if not cuts["n"]:
        return DecisionList(())
    limits = {n: sorted(set(cuts[c])) for n, c in named.items()}
    # a statistic's bin: how many limits lie below it
    below = lambda c, cut: F.size(F.filter(F.lit(cut), lambda x: x < F.col(c)))
    bins_of = [F.struct(F.lit(i).alias("f"), below(c, limits[n]).alias("bin")) for i, (n, c) in enumerate(named.items())]
    binned = rows.select("good", "prunes", *named.values(), F.array(*bins_of).alias("bins"))
    left = binned = materialize(binned, "binned")
    found: list[tuple[Condition, ...]] = []
    while len(found) < rules:
        rule = grow(left.filter("NOT prunes"), limits, of, conditions, least)
        kept, rate, covers = prune(left.filter("prunes"), rule, of)
        if not kept or rate < precision or covers < 2:
            break
        found.append(kept)
        left = binned.filter(~F.greatest(*[conjunction(r, of) for r in found], F.lit(False)))
    return DecisionList(tuple(found))


def grow(rows: DataFrame, limits: dict[str, list[float]], of, conditions: int, least: int) -> tuple[Condition, ...]:
    """The conjunction that gains most, condition by condition, until it covers no good row."""
    rule: tuple[Condition, ...] = ()
    names = list(limits)
    while len(rule) < conditions:
        inside = rows.filter(conjunction(rule, of)).select("good", F.explode("bins").alias("b"))
        counts = inside.groupBy("b.f", "b.bin").agg(F.count_if(~F.col("good")).alias("bad"), F.count_if(F.col("good")).alias("good")).collect()
        bad, good = (sum(r[k] for r in counts if r["f"] == 0) for k in ("bad", "good"))
        if bad < least or not good:
            break
        best, gain = None, 0.0
        for i, name in enumerate(names):
            own = {r["bin"]: (r["bad"], r["good"]) for r in counts if r["f"] == i}
            below_bad = below_good = 0
            for k, limit in enumerate(limits[name]):  # bin k holds what is at most limit k
                below_bad, below_good = below_bad + own.get(k, (0, 0))[0], below_good + own.get(k, (0, 0))[1]
                for above, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    value = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good))) if p >= least else 0.0
                    if value > gain + 1e-9:
                        best, gain = Condition(name, above, limit), value
        if best is None:
            break
        rule = (*rule, best)
    return rule


def prune(rows: DataFrame, rule: tuple[Condition, ...], of) -> tuple[tuple[Condition, ...], float, int]:
    """The start of ``rule`` that is worth most on ``rows``, the share of bad rows in what it covers, and their number."""
    if not rule:
        return (), 0.0, 0
    starts = [rule[: k + 1] for k in range(len(rule))]
    counts = rows.agg(*[F.count_if(conjunction(s, of) & ~F.col("good")).alias(f"p{k}") for k, s in enumerate(starts)], *[F.count_if(conjunction(s, of) & F.col("good")).alias(f"n{k}") for k, s in enumerate(starts)]).first()
    worth = lambda k: (counts[f"p{k}"] - counts[f"n{k}"]) / max(1, counts[f"p{k}"] + counts[f"n{k}"])
    k = max(range(len(starts)), key=lambda k: (worth(k), counts[f"p{k}"], -k))
    p, n = counts[f"p{k}"], counts[f"n{k}"]
    return starts[k], p / max(1, p + n), p


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (the number of the learned rule that rejects the row, or 0) and ``kept``."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def labelled_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``stats`` (doc_id and counts) with ``good``, by ``labels`` (doc_id, quality): an id with several labels is good if all are."""
    marks = labels.groupBy("doc_id").agg((F.min("quality") > 0).alias("good")).filter("doc_id IS NOT NULL AND good IS NOT NULL")
    return stats.join(marks, "doc_id").withColumn("split", F.xxhash64("doc_id"))


def op11_quality_rules(spark, sf_dir):
    """Statistics and verdicts of all documents, by the base rules and a list learned from all labelled documents that pass these."""
    stats = materialize(statistics(read_table(spark, sf_dir, "documents"), keep=["doc_id"]), "statistics")
    rules = learn(labelled_rows(stats.filter(~base_failed()), read_table(spark, sf_dir, "labels")))
    return judge(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
