"""Language identification by mixture inference.

Training counts hashed character n-grams per language. A document's distinct n-grams with their counts are a mixture of the
languages' distributions; expectation-maximisation finds the proportions, and languages leave the set one by one while a
likelihood penalised by the size of the set grows. The prediction is the language with the largest proportion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import read_table
from causeway.llm.tokens import chunks

#: Hashed n-grams of ``N`` characters fall into this many buckets; the model has this many numbers per language.
BUCKETS, N = 1 << 15, 3
#: Prediction for texts without a letter.
UNDETERMINED = "und"
STEPS = 12
#: Letters, and numbers that are no digits.
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """The buckets of all n-grams of the lower-cased text with a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(codes) - N + 1, np.uint32) if len(codes) >= N else np.empty(0, np.uint32)
    for i in range(N if len(h) else 0):
        h = h * np.uint32(0x01000193) ^ codes[i : i + len(h)] * np.uint32(0x9E3779B1)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def has_letter(text: str) -> bool:
    """Whether the text has a character of Unicode's category L."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: Probability of each bucket (rows) in each language (columns), float32.
    table: np.ndarray

    def proportions(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The proportions of the languages in a document, 0 for those outside of the chosen set."""
        p, total = self.table[buckets], float(counts.sum())
        penalty = 0.5 * np.log(total + 1) + np.log(len(self.languages) + 1)
        pi = np.full(len(self.languages), 1 / max(1, len(self.languages)), np.float32)

        def fit(cols: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
            if len(cols) == 1:
                return np.ones(1, np.float32), float(counts @ np.log(p[:, cols[0]])) - penalty
            own = np.ascontiguousarray(p[:, cols])
            for _ in range(STEPS):
                pi = pi * (own.T @ (counts / (own @ pi))) / total
            return pi, float(counts @ np.log(own @ pi)) - penalty * len(cols)

        cols = np.arange(len(self.languages))
        pi, value = fit(cols, pi)
        if len(cols) > 1:  # most documents have one language
            best = int(pi.argmax())
            alone, single = fit(cols[[best]], pi)
            if single >= value:
                cols, pi, value = cols[[best]], alone, single
        while len(cols) > 1:
            rest = np.delete(np.arange(len(cols)), pi.argmin())
            fewer, less = fit(cols[rest], pi[rest] / max(float(pi[rest].sum()), 1e-9))
            if less < value:
                break
            cols, pi, value = cols[rest], fewer, less
        out = np.zeros(len(self.languages), np.float32)
        out[cols] = pi
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its proportion times its share of the evidence against the runner-up, from 0 to 1)."""
        if not self.languages or text is None or not has_letter(text):
            return UNDETERMINED, 0.0
        seen = np.bincount(grams(text), minlength=BUCKETS)
        buckets = np.flatnonzero(seen)
        counts = seen[buckets].astype(np.float32)
        pi = self.proportions(buckets, counts)
        best = int(pi.argmax())
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        logs = counts @ np.log(self.table[buckets])
        gap = float(np.clip((logs[best] - np.delete(logs, best).max()) / 2, -30, 30))
        return self.languages[best], float(pi[best] / (1 + np.exp(-gap)))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all rows of ``labelled`` (text, lang); rows with a null in either don't count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                n = np.bincount(grams(text.as_py()), minlength=BUCKETS)
                if lang in sums:
                    sums[lang] += n
                else:
                    sums[lang] = n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    parts = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> LanguageModel:
    """Learns from all rows of ``labelled`` (text, lang); rows with a null in either don't count, and an empty table gives a model of no
    language. What reaches the driver, and later each worker, is one number per language and bucket: 128 KB a language, whatever the rows.
    """
    languages = sorted(r["lang"] for r in labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang").distinct().collect())
    counts = np.zeros((BUCKETS, len(languages)), np.float64)
    column = {x: i for i, x in enumerate(languages)}
    if languages:
        rows = gram_counts(labelled).toArrow().to_pandas()
        counts[rows["bucket"].to_numpy(), rows["lang"].map(column).to_numpy()] = rows["n"].to_numpy()
    counts += 0.5
    return LanguageModel(languages, (counts / counts.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``lang_pred`` and ``score`` (0 to 1) added; only the whole text decides.

    Null texts and texts without a letter are ``und`` with score 0, as is every text under a model that learned nothing. Columns of
    the names added are replaced; rows that repeat stay; an empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                found = [shared.value.predict(x.as_py()) for x in part.column(text)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*(c for c in part.schema.names if c in keep), "lang_pred", "score"])

    rows = docs.select(*keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op8_language(spark, sf_dir):
    """Predicts the language of all documents from a model of those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).drop("text")
