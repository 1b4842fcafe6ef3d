"""URL filters: rules of host and path, found through a sorted array of 64-bit digests.

Each rule is stored as the string host + path. A url's candidates are all suffixes of its host at label boundaries with all
prefixes of its path that have the length of some rule's path. Their xxhash64 keys are probed in the sorted key array by
vectorised binary search, and the stored string confirms each hit, so that a collision of keys never decides.

The array is one file, which Spark ships to each executor and the tasks memory-map: for a list of rules, which the driver holds anyway.
Rules in a table, of any number, never come to the driver: candidates meet them in a shuffled join, with the same results.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import read_table

#: Verdict of a url that no rule fits.
DEFAULT = "allow"
#: (verdict, host, path) of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_array(rules: Sequence[tuple[str, str, str]], path: str) -> None:
    """Write the sorted keys, the offsets of the strings and the strings (verdict, host, path) to ``path``.npy files in one."""
    entries = sorted((xxhash.xxh64_intdigest(f"{host}{at}"), f"{verdict}\t{host}\t{at}".encode()) for verdict, host, at in rules)
    strings = [s for _, s in entries]
    ends = np.cumsum([0, *map(len, strings)], dtype=np.uint64)
    with open(path, "wb") as f:
        np.array([len(entries)], dtype=np.uint64).tofile(f)
        np.array([k for k, _ in entries], dtype=np.uint64).tofile(f)
        ends.tofile(f)
        f.write(b"".join(strings))


class DigestArray:
    """The memory-mapped array of ``build_array``."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view(np.uint64)[0])
        self.keys = raw[8 : 8 + 8 * n].view(np.uint64)
        self.ends = raw[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.raw = raw[16 + 16 * n :]

    def strings(self, i: int) -> list[str]:
        return bytes(self.raw[int(self.ends[i]) : int(self.ends[i + 1])]).decode().split("\t", 2)

    def find(self, candidates: list[tuple[str, str]]) -> list[tuple[str, str, str] | None]:
        """For each (host, path): its (verdict, host, path), or None."""
        out: list[tuple[str, str, str] | None] = [None] * len(candidates)
        if not candidates or not len(self.keys):
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(h + p) for h, p in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        for i in hits:
            for j in range(int(at[i]), len(self.keys)):  # equal keys stand together
                if self.keys[j] != keys[i]:
                    break
                verdict, host, path = self.strings(j)
                if (host, path) == candidates[i]:
                    out[i] = (verdict, host, path)
                    break
        return out


def suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, *, url: str = "url", default: str = DEFAULT, max_entries: int | None = None) -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` added (columns of these names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule (host and path together)
    wins, then the one with the longer host. A null url, or one without ``://``, has an empty host and path and the default
    verdict. Repeated rows stay; an empty table or an empty rule list is fine; urls are read whole, however long. ``rules`` are a list of
    (verdict, host, path), of which the last of a host and path counts, or a table of these columns, of whose rows with
    one host and path that with the greatest verdict, by name, counts. Lists
    longer than ``max_entries``, if given, are taken as a table.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame):
        return _by_join(split, keep, rules, default)
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    if max_entries is not None and len(rules) > max_entries:
        return _by_join(split, keep, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    lengths = sorted({len(p) for _, _, p in rules})
    name = f"digest-array-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(), name)
    build_array(rules, local)
    pages.sparkSession.sparkContext.addFile(local)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        array = DigestArray(SparkFiles.get(name))
        for pdf in batches:
            candidates, owner = [], []
            for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"], strict=True)):
                prefixes = [path[:n] for n in lengths if n <= len(path)]
                for suffix in suffixes(host) if host else ():
                    candidates += [(suffix, p) for p in prefixes]
                owner += [i] * (len(candidates) - len(owner))
            best: list[tuple[str, str, str] | None] = [None] * len(pdf)
            for i, hit in zip(owner, array.find(candidates), strict=True):
                if hit and (best[i] is None or (len(hit[1]) + len(hit[2]), len(hit[1])) > (len(best[i][1]) + len(best[i][2]), len(best[i][1]))):
                    best[i] = hit
            yield pdf.assign(rule=[b and b[1] + b[2] for b in best], verdict=[b[0] if b else default for b in best])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.schema.fields)
    return split.mapInPandas(judge, f"{kinds}, rule string, verdict string")


def _by_join(split: DataFrame, keep: list[str], rules: DataFrame, default: str) -> DataFrame:
    """The same by a join of candidates with the rules. Only the different lengths of the rules' paths reach the driver."""
    table = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    lengths = sorted(r["n"] for r in table.select(F.length("r_path").alias("n")).distinct().collect())
    # host and path alone decide, so that equal urls are judged once
    urls = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = urls.select("host", "path", F.explode(hosts).alias("r_host")).filter("r_host <> ''")
    near = near.select("host", "path", "r_host", F.explode(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")])).alias("r_path"))
    hits = near.join(table, ["r_host", "r_path"])
    size = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), size).alias("b"))
    out = split.join(best, ["host", "path"], "left")
    return out.select(*keep, "host", "path", F.col("b.rule").alias("rule"), F.coalesce(F.col("b.verdict"), F.lit(default)).alias("verdict"))


def op10_url_filter(spark, sf_dir):
    """Judges every url of ``pages``."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_OP10 = r"""
WITH split AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM split"""
