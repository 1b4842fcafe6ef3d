"""ZIP archives: their listings, the contents of those that pass the plan, and archives that are written the same way each time.

Archives are never read whole: a task reads the directory at an archive's end for its listing, and the ranges of the entries that it is dealt
for their contents, so that neither the size of an archive nor the number of its entries is bound by a worker's memory.
"""

from __future__ import annotations

import hashlib
import stat
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.snapshots import archive_plan
from causeway.sources.store import opened, place
from causeway.storage import materialize

#: Largest archive that is opened; a larger one is refused by its size.
MAX_ARCHIVE = 25 * 2**20
#: Entries of an archive that are dealt to a task together, bytes that are read at a time, and bytes that are handed on together.
ENTRIES, PIECE, HELD = 500, 1 << 20, 8 << 20
LISTING = "archive string, ordinal long, name string, is_dir boolean, is_symlink boolean, file_size long, compress_size long"
CONTENTS = "archive string, path string, content binary, refused string"
COLUMNS = [c.split()[0] for c in CONTENTS.split(", ")]
# Fixed value: the time that all written entries have.
WRITTEN_AT = (2026, 1, 1, 0, 0, 0)
#: Verdicts of archives that aren't opened or can't be.
TOO_LARGE, NOT_AN_ARCHIVE = "ARCHIVE_TOO_LARGE", "NOT_AN_ARCHIVE"


def archives(spark: SparkSession, root: str) -> DataFrame:
    """``archive, length`` of all files at ``root``, by their names alone."""
    return spark.read.format("binaryFile").load(root).select(F.col("path").alias("archive"), "length")


def listings(spark: SparkSession, root: str, max_archive: int = MAX_ARCHIVE) -> DataFrame:
    """The entries of all archives at ``root`` that are no larger than ``max_archive``; one that can't be read has one entry without a name."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["archive"]:
                try:
                    with opened(archive) as f, zipfile.ZipFile(f) as z:
                        infos = z.infolist()
                except (zipfile.BadZipFile, OSError, ValueError):  # a file too short to seek in is a value error
                    infos = [zipfile.ZipInfo("")]
                for first in range(0, len(infos), 10_000):
                    rows = [(archive, first + i, e.filename, e.is_dir() if e.filename else False, stat.S_ISLNK(e.external_attr >> 16), e.file_size, e.compress_size) for i, e in enumerate(infos[first : first + 10_000])]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in LISTING.split(", ")])

    # an archive's listing is some work, so archives are dealt one by one
    small = archives(spark, root).filter(F.col("length") <= max_archive).select("archive")
    return small.repartition(F.col("archive")).mapInPandas(entries, LISTING)


def judged(spark: SparkSession, root: str, max_file: int = 20 * 2**20, max_archive: int = MAX_ARCHIVE, **limits: int) -> DataFrame:
    """``archive, ordinal, name, is_dir, verdict`` of all entries; archives that are too large or none have a row without a name that says so."""
    plan = archive_plan(listings(spark, root, max_archive), max_file=max_file, **limits)
    plan = plan.withColumn("verdict", F.when(F.col("name") == "", NOT_AN_ARCHIVE).otherwise(F.col("verdict")))
    large = archives(spark, root).filter(F.col("length") > max_archive).select("archive", F.lit(0).cast("long").alias("ordinal"), F.lit("").alias("name"), F.lit(False).alias("is_dir"), F.lit(TOO_LARGE).alias("verdict"))
    return plan.select("archive", "ordinal", "name", "is_dir", "verdict").unionByName(large)


def extract(spark: SparkSession, root: str, max_file: int = 20 * 2**20, max_archive: int = MAX_ARCHIVE, **limits: int) -> DataFrame:
    """``archive, path, content`` of all files that ``unpack`` doesn't refuse."""
    return unpack(spark, root, max_file, max_archive, **limits).filter("refused IS NULL").drop("refused")


def unpack(spark: SparkSession, root: str, max_file: int = 20 * 2**20, max_archive: int = MAX_ARCHIVE, **limits: int) -> DataFrame:
    """``archive, path, content, refused`` of all files in the archives whose entries all pass the plan (``limits`` are those of ``archive_plan``).

    Any other archive has one row with a null path and content and the plan's verdict in ``refused``; so has an entry that can't be read
    or holds more than it declares, with its path. Entries of one archive are dealt to tasks in stretches.
    """
    plan = materialize(judged(spark, root, max_file, max_archive, **limits), "plan")
    refused = plan.filter("verdict <> 'OK'").groupBy("archive").agg(F.min_by("verdict", "ordinal").alias("refused"))

    def read(z: zipfile.ZipFile, e: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        data = bytearray()
        try:
            with z.open(e) as f:
                # what comes is counted, whatever the entry declares
                while piece := f.read(PIECE):
                    data += piece
                    if len(data) > max_file:
                        return None, "TOO_LARGE"
        except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError):
            return None, "UNREADABLE"
        return bytes(data), None

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, ordinals in batch.groupby("archive")["ordinal"]:
                with opened(archive) as f, zipfile.ZipFile(f) as z:
                    infos, rows, held = z.infolist(), [], 0
                    for i in ordinals:
                        data, why = read(z, infos[i])
                        rows.append((archive, infos[i].filename.replace("\\", "/"), data, why))
                        held += len(data or b"")
                        if held > HELD or len(rows) == ENTRIES:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=COLUMNS)

    wanted = plan.join(refused, "archive", "left_anti").filter("NOT is_dir").select("archive", "ordinal")
    stretches = wanted.repartition("archive", F.floor(F.col("ordinal") / ENTRIES)).sortWithinPartitions("archive", "ordinal")
    return stretches.mapInPandas(contents, CONTENTS).unionByName(refused.select("archive", F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"), "refused"))


def replaced(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """``files`` (archive, path, content) with the content that ``replacements`` (the same columns) have for a path; what isn't there is not added."""
    new = replacements.select("archive", "path", F.col("content").alias("__new"), F.lit(True).alias("__has"))
    return files.join(new, ["archive", "path"], "left").select("archive", "path", F.when(F.col("__has"), F.col("__new")).otherwise(F.col("content")).alias("content"))


def write_archives(files: DataFrame, target: str) -> DataFrame:
    """Writes the ``files`` (archive, path, content) of each archive to ``target/<archive>`` and gives ``archive, n_entries, size, sha256``.

    Entries stand in the order of their paths and have one fixed time, so that the same files give the same bytes. A task streams one
    entry at a time and renames what it wrote when it is whole; a task that is run again writes the same. A null content is an empty file.
    """

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list = []  # archive, file, zip, entries

        def close() -> pd.DataFrame:
            archive, out, z, n, part, path, system = now.pop()
            z.close()
            out.close()
            system.move(part, path)
            return pd.DataFrame({"archive": [archive], "n_entries": [n], "size": [out.size], "sha256": [out.sha.hexdigest()]})

        for batch in batches:
            for archive, name, content in zip(batch["archive"], batch["path"], batch["content"], strict=True):
                if now and now[0][0] != archive:
                    yield close()
                if not now:
                    system, path = place(f"{target.rstrip('/')}/{archive}")
                    system.create_dir(path.rsplit("/", 1)[0])
                    part = f"{path}.part"
                    out = Hashed(system.open_output_stream(part))
                    now.append((archive, out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), 0, part, path, system))
                _, out, z, n, part, path, system = now[0]
                z.writestr(zipfile.ZipInfo(name, date_time=WRITTEN_AT), content or b"", zipfile.ZIP_DEFLATED)
                now[0] = (archive, out, z, n + 1, part, path, system)
        if now:
            yield close()

    rows = files.select("archive", "path", "content").repartition("archive").sortWithinPartitions("archive", "path")
    return rows.mapInPandas(written, "archive string, n_entries long, size long, sha256 string")


class Hashed:
    """A stream that is only written forward, with the digest and the number of the bytes that went through."""

    def __init__(self, stream) -> None:
        self.stream, self.sha, self.size = stream, hashlib.sha256(), 0

    def write(self, data) -> int:
        self.sha.update(data)
        self.size += len(data)
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()

    def close(self) -> None:
        self.stream.close()
