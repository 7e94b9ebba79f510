"""Tables of contents of ZIP archives by ranged reads: of an archive only its end and its central directory are read, however large it is.

Archives are found by a scan of their names (contents are pruned from it) and
dealt to tasks; a task opens one after another where it lies and passes on a
few thousand members at a time.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.sources.storage import Ranged

#: Archives to a task, about, tasks at most, and members passed on at once.
ARCHIVES_A_TASK, MOST_TASKS, MEMBERS = 64, 10_000, 5_000
#: How names of members are written that don't say they are UTF-8, and how old Korean archives wrote them.
TOLD, MEANT = "cp437", "cp949"

_SCHEMA = "archive string, name string, size long, packed long, modified timestamp_ntz, is_dir boolean, error string"


def member_name(info: zipfile.ZipInfo) -> str:
    """The name of a member; without the mark of UTF-8 it is taken for one of an old Korean archive, if it can be."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        return info.filename.encode(TOLD).decode(MEANT)
    except UnicodeError:
        return info.filename


def _members(path: str) -> Iterator[tuple]:
    if not path.lower().endswith((".zip", ".zipx")):
        yield path, None, None, None, None, None, "unsupported"
        return
    try:
        with Ranged(path) as raw, zipfile.ZipFile(raw) as z:
            for m in z.infolist():
                y, month, d, h, minute, s = m.date_time
                # a date of no calendar is no date
                stamp = f"{y:04}-{month:02}-{d:02}T{h:02}:{minute:02}:{min(s, 59):02}" if 1 <= month <= 12 and 1 <= d <= 31 and h < 24 and minute < 60 else None
                yield path, member_name(m), m.file_size, m.compress_size, stamp, m.is_dir(), None
    except (ValueError, zipfile.BadZipFile, NotImplementedError, OSError) as e:
        yield path, None, None, None, None, None, str(e) or type(e).__name__


def list_archives(archives: DataFrame, path: str = "path") -> DataFrame:
    """(archive, name, size, packed, modified, is_dir, error) of the members of the archives whose paths a table holds.

    Archives of other kinds than ZIP, broken ones and those that can't be
    opened have one row with an error; empty archives and null paths have none.
    Members come in the archive's order.
    """
    tasks = max(1, min(MOST_TASKS, archives.count() // ARCHIVES_A_TASK))
    names = ["archive", "name", "size", "packed", "modified", "is_dir", "error"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows: list[tuple] = []
        for paths in batches:
            for one in paths.column(0).to_pylist():
                for row in _members(one):
                    rows.append(row)
                    if len(rows) >= MEMBERS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    found = archives.select(F.col(path).alias("path")).filter("path is not null").repartition(tasks).mapInArrow(run, _SCHEMA.replace("timestamp_ntz", "string"))
    return found.withColumn("modified", F.try_to_timestamp("modified", F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")).select(*names)


def archive_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the archives below a folder; their contents are pruned from the scan."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return f.filter(F.lower("path").rlike(r"\.(zip|zipx|rar|7z)$")).select("path", F.col("length").alias("size"))


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, name, size, is_dir, error) of the members of the archives below a folder."""
    return list_archives(archive_paths(spark, folder)).select("archive", "name", "size", "is_dir", "error")
