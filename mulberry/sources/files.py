"""Sources and sinks: directory scans, lists, CSV files of earlier runs, archive members, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions import vocab as V
from mulberry.sources.archives import archive_members

__all__ = ["TASK", "archive_members", "file_name", "parse_listing", "read_csv", "read_list", "scan_files", "task_from_json", "tasks_of", "write_csv", "write_report"]

TASK = "task_id long, original_path string, current_path string, raw_name string, title string, author string, genre string, volume_info string, range_info string, is_completed boolean, side_story string, edition_info string, status string, confidence string, source string, error_message string, normalized_name string, target_path string, user_edited boolean"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def scan_files(spark: SparkSession, folder: str, suffixes: list[str] | None = None, protected: list[str] | None = None) -> DataFrame:
    """(path, name, raw_name, suffix, folder, size, modified) of files of known kinds; first-level protected folders are left out, deeper ones of such names aren't.

    File contents are pruned from the scan.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    relative = F.regexp_replace("path", "^.*?" + _quoted(folder.rstrip("/")) + "/", "")
    name = file_name(F.col("path"))
    f = f.withColumns({"name": name, "suffix": F.lower(F.regexp_extract(name, r"(?<=[^.])\.[^.]*$", 0)), "raw_name": F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""), "folder": F.when(relative.contains("/"), F.split_part(relative, F.lit("/"), F.lit(1))).otherwise("")})
    return f.filter(F.col("suffix").isin(suffixes or V.SCAN_SUFFIXES) & ~F.col("folder").isin([*V.PROTECTED_FOLDERS, *(protected or [])]))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def tasks_of(files: DataFrame) -> DataFrame:
    """A task for every file, keyed by a hash of its path."""
    given = {"task_id": F.xxhash64("path"), "original_path": F.col("path"), "current_path": F.col("path"), "raw_name": F.col("raw_name"), "status": F.lit("pending"), "confidence": F.lit("none"), "is_completed": F.lit(False), "user_edited": F.lit(False)}
    fields = [x.split() for x in TASK.split(", ")]
    return files.select(*[given.get(n, F.lit("")).cast(t).alias(n) for n, t in fields])


def task_from_json(text: Column) -> Column:
    """A task of its JSON, with defaults for missing keys."""
    p = F.from_json(text, TASK)
    fields = [x.split() for x in TASK.split(", ")]
    default = {"status": "pending", "confidence": "none"}
    return F.struct(*[F.coalesce(p[n], F.lit(False if t == "boolean" else default.get(n, ""))).alias(n) if t != "long" else p[n].alias(n) for n, t in fields])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(name): the lines of a text file, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of an earlier run, of strings, with or without a byte order mark."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parse_listing(listings: DataFrame, archive: str = "archive", text: str = "listing") -> DataFrame:
    """(archive, name, size, is_dir) of listings in blocks of ``key = value`` lines parted by blank lines."""
    blocks = listings.select(archive, F.explode(F.split(F.col(text), r"\r?\n\s*\r?\n")).alias("b"))

    def value(key: str) -> Column:
        return F.regexp_extract("b", rf"(?m)^{key} = (.*?)\r?$", 1)

    rows = blocks.select(archive, value("Path").alias("name"), F.expr("try_cast(regexp_extract(b, '(?m)^Size = ([0-9]+)', 1) AS BIGINT)").alias("size"), (value("Folder").eqNullSafe("+") | value("Attributes").startswith("D")).alias("is_dir"))
    return rows.filter("name <> ''").withColumn("size", F.coalesce("size", F.lit(0)))
