"""Dimensions with versions: what a dictionary, a list of authors or a cache held at a time.

A version is a row with the time from which it holds; a row that is marked as
gone ends its key.  Versions are only added, a folder a run, so what an earlier
time saw can be read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def add_versions(rows: DataFrame, folder: str, run_id: str) -> None:
    """Add rows (key columns, values, valid_from, gone) to the versions in a folder; a run repeated under its name replaces its own."""
    rows.write.mode("overwrite").parquet(f"{folder}/run={run_id}")


def read_versions(spark: SparkSession, folder: str) -> DataFrame:
    """All versions that runs have added."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(folder)


def intervals(versions: DataFrame, keys: list[str], valid_from: str = "valid_from", gone: str = "gone", order: list[str] | None = None) -> DataFrame:
    """Versions with ``valid_to``, the time of the key's next one (null: it holds still); rows that only end a key are left out.

    Of versions of one key and time the last counts, by the columns of
    ``order`` (those of all values, where there are none).  Null keys are a
    key; versions without a time hold from the start.
    """
    others = [c for c in versions.columns if c not in keys and c != valid_from]
    last = versions.groupBy(*keys, valid_from).agg(F.max(F.struct(*(order or []), *[c for c in others if c not in (order or [])])).alias("_v"))
    flat = last.select(*keys, valid_from, *(F.col(f"_v.{c}").alias(c) for c in others))
    w = Window.partitionBy(*keys).orderBy(F.col(valid_from).asc_nulls_first())
    out = flat.withColumn("valid_to", F.lead(valid_from).over(w))
    return out.filter(~F.coalesce(F.col(gone), F.lit(False))).drop(gone) if gone in versions.columns else out


def as_of(versions: DataFrame, keys: list[str], time: object, valid_from: str = "valid_from", gone: str = "gone") -> DataFrame:
    """The dimension as it was at one time: of every key the version that held then."""
    at = F.lit(time)
    held = intervals(versions.filter(F.col(valid_from).isNull() | (F.col(valid_from) <= at)), keys, valid_from, gone)
    return held.filter("valid_to is null").drop(valid_from, "valid_to")


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, time: str, values: list[str], valid_from: str = "valid_from", gone: str = "gone", order: list[str] | None = None) -> DataFrame:
    """``facts`` with the values of the version of their key that held at their time; null where none did, and for null keys and times.

    Intervals of one key don't overlap, so a fact meets one version at most;
    the join is on the key alone, in any number of tasks.
    """
    own = "_"
    while any(c.startswith(own) for c in facts.columns):
        own += "_"
    held = intervals(versions, [key], valid_from, gone, order)
    held = held.select(F.col(key).alias(own + "key"), F.col(valid_from).alias(own + "from"), F.col("valid_to").alias(own + "to"), *(F.col(v).alias(own + v) for v in values))
    since = F.col(own + "from").isNull() | (F.col(own + "from") <= F.col(time))
    until = F.col(own + "to").isNull() | (F.col(own + "to") > F.col(time))
    joined = facts.join(held, (F.col(key) == F.col(own + "key")) & F.col(time).isNotNull() & since & until, "left")
    return joined.select(*(facts[c] for c in facts.columns), *(F.col(own + v).alias(v) for v in values))
