"""Streams: names that arrive are parsed as they come, and the genre cache takes in new entries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from mulberry.functions.normalize import cache_key
from mulberry.functions.titles import parse_titles


def names_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files that arrive in a folder, parsed."""
    lines = spark.readStream.format("text").load(folder).select(F.trim("value").alias("raw_name")).filter("raw_name <> ''")
    return parse_titles(lines)


def new_titles(names: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The first arrival of every cache key within the watermark."""
    return names.withColumn("key", cache_key(F.col("title"))).withWatermark(time, late).dropDuplicatesWithinWatermark(["key"])


def counts_per_window(events: DataFrame, time: str, group: str, length: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Arrivals per window and group; state goes when the watermark has passed a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), group).agg(F.count("*").alias("n"))


def cache_versions(entries: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append entries (title, genre, confidence, source, cached_at) as versions of cache rows; the latest of a key is its row."""
    rows = entries.select(cache_key(F.col("title")).alias("key"), "genre", "confidence", "source", "cached_at")
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current_cache(versions: DataFrame) -> DataFrame:
    return versions.groupBy("key").agg(F.max(F.struct("cached_at", "genre", "confidence", "source")).alias("v")).select("key", "v.*")


_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def numbered_names(names: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Add ``number`` and ``free_name``: how many rows of a folder's name arrived before, in all batches, and the name with that number.

    The first of a name keeps it, the next gets `` (1)``.  A name's count is
    kept on disk without expiry (the session's state stores are set to RocksDB
    for that), so a stream that is started again from its checkpoint goes on
    counting; rows of one name in one batch are numbered in any order.
    """
    names.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema.fields)

    def number(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            yield pdf.assign(number=range(n, n + len(pdf)))
            n += len(pdf)
        state.update((n,))

    out = names.groupBy(folder, name).applyInPandasWithState(number, f"{kinds}, number long", "n long", "append", "NoTimeout")
    parted = r"(?s)^(.+)(\.[^.]*)$"
    stem = F.when(F.col(name).rlike(parted), F.regexp_extract(name, parted, 1)).otherwise(F.col(name))
    suffix = F.when(F.col(name).rlike(parted), F.regexp_extract(name, parted, 2)).otherwise("")
    return out.withColumn("free_name", F.when(F.col("number") == 0, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("number").cast("string"), F.lit(")"), suffix)))
