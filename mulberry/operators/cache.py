"""The genre cache as a table, and the joins around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mulberry.functions.normalize import cache_key


def lookup(titles: DataFrame, cache: DataFrame, title: str = "title") -> DataFrame:
    """Titles with the cache's genre, confidence and source; nulls where it has none."""
    return titles.withColumn("_key", cache_key(F.col(title))).join(cache.select(F.col("key").alias("_key"), F.col("genre").alias("cached_genre"), F.col("confidence").alias("cached_confidence"), F.col("source").alias("cached_source")), "_key", "left").drop("_key")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after new entries (title, genre, confidence, source, cached_at); the latest entry of a key counts.

    The latest is a grouped maximum, combined before the shuffle.
    """
    both = cache.select("key", "genre", "confidence", "source", "cached_at").unionByName(new.select(cache_key(F.col("title")).alias("key"), "genre", "confidence", "source", "cached_at"))
    return both.groupBy("key").agg(F.max(F.struct("cached_at", "genre", "confidence", "source")).alias("v")).select("key", "v.genre", "v.confidence", "v.source", "v.cached_at")


def has(titles: DataFrame, cache: DataFrame, title: str = "title") -> DataFrame:
    """The titles that the cache has."""
    return titles.withColumn("_key", cache_key(F.col(title))).join(cache.select(F.col("key").alias("_key")), "_key", "left_semi").drop("_key")


def update_from_retry(rows: DataFrame, retried: DataFrame, key: str = "filename", unresolved: tuple[str, ...] = ("미분류", "Error")) -> DataFrame:
    """Rows without a genre take what a retry (key, genre, confidence, source) found."""
    r = retried.select(F.col(key).alias("_k"), F.col("genre").alias("_g"), F.col("confidence").alias("_c"), F.col("source").alias("_s"))
    j = rows.join(r, F.col(key) == F.col("_k"), "left")
    take = F.col("genre").isin(*unresolved) & F.col("_g").isNotNull() & ~F.col("_g").isin(*unresolved)
    new = {"genre": "_g", "confidence": "_c", "source": "_s"}
    return j.select(*[F.when(take, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def without(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the names."""
    return rows.join(names.select(key).distinct(), key, "left_anti")
