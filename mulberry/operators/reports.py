"""Summaries of a run, distributions, sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.operators.lineage import cut


def run_summary(tasks: DataFrame, status: str = "status", done: str = "completed", failed: str = "failed", skipped: str = "skipped") -> DataFrame:
    """One row: total, processed, failed, skipped, success_rate in per cent (null for no rows)."""
    s = F.col(status)
    d = tasks.agg(F.count("*").alias("total"), F.count_if(s == done).alias("processed"), F.count_if(s == failed).alias("failed"), F.count_if(s == skipped).alias("skipped"))
    return d.withColumn("success_rate", F.when(F.col("total") > 0, F.round(F.col("processed") / F.col("total") * 100, 1)))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share, rank): most frequent first, ties by value; the groups are what the windows see, not the rows."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return n.withColumns({"share": F.round(F.col("n") / F.sum("n").over(every), 6), "rank": F.row_number().over(every.orderBy(F.desc("n"), F.asc_nulls_last("value")))})


def mean_positive(df: DataFrame, column: str) -> DataFrame:
    """One row: mean_positive, 0 if there is nothing positive."""
    return df.agg(F.round(F.coalesce(F.avg(F.when(F.col(column) > 0, F.col(column))), F.lit(0.0)), 6).alias("mean_positive"))


def level_counts(df: DataFrame, level: str, levels: list, checked: Column | None = None) -> DataFrame:
    """One row: n_<level> for each level, and n_checked."""
    out = [F.count_if(F.col(level) == x).alias(f"n_{x}") for x in levels]
    return df.agg(*out, *([F.count_if(checked).alias("n_checked")] if checked is not None else []))


def batch_stats(df: DataFrame, outcome: str) -> DataFrame:
    """One row: total, success, failed, processed, hit_rate. Errors fail without having been processed."""
    o = F.col(outcome)
    d = df.agg(F.count("*").alias("total"), F.count_if(o == "success").alias("success"), F.count_if(o.isin("failed", "error")).alias("failed"), F.count_if(o.isin("success", "failed")).alias("processed"))
    return d.withColumn("hit_rate", F.when(F.col("total") > 0, F.round(F.col("success") / F.col("total"), 6)).otherwise(0.0))


def ranked(df: DataFrame, order: list[Column], name: str = "rank", limit: int | None = None) -> DataFrame:
    """The first ``limit`` rows in an order, with their rank; all rows are sorted in parallel if there is no limit.

    A limit keeps the window to that many rows.  Without one the rank comes
    from a range-partitioned sort: places within a partition plus the sizes of
    those before it.  Both are read from one checkpoint of the dealt rows, as
    the bounds of the ranges are sampled anew whenever they are computed.
    """
    if limit is not None:
        return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = cut(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = d.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.join(F.broadcast(sizes.select("_p", "_b")), "_p").withColumn(name, F.col("_r") + F.col("_b")).drop("_p", "_r", "_b")


def confidence_rank(level: Column) -> Column:
    return F.when(level == "high", 0).when(level == "medium", 1).when(level == "low", 2).otherwise(3)


def default_order(checked: str = "checked", confidence: str = "confidence", name: str = "name") -> list[Column]:
    """Checked rows first, then by confidence, then by name regardless of case."""
    return [F.desc(checked), confidence_rank(F.col(confidence)).asc(), F.lower(F.col(name)).asc()]


def mapping_rows(tasks: DataFrame) -> DataFrame:
    """The rows of the mapping file: original_path, normalized_path, genre, confidence, status, error_message."""
    new = F.coalesce(F.when(F.col("target_path") != "", F.col("target_path")), F.when(F.col("normalized_name") != "", F.col("normalized_name")), F.lit(""))
    return tasks.select("original_path", new.alias("normalized_path"), "genre", "confidence", "status", "error_message")


def per_cent(c: Column, digits: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%"))
