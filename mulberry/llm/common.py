"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.operators.lineage import cut, scratch, shared_dir

__all__ = ["WORD", "apart", "cut", "scratch", "shared_dir", "stored", "table", "word_count"]

#: A word, in the sense of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: columns, compressed, where a checkpoint has rows; a folder for each value of ``by``."""
    path = scratch(df.sparkSession, name)
    if by:
        df.write.partitionBy(by).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def apart(*frames: DataFrame) -> str:
    """A beginning for names of helper columns that no column of the frames begins with."""
    names = [c for df in frames for c in df.columns]
    out = "_"
    while any(n.startswith(out) for n in names):
        out += "_"
    return out
