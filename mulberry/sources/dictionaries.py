"""Dictionaries as DataFrames: those fixed here, and those that are read from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions import vocab as V


def genre_map(spark: SparkSession) -> DataFrame:
    rows = [(i, n, g) for i, (n, g) in enumerate((n, g) for g, names in V.GENRE_MAP.items() for n in names)]
    return spark.createDataFrame(rows, "pos int, platform_genre string, genre string")


def platforms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, *v) for p, v in V.PLATFORMS.items()], "platform string, priority int, list_pos int, confidence double")


def read_keywords(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A keyword file: ``keywords`` genre -> keyword -> weight, ``compounds`` genre -> [[kw1, kw2, score]], ``specials`` title -> genre; missing parts are empty."""
    schema = "keywords map<string,map<string,int>>, compounds map<string,array<array<string>>>, specials map<string,string>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    genres = d.select(F.posexplode(F.map_entries("keywords")).alias("genre_pos", "g"))
    keywords = genres.select("genre_pos", F.col("g.key").alias("genre"), F.posexplode(F.map_entries("g.value")).alias("pos", "k")).select("genre_pos", "genre", "pos", F.col("k.key").alias("keyword"), F.col("k.value").alias("weight"))
    compounds = d.select(F.explode("compounds").alias("genre", "p")).select("genre", F.explode("p").alias("p")).select("genre", F.col("p")[0].alias("kw1"), F.col("p")[1].alias("kw2"), F.col("p")[2].cast("int").alias("score"))
    specials = d.select(F.posexplode(F.map_entries("specials")).alias("pos", "e")).select("pos", F.col("e.key").alias("title"), F.col("e.value").alias("genre"))
    return {"keywords": keywords, "compounds": compounds, "specials": specials}


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The JSON of the first of some places that is there, through Spark's file systems; no rows if none is.

    A dictionary may lie beside the data, the program or its parts; which
    comes first is the caller's order.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.createDataFrame([], schema)


def read_mapping(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(platform_genre, genre) of a mapping file, an object of names and genres below ``mapping``."""
    d = read_first(spark, paths, "mapping map<string,string>")
    return d.select(F.explode("mapping").alias("platform_genre", "genre"))


def read_cache(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key, genre, confidence, source, cached_at) of a cache file, an object of entries below ``entries``."""
    d = read_first(spark, paths, "entries map<string,struct<genre:string,confidence:string,source:string,cached_at:string>>")
    return d.select(F.explode("entries").alias("key", "e")).select("key", "e.*")
