"""The whole way of a name: parse, classify, name, summarise; and the same over titles of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions.html import genre_of_page, page_title
from mulberry.functions.titles import parse_titles, standard_name, valid_genre
from mulberry.operators.genres import classify
from mulberry.operators.naming import fill_from_names, plan_names
from mulberry.operators.reports import mapping_rows, run_summary


def page_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all pages, parsed and given standard names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", page_title(F.col("html")).alias("raw_name"), genre_of_page(F.col("html")).alias("g"))
    p = parse_titles(pages)
    genre = valid_genre(F.coalesce("g.genre", F.lit("")))
    name = standard_name(genre, F.col("title"), F.col("edition_info"), F.col("volume_info"), F.col("range_info"), F.col("is_completed"), F.col("side_story"))
    return p.select("page_id", "raw_name", "title", "range_info", "is_completed", genre.alias("genre"), name.alias("standard_name"))


def curate(tasks: DataFrame, cache: DataFrame, search: DataFrame, keywords: DataFrame, target: str = "정리완료") -> DataFrame:
    """Tasks parsed, classified and named; nothing is moved or written."""
    parsed = fill_from_names(tasks)
    found = classify(parsed, cache, search, keywords)
    named = plan_names(found.select(*[c for c in tasks.columns if c in found.columns]), target)
    done = F.when(F.col("status") == "skipped", F.col("status")).otherwise("completed")
    return named.withColumn("target_path", F.concat("target_folder", F.lit("/"), "normalized_name")).withColumn("status", done)


def summary(curated: DataFrame) -> DataFrame:
    return run_summary(curated)


def mapping(curated: DataFrame) -> DataFrame:
    return mapping_rows(curated)
