"""Plans for archives and folders: how each is taken apart. Grouped aggregates; only plans come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.functions import vocab as V

MANY_FILES, DOMINANT_BYTES, SMALL_BYTES = 3, 1 << 20, 10 << 10


def is_archive(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^./]*$", 0)).isin(V.ARCHIVE_SUFFIXES)


def archive_methods(members: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """(archive, method, member): move_as_is, extract_single_file, extract_and_recompress_folders or extract_all.

    ``members`` is (archive, name, size, is_dir); ``archives`` (archive) names
    those without members too.  The two largest texts come from two maxima,
    never from a list of members.
    """
    inside = F.col("name").rlike(r"[/\\]")
    top = F.when(F.col("name").contains("/"), F.split_part("name", F.lit("/"), F.lit(1))).otherwise(F.split_part("name", F.lit("\\"), F.lit(1)))
    text = ~F.col("is_dir") & F.lower("name").endswith(".txt")
    m = members.select("archive", "name", F.col("size").cast("long").alias("size"), text.alias("text"), (~F.col("is_dir") & ~inside).alias("root"), F.when(inside, top).alias("top"))
    size_key = F.struct("size", "name")
    g = m.groupBy("archive").agg(
        F.count_if("text").alias("texts"), F.max(F.when(F.col("text"), size_key)).alias("first"), F.count_if("root").alias("roots"), F.min(F.when(F.col("root"), F.col("name"))).alias("root"), F.min("top").alias("top0"), F.max("top").alias("top1")
    )
    rest = m.join(g.select("archive", "first"), "archive").filter(F.col("text") & (size_key != F.col("first"))).groupBy("archive").agg(F.max("size").alias("second"))
    ties = m.join(g.select("archive", "first"), "archive").filter(F.col("text") & (size_key == F.col("first"))).groupBy("archive").agg(F.count("*").alias("same"))
    g = g.join(rest, "archive", "left").join(ties, "archive", "left")
    second = F.when(F.col("same") > 1, F.col("first.size")).otherwise(F.col("second"))
    dominant = (F.col("first.size") >= F.greatest(F.lit(DOMINANT_BYTES), 10 * F.greatest(second, F.lit(1)))) | (second <= SMALL_BYTES)
    single = (F.col("texts") == 1) | ((F.col("texts") >= 2) & dominant)
    folders = (F.col("roots") == 0) & (F.col("top0") < F.col("top1"))
    lone = (F.col("roots") == 1) & F.col("top0").isNull()
    method = F.when(single, "extract_single_file").when(folders, "extract_and_recompress_folders").when(lone, "extract_single_file").otherwise("extract_all")
    out = g.select("archive", method.alias("method"), F.when(single, F.col("first.name")).when(~folders & lone, F.col("root")).alias("member"))
    if archives is None:
        return out
    return archives.select("archive").distinct().join(out, "archive", "left").withColumn("method", F.coalesce("method", F.lit("move_as_is")))


def archive_destination(method: Column, stem: Column, flatten: bool = False) -> Column:
    """Where a method's output goes under the target: "" for the target itself."""
    own = F.lit("") if flatten else stem
    return F.when(method.isin("extract_all", "extract_and_recompress_folders"), own).otherwise("")


def folder_plan(files: DataFrame, flatten: bool = False) -> DataFrame:
    """(folder, name, action, destination): what happens to each entry of a folder.

    ``files`` is (folder, name, is_file).  Two archives or more: all files are
    copied; one: it is processed and the rest is copied; none: up to three
    files go to the target, more to a folder of their own.
    """
    arch = F.col("is_file") & is_archive(F.col("name"))
    f = files.withColumn("_arch", arch)
    n = f.groupBy("folder").agg(F.count_if("_arch").alias("_n_arch"), F.count_if(F.col("is_file") & ~F.col("_arch")).alias("_n_plain"))
    own = F.lit("") if flatten else F.regexp_extract("folder", r"[^/]*$", 0)
    j = f.join(n, "folder")
    action = F.when((F.col("_n_arch") == 1) & F.col("_arch"), "process_archive").when((F.col("_n_arch") == 1) | F.col("is_file"), "copy").otherwise("leave")
    where = F.when(F.col("_n_arch") >= 1, own).when(F.col("_n_plain") <= MANY_FILES, F.lit("")).otherwise(own)
    return j.select("folder", "name", action.alias("action"), F.when(F.lit(flatten), "").otherwise(where).alias("destination"))


def processable_folders(folders: DataFrame, protected: list[str] | None = None) -> DataFrame:
    """First-level folders (column ``folder``) that aren't protected by name."""
    return folders.filter(~F.col("folder").isin([*V.PROTECTED_FOLDERS, *(protected or [])]))
