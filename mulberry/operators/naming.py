"""Plans of new names: free numbers on collisions, duplicates in a batch, target folders. Nothing is moved here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.functions.titles import PARSED, parse_titles, standard_name, valid_genre
from mulberry.operators.numbering import running


def _parts(name: Column) -> tuple[Column, Column]:
    """(stem, suffix) at the last dot that isn't the first character."""
    p = r"(?s)^(.+)(\.[^.]*)$"
    return F.when(name.rlike(p), F.regexp_extract(name, p, 1)).otherwise(name), F.when(name.rlike(p), F.regexp_extract(name, p, 2)).otherwise("")


def free_names(new: DataFrame, existing: DataFrame, folder: str = "folder", name: str = "name", pos: str = "pos") -> DataFrame:
    """Add ``free_name``: the name itself if it is free, else with the first free `` (n)`` before the suffix, in order of ``pos``.

    ``existing`` is (folder, name).  The k-th newcomer of a name takes the k-th
    free number, so gaps are filled; there is no highest number.  Rows are dealt
    anew three times and written each time, so a name of any number of rows is
    no task's alone.
    """
    stem, suffix = _parts(F.col(name))
    keys = [folder, name]
    n = running(new.withColumns({"_stem": stem, "_suffix": suffix}), keys, [F.col(pos).asc()], name="_at").withColumn("_at", F.col("_at") - 1)
    have = existing.select(F.col(folder).alias("_f"), F.col(name).alias("_e")).distinct()
    taken = have.withColumns(dict(zip(("_es", "_ex"), _parts(F.col("_e")), strict=True)))
    # of existing names only those that are the name or a numbered form of it
    numbered = r"(?s)^(.*) \((\d+)\)$"
    base = taken.select("_f", F.concat(F.regexp_extract("_es", numbered, 1), "_ex").alias("_name"), F.regexp_extract("_es", numbered, 2).alias("_no")).filter(F.col("_no").rlike("^[1-9][0-9]{0,8}$"))
    used = base.unionByName(taken.select("_f", F.col("_e").alias("_name"), F.lit("0").alias("_no"))).select(F.col("_f").alias(folder), F.col("_name").alias(name), F.col("_no").cast("long").alias("_no")).distinct()
    used = used.join(new.select(folder, name).distinct(), keys, "left_semi")
    # as many free numbers lie below a used one as its value less its place among the used
    used = running(used, keys, [F.col("_no").asc()], name="_k").select(folder, name, (F.col("_no") - F.col("_k") + 1).alias("_at"), F.lit(1).cast("long").alias("_used"))
    both = n.unionByName(used, allowMissingColumns=True)
    both = running(both, keys, [F.col("_at").asc(), F.col("_used").desc_nulls_last()], F.col("_used"), "_below").filter("_used is null")
    number = F.col("_at") + F.col("_below")
    out = F.when(number == 0, F.col(name)).otherwise(F.concat("_stem", F.lit(" ("), number.cast("string"), F.lit(")"), "_suffix"))
    return both.withColumn("free_name", out).select(*new.columns, "free_name")


def number_duplicates(df: DataFrame, original: str, name: str, pos: str) -> DataFrame:
    """(original, standard_name): the second of a name in a batch gets `` (2)``, the third `` (3)``; an original met again keeps the last.

    All rows are dealt anew and written once, so a name of any number of rows
    is no task's alone.
    """
    stem, suffix = _parts(F.col(name))
    d = running(df.withColumns({"_stem": stem, "_suffix": suffix}), ["_stem"], [F.col(pos).asc()], name="_n")
    d = d.withColumn("standard_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat("_stem", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), "_suffix")))
    return d.groupBy(original).agg(F.max_by("standard_name", pos).alias("standard_name"))


def target_folder(path: Column, target: Column) -> Column:
    """An absolute target as it is, a relative one beside the file."""
    parent = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(target.startswith("/"), target).otherwise(F.concat(parent, F.lit("/"), target))


def fill_from_names(tasks: DataFrame) -> DataFrame:
    """Titles and what goes with them for tasks without a title; what a task has already stays."""
    p = parse_titles(tasks.select(F.col("task_id").alias("_id"), "raw_name")).select("_id", F.struct(*PARSED).alias("_p"))
    t = tasks.join(p, F.col("task_id") == F.col("_id")).drop("_id")
    empty = F.col("title") == ""

    def fill(c: str, found: str | None = None) -> Column:
        return F.when(empty & (F.col(c) == ""), F.col(f"_p.{found or c}")).otherwise(F.col(c))

    new = {c: fill(c) for c in ("title", "author", "volume_info", "range_info", "side_story", "edition_info")} | {"genre": fill("genre", "original_genre"), "is_completed": F.when(empty, F.col("is_completed") | F.col("_p.is_completed")).otherwise(F.col("is_completed"))}
    return t.select(*[new[c].alias(c) if c in new else F.col(c) for c in tasks.columns])


def plan_names(tasks: DataFrame, target: str = "정리완료") -> DataFrame:
    """Add normalized_name and target_folder: names edited by hand stay (with a suffix), others are built; skipped rows get none."""
    suffix = _parts(F.regexp_extract("current_path", r"[^/]*$", 0))[1]
    title = F.when(F.col("title") == "", F.col("raw_name")).otherwise(F.col("title"))
    built = F.concat(standard_name(valid_genre(F.col("genre")), title, F.col("edition_info"), F.col("volume_info"), F.col("range_info"), F.col("is_completed"), F.col("side_story")), suffix)
    edited = F.when(F.col("normalized_name").rlike(r"\.[^./]+$"), F.col("normalized_name")).otherwise(F.concat("normalized_name", suffix))
    name = F.when(F.col("status") == "skipped", F.lit("")).when(F.col("user_edited"), edited).otherwise(built)
    return tasks.withColumn("normalized_name", name).withColumn("target_folder", target_folder(F.col("current_path"), F.lit(target)))
