"""What a user reviews before names are changed: filters and signs on names, leading tags, sorts, the way back, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.functions import vocab as V
from mulberry.functions.normalize import let, literal_table, literal_words
from mulberry.operators.reports import distribution, mean_positive


def previewed(tasks: DataFrame, genre: str = "genre") -> DataFrame:
    """Rows of a rename preview: those with a genre."""
    return tasks.filter(F.coalesce(genre, F.lit("")) != V.UNCLASSIFIED)


def checked_only(tasks: DataFrame, checked: str = "checked") -> DataFrame:
    return tasks.filter(F.coalesce(checked, F.lit(False)))


def needs_change(original: Column, normalized: Column) -> Column:
    """Whether a name would change; null names are like none."""
    return ~original.eqNullSafe(normalized)


def is_suspicious(title: Column) -> Column:
    """An empty title, or a range still inside it."""
    return (F.coalesce(title, F.lit("")) == "") | title.rlike(r"\d+-\d+")


def is_unfinished(name: Column) -> Column:
    """Still running, unless only a side story is."""
    return ~name.rlike(V.SIDE_RUNS_ON) & name.rlike("미완|연재중")


def needs_normalising(name: Column) -> Column:
    """Whether the older normaliser has something to do on a name."""
    return ~name.rlike(V.SETTLED_NAME) & name.rlike("|".join(f"(?:{p})" for p in V.RAW_NAME_SIGNS))


def needs_user(name: Column) -> Column:
    """A number joined to the title of a finished work and no range: it may be either."""
    stem = F.regexp_replace(name, r"(?i)\s*\.(txt|epub|zip|zipx|7z|rar)$", "")
    return ~stem.rlike(r"\d+-\d+") & stem.rlike(r"(?U)[가-힣a-zA-Z]\d+\s*\(완\)")


def leading_tag(head: Column) -> Column:
    """struct(category, rest): the genres of a leading bracket as ``[a.b]`` and the name without it; tags of no genre are dropped."""
    pattern = r"(?sU)^[\[(]\s*(.*?)\s*[\])]\s*"
    inner = F.regexp_replace(F.regexp_extract(head, pattern, 1), r"(?U)\s+", " ")
    synonyms, kept = literal_table(V.TAG_SYNONYMS), literal_words(V.TAG_GENRES_KEPT)

    def standard(token: Column) -> Column:
        return F.coalesce(F.get(F.filter(synonyms, lambda s: s["k"] == token), F.lit(0))["g"], token)

    def of_token(token: Column) -> Column:
        bare = let(F.trim(F.regexp_replace(token, V.TRANSLATED, "")), standard)
        plain = let(token, standard)
        return let(F.struct(bare.alias("b"), plain.alias("p")), lambda x: F.when(F.array_contains(kept, x["b"]), x["b"]).otherwise(x["p"]))

    tokens = F.transform(F.split(inner, "[.,·]"), lambda t: of_token(F.trim(t)))
    valid = F.filter(tokens, lambda t: F.array_contains(kept, t))
    tagged = head.rlike(pattern)
    category = F.when(tagged & (F.size(valid) > 0), F.concat(F.lit("["), F.array_join(valid, "."), F.lit("]")))
    return F.struct(category.alias("category"), F.when(tagged, F.regexp_replace(head, pattern, "")).otherwise(head).alias("rest"))


def valid_remap(title: Column, target: Column, confidence: Column, words: dict[str, list[str]]) -> Column:
    """Whether a second remapping holds: by a word of the target's list, where it has one, else by its confidence; plain fantasy always does."""
    low, out = F.lower(title), F
    for genre, listed in words.items():
        if listed and genre != "판타지":
            out = out.when(target == genre, F.exists(literal_words(listed), lambda w: F.contains(low, w)))
    return out.when(target == "퓨판", False).when(target == "판타지", True).otherwise(confidence >= 0.80)


def sorted_by(df: DataFrame, column: str, descending: bool = False) -> list[Column]:
    """The order of one column as a table's head sorts it: nulls last going up, first going down."""
    return [F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)]


def undo_steps(log: DataFrame, seq: str = "seq", old: str = "old_path", new: str = "new_path") -> DataFrame:
    """(step, from_path, to_path): the renames of a log taken back, the last one first."""
    from mulberry.operators.reports import ranked

    return ranked(log.filter(F.col(old) != F.col(new)), [F.desc(seq)], "step").select("step", F.col(new).alias("from_path"), F.col(old).alias("to_path"))


def authors_of(authors: DataFrame, genre: str) -> DataFrame:
    """The authors of one genre, each once."""
    return authors.filter(F.col("genre") == genre).select("author").distinct()


def all_keywords(single: DataFrame, compound: DataFrame) -> DataFrame:
    """(genre, keyword): single keywords and both words of compound ones, each once."""
    pairs = compound.select("genre", F.explode(F.array("kw1", "kw2")).alias("keyword"))
    return single.select("genre", "keyword").union(pairs).distinct()


def legacy_mapping(names: DataFrame) -> DataFrame:
    """Columns of the older mapping file: original_name, standard_name; of a name met twice the later counts (column pos)."""
    return names.groupBy("original_name").agg(F.max_by("standard_name", "pos").alias("standard_name"))


def table_rows(tasks: DataFrame) -> DataFrame:
    """Columns of the table's export: Original, Normalized, Genre, Status, Confidence, Source."""
    return tasks.select(*[F.col(c).alias(n) for c, n in (("raw_name", "Original"), ("normalized_name", "Normalized"), ("genre", "Genre"), ("status", "Status"), ("confidence", "Confidence"), ("source", "Source"))])


def report_lines(results: DataFrame, genre: str = "genre", confidence: str = "confidence", name: str = "filename") -> DataFrame:
    """(section, ord, line): a grouped text report: the mean, the genres by number, the names of each genre by confidence.

    Sorted by section and ord the lines are the text; they can be written with
    ``write.text`` from a range sort, none of them passes the driver.
    """
    mean = mean_positive(results, confidence).select(F.lit(0).alias("section"), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0.0).alias("b"), F.lit("").alias("c")).alias("ord"), F.concat(F.lit("평균 신뢰도: "), F.format_string("%.1f%%", F.col("mean_positive") * 100)).alias("line"))
    shares = distribution(results, genre)
    counts = shares.select(F.lit(1).alias("section"), F.struct(F.col("rank").cast("long").alias("a"), F.lit(0.0).alias("b"), F.lit("").alias("c")).alias("ord"), F.concat(F.col("value"), F.lit(": "), F.col("n").cast("string"), F.lit("개 ("), F.format_string("%.1f%%", F.col("share") * 100), F.lit(")")).alias("line"))
    named = results.join(F.broadcast(shares.select(F.col("value").alias(genre), "rank")), genre)
    rows = named.select(F.lit(2).alias("section"), F.struct(F.col("rank").cast("long").alias("a"), (-F.col(confidence)).cast("double").alias("b"), F.col(name).alias("c")).alias("ord"), F.concat(F.lit("["), F.col(genre), F.lit("] "), F.col(name), F.lit(" "), F.format_string("%.1f%%", F.col(confidence) * 100)).alias("line"))
    return mean.unionByName(counts).unionByName(rows)


def rewrite(df: DataFrame, path: str) -> None:
    """Replace a CSV folder by rows that may have been read from it: they are written beside it first, then take its place."""
    from mulberry.operators.lineage import scratch

    spark = df.sparkSession
    aside = scratch(spark, "rewrite")
    df.write.option("header", True).option("escape", '"').csv(aside)
    spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(aside).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def authors_by_genre(authors: DataFrame) -> DataFrame:
    """(genre, n_authors): how many authors a genre has."""
    return authors.groupBy("genre").agg(F.count_distinct("author").alias("n_authors"))


def first_errors(tasks: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first errors of a run, as they are shown: a report's limit."""
    return tasks.filter(F.coalesce("error_message", F.lit("")) != "").orderBy(order).limit(n)
