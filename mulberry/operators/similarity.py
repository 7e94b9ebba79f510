"""Similarity join of titles: all pairs whose ratio of matching blocks reaches a bar, without a cross join.

The ratio is twice the letters in matching blocks over both lengths.  Blocks
match letter by letter, so they hold no more letters than both titles have,
each as often as both have it.  A title is therefore a set of tokens (letter,
which of its equals), and a pair of ratio t or more shares at least
t / 2 * (|a| + |b|) of them.  With all tokens in one order, rare ones first,
titles that share o tokens share two among the first |a| - o + 2 of the one and
the first |b| - o + 2 of the other.  Titles meet by pairs of those, if their
lengths can agree; what is left is tested by the tokens shared, and then
exactly.
"""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from mulberry.functions.normalize import fuzzy_title
from mulberry.operators.lineage import cut

#: Parts of a bar, so that bounds are integers.
PARTS = 1000


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; frequent letters of long titles count as well."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _tokens(t: Column) -> Column:
    """Letters of a text, each with its number among its equals."""
    letters = F.array_sort(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)))
    return F.transform(letters, lambda c, i: F.concat(c, (i - F.array_position(letters, c)).cast("string")))


def _with_tokens(titles: DataFrame, order: DataFrame) -> DataFrame:
    """(t, n, s): its tokens as places in the order of all, ascending."""
    placed = titles.select("t", F.explode("tokens").alias("k")).join(F.broadcast(order), "k")
    return placed.groupBy("t").agg(F.sort_array(F.collect_list("place")).alias("s")).withColumn("n", F.size("s").cast("long"))


def _keys(df: DataFrame, bar: int) -> DataFrame:
    """(t, n, s, key): a row for every two among the first tokens of a title; for every one as well, where a partner need not share two."""
    least = F.ceil(F.col("n") * bar / (2 * PARTS - bar)).cast("long")  # tokens shared with a partner of any length
    first = F.slice("s", 1, F.greatest(F.lit(1), F.col("n") - least + 2).cast("int"))
    twos = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda y: x * (1 << 31) + y)))
    ones = F.when(least < 2, F.transform(first, lambda x: -x)).otherwise(F.array().cast("array<long>"))
    return df.select("t", "n", "s", F.explode(F.concat(twos, ones)).alias("key"))


def similar_titles(left: DataFrame, right: DataFrame, bar: float = 0.85) -> DataFrame:
    """(a, b, ratio): every two different titles (columns t) of ratio ``bar`` or more, and equal ones, each pair once.

    Titles are compared as they are.  Null titles take no part; empty ones equal
    each other only.
    """
    if not 0 < bar <= 1:
        raise ValueError("the bar is above 0 and at most 1")
    whole = math.floor(bar * PARTS)
    a, b = (cut(df.select("t").filter("t is not null").distinct().withColumn("tokens", _tokens(F.col("t")))) for df in (left, right))
    tokens = a.select(F.explode("tokens").alias("k")).unionByName(b.select(F.explode("tokens").alias("k"))).groupBy("k").agg(F.count("*").alias("f"))
    # as many rows as letters times the most that one title has of a letter
    order = cut(tokens.select("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("f", "k")).cast("long").alias("place")))
    # small tables lie in one partition, which many pairs may come of
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = _keys(_with_tokens(a, order), whole).select(*(F.col(c).alias(f"{c}_a" if c != "key" else c) for c in ("t", "n", "s", "key"))).repartition(tasks, "key")
    y = _keys(_with_tokens(b, order), whole).select(*(F.col(c).alias(f"{c}_b" if c != "key" else c) for c in ("t", "n", "s", "key")))
    lengths = 2 * PARTS * F.least("n_a", "n_b") >= whole * (F.col("n_a") + F.col("n_b"))
    met = x.join(y, "key").filter(lengths & (F.col("t_a") != F.col("t_b")))
    near = met.filter(2 * PARTS * F.size(F.array_intersect("s_a", "s_b")) >= whole * (F.col("n_a") + F.col("n_b"))).select("t_a", "t_b").distinct()
    # as nondeterministic, the ratio is worked out once a pair, not before pairs are made distinct and again after
    scored = near.select(F.col("t_a").alias("a"), F.col("t_b").alias("b"), _ratio.asNondeterministic()(F.col("t_a"), F.col("t_b")).alias("ratio")).filter(F.col("ratio") >= bar)
    same = a.select("t").join(b.select("t"), "t").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("ratio"))
    return scored.unionByName(same)


def _apart(df: DataFrame) -> str:
    """What the names of helper columns begin with, and no column of a table does."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))


def _known(right: DataFrame, right_id: str, right_title: str) -> DataFrame:
    """(t, m): each different title of a table with the row of the least identifier that has it."""
    known = right.select(F.col(right_id).alias("match_id"), F.col(right_title).alias("match_title"), fuzzy_title(F.col(right_title)).alias("t")).filter("t <> ''")
    return cut(known.groupBy("t").agg(F.min(F.when(F.col("match_id").isNotNull(), F.struct("match_id", "match_title"))).alias("m")))


def _best(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, match_id, match_title, ratio, n): the best of the links of each title, and how many it has."""
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("minus"), "b")).alias("x"), F.count("*").alias("n"))
    best = best.select(F.col("a"), F.col("x.b").alias("t"), (-F.col("x.minus")).alias("ratio"), "n").join(known, "t")
    return best.select("a", F.col("m.match_id").alias("match_id"), F.col("m.match_title").alias("match_title"), "ratio", "n")


def best_titles(left: DataFrame, right: DataFrame, left_title: str, right_id: str, right_title: str, bar: float = 0.85) -> DataFrame:
    """``left`` with match_id, match_title, ratio and n_links: the row of ``right`` whose title is most like a row's own, null where none reaches the bar, and how many different titles of ``right`` reach it.

    Titles compare as ``fuzzy_title`` has them; of equal ratios the least title
    counts, of rows of one title the least identifier.  Null titles and empty
    ones match nothing.
    """
    own = _apart(left)
    rows = left.withColumn(own + "t", fuzzy_title(F.col(left_title)))
    known = _known(right, right_id, right_title)
    pairs = similar_titles(rows.select(F.col(own + "t").alias("t")).filter("t <> ''"), known.select("t"), bar)
    best = _best(pairs, known).withColumnsRenamed({"a": own + "a", "n": own + "n"})
    return rows.join(best, F.col(own + "t") == F.col(own + "a"), "left").select(*(rows[c] for c in left.columns), "match_id", "match_title", "ratio", F.coalesce(own + "n", F.lit(0)).cast("long").alias("n_links"))


def title_classes(df: DataFrame, id_col: str, title_col: str, name: str) -> DataFrame:
    """``df`` with a column ``name``: the least identifier of the rows whose titles ``fuzzy_title`` makes equal; null for null titles and empty ones."""
    own = _apart(df)
    rows = df.withColumn(own + "t", fuzzy_title(F.col(title_col)))
    least = rows.filter(F.col(own + "t") != "").groupBy(F.col(own + "t").alias(own + "k")).agg(F.min(id_col).alias(name))
    return rows.join(least, F.col(own + "t") == F.col(own + "k"), "left").select(*(rows[c] for c in df.columns), name)


def linked_titles(left: DataFrame, right: DataFrame, left_id: str, left_title: str, right_id: str, right_title: str, bar: float = 0.85) -> DataFrame:
    """All links: what ``best_titles`` gives for each row of ``left``, its class_id, and link_id, link_title and link_ratio of every title of ``right`` that reaches the bar.

    Rows of one title are a class, named by its least identifier as
    ``title_classes`` has it.  The row that names a class is there once a link;
    the others of it have the same links and are there once, with none of their
    own, as are rows without links.  A link goes to the row of ``right`` with the
    least identifier among those of one title.
    """
    own = _apart(left)
    t, a, c = own + "t", own + "a", own + "c"
    rows = left.withColumn(t, fuzzy_title(F.col(left_title)))
    known = _known(right, right_id, right_title)
    pairs = cut(similar_titles(rows.select(F.col(t).alias("t")).filter("t <> ''"), known.select("t"), bar))
    classes = cut(rows.filter(F.col(t) != "").groupBy(F.col(t).alias(a)).agg(F.min(left_id).alias(c)))
    best = classes.join(_best(pairs, known).withColumnRenamed("a", a), a, "left")
    found = rows.join(best, F.col(t) == F.col(a), "left").select(*(rows[x] for x in left.columns), t, "match_id", "match_title", "ratio", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col(c).alias("class_id"))
    links = pairs.withColumnsRenamed({"a": a, "ratio": "link_ratio"}).join(known.withColumnRenamed("t", "b"), "b").join(classes, a)
    links = links.select(a, c, F.col("m.match_id").alias("link_id"), F.col("m.match_title").alias("link_title"), "link_ratio")
    return found.join(links, (F.col(t) == F.col(a)) & (F.col(left_id) == F.col(c)), "left").drop(t, a, c)
