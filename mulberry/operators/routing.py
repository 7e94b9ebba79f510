"""Search hits and addresses: platforms, first occurrences, the best hits per platform, queries in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.functions import vocab as V
from mulberry.functions.normalize import bare_url, is_short_title, spaced_title

#: Hits per platform; fewer where a page costs a browser.
HITS, BROWSER_HITS, BROWSER_PLATFORMS = 3, 2, ["joara", "webtoonguide"]


def platform_of(url: Column) -> Column:
    """Platform of an address by the first pattern that fits; null for others."""
    out = F
    for name, forms in V.PLATFORM_URLS:
        fits = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [url.contains(p) for p in parts]) for parts in forms])
        out = out.when(fits, name)
    return out.otherwise(None)


def first_by_url(hits: DataFrame, group: str, rank: str, url: str, whole: bool = False) -> DataFrame:
    """The first hit of every address in a group; addresses are cut at "?" unless ``whole``."""
    key = F.col(url) if whole else bare_url(F.col(url))
    w = Window.partitionBy(group, key).orderBy(rank)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_hits(hits: DataFrame, group: str, rank: str, platform: str = "platform") -> DataFrame:
    """The first hits of each platform in a group, by rank."""
    w = Window.partitionBy(group, platform).orderBy(rank)
    most = F.when(F.col(platform).isin(BROWSER_PLATFORMS), BROWSER_HITS).otherwise(HITS)
    return hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= HITS).filter(F.col("_n") <= most).drop("_n")


def is_novel_page(link: Column) -> Column:
    """False for a site's pages that are no novels."""
    site = link.contains("ssn.so")
    return ~(site & (link.rlike("/profile/|/author/|/notifications/|/comments/") | ~link.contains("/novel/")))


def platform_order(platforms: DataFrame) -> DataFrame:
    """Add ``ord``: by priority, then by place in the list. Platforms are few."""
    return platforms.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("priority", "list_pos")))


def first_result(results: DataFrame, group: str, order: str) -> DataFrame:
    """The first result with a genre of each group; min_by on a unique order is exact."""
    return results.filter(F.coalesce("genre", F.lit("")) != "").groupBy(group).agg(F.min_by(F.struct("genre", "query"), order).alias("r")).select(group, "r.genre", "r.query")


def search_queries(title: Column, subtitle: Column, author: Column) -> Column:
    """array of struct(query, priority) in the order they are tried."""
    short, named, sub = is_short_title(title), F.coalesce(author, F.lit("")) != "", F.coalesce(subtitle, F.lit("")) != ""
    novel, spaced = F.concat(F.lit("소설 "), title), spaced_title(title)
    other = spaced != title

    def q(when: Column, text: Column, priority: int) -> Column:
        return F.when(when, F.struct(text.alias("query"), F.lit(priority).alias("priority")))

    def both(a: Column, b: Column) -> Column:
        return F.concat(a, F.lit(" "), b)

    yes = F.lit(True)
    return F.array_compact(
        F.array(
            q(named, both(title, author), 1),
            q(yes, F.when(short & ~named, novel).otherwise(title), 2),
            q(yes, F.when(short, title).otherwise(novel), 3),
            q(sub, subtitle, 4),
            q(sub & named, both(subtitle, author), 5),
            q(other, spaced, 4),
            q(other & named, both(spaced, author), 5),
        )
    )
