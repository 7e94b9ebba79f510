"""The registered queries and, for those that SQL can express, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions import html as H
from mulberry.functions import normalize as N
from mulberry.operators import cache, keywords, naming, reports, routing
from mulberry.plans import decision_queries, platform_queries, rule_queries
from mulberry.plans.catalogue import page_catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows: list[tuple], columns: str) -> str:
    """A table of literal rows for SQL, of the columns of a schema text."""
    names, kinds = zip(*[c.split() for c in columns.split(", ")], strict=True)
    to = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    cast = ", ".join(f"CAST({n} AS {to[k]}) AS {n}" for n, k in zip(names, kinds, strict=True))
    body = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    return f"(SELECT {cast} FROM (VALUES {body}) AS raw({', '.join(names)}))"


# --- reports -----------------------------------------------------------------------------------


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS skipped,
       round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 1) AS success_rate FROM orders""")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.run_summary(t(spark, sf, "orders"), "o_orderstatus", "F", "P", "O")


@query("""
SELECT source AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY source""")
def genre_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distribution(t(spark, sf, "documents"), "source")


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY event_type")
def method_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reports.distribution(t(spark, sf, "events"), "event_type")


@query("SELECT round(coalesce(avg(value) FILTER (value > 0), 0), 6) AS mean_positive FROM events")
def mean_positive(spark: SparkSession, sf: str) -> DataFrame:
    return reports.mean_positive(t(spark, sf, "events"), "value")


@query("SELECT count(*) FILTER (quality = 0) AS n_0, count(*) FILTER (quality = 1) AS n_1, count(*) FILTER (toxic = 1) AS n_checked FROM labels")
def level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.level_counts(t(spark, sf, "labels"), "quality", [0, 1], F.col("toxic") == 1)


@query("""
SELECT count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS success, count(*) FILTER (l_returnflag <> 'A') AS failed, count(*) FILTER (l_returnflag IN ('A', 'R')) AS processed,
       round(count(*) FILTER (l_returnflag = 'A') / count(*), 6) AS hit_rate FROM lineitem""")
def batch_stats(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "R", "failed").otherwise("error")
    return reports.batch_stats(t(spark, sf, "lineitem").select(flag.alias("outcome")), "outcome")


@query("""
SELECT c_custkey, c_name, rank FROM (
  SELECT c_custkey, c_name, row_number() OVER (ORDER BY length(c_name) + 2 * length(regexp_replace(c_name, '[A-Za-z0-9_ ]', '', 'g')) DESC, c_custkey) AS rank FROM customer) WHERE rank <= 10""")
def complexity_top10(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select("c_custkey", "c_name")
    return reports.ranked(c, [F.desc(N.complexity(F.col("c_name"))), F.col("c_custkey").asc()], limit=10)


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderstatus = 'F') DESC, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, lower(o_orderstatus), o_orderkey) AS rank FROM orders""")
def default_sort_rank(spark: SparkSession, sf: str) -> DataFrame:
    level = F.create_map(*map(F.lit, ("1-URGENT", "high", "2-HIGH", "medium", "3-MEDIUM", "low")))
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("checked"), F.try_element_at(level, F.col("o_orderpriority")).alias("confidence"), F.col("o_orderstatus").alias("name"))
    return reports.ranked(o, [*reports.default_order(), F.col("o_orderkey").asc()]).select("o_orderkey", "rank")


# --- text functions ----------------------------------------------------------------------------


@query("SELECT p_partkey, lower(trim(p_name)) AS key FROM part")
def norm_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", N.cache_key(F.col("p_name")).alias("key"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM part")
def norm_similarity_title(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", N.similarity_title(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("title"))


@query("""
SELECT a.p_partkey AS p_partkey, round(1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity,
       1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)) >= 0.85 AS is_similar
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def levenshtein_similarity(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    x, y = F.col("p_name"), F.col("other")
    return p.join(b, "p_partkey").select("p_partkey", F.round(N.similarity(x, y), 6).alias("similarity"), N.is_similar(x, y).alias("is_similar"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# --- genres ------------------------------------------------------------------------------------


_KEYWORDS = [(0, "a", 0, "tion", 2), (0, "a", 1, "ation", 5), (1, "b", 0, "the", 1), (1, "b", 1, "thea", 4), (1, "b", 2, "x", 9), (2, "c", 0, "ing", 3), (2, "c", 1, "eding", 6), (3, "d", 0, "lich", 3), (3, "d", 1, "heit", 3)]
_KW = "genre_pos int, genre string, pos int, keyword string, weight int"
_SCORES = f"""
WITH k AS {values(_KEYWORDS, _KW)},
m AS (SELECT d.doc_id, k.* FROM documents d JOIN k ON length(k.keyword) >= 2 AND contains(lower(d.text), k.keyword)),
kept AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.genre = m.genre AND o.keyword <> m.keyword AND contains(o.keyword, m.keyword))),
n AS (SELECT genre, count(*) AS n FROM k GROUP BY genre),
s AS (SELECT doc_id, genre_pos, genre, sum(weight) / sqrt(any_value(n)) AS score FROM kept JOIN n USING (genre) GROUP BY ALL)
"""


def _doc_scores(spark: SparkSession, sf: str) -> DataFrame:
    kw = spark.createDataFrame(_KEYWORDS, _KW)
    return keywords.genre_scores(keywords.keyword_matches(t(spark, sf, "documents"), kw, "doc_id", "text"), kw, "doc_id")


@query(_SCORES + "SELECT doc_id, genre, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, genre_pos) AS rank FROM s QUALIFY rank <= 3")
def keyword_theta_score(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.top_genres(_doc_scores(spark, sf), "doc_id").select("doc_id", "genre", F.round("score", 6).alias("score"), "rank")


@query(
    _SCORES
    + """, w AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS nxt, sum(score) OVER (PARTITION BY doc_id) AS total FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, genre_pos))
SELECT doc_id, genre, round(score, 6) AS score, round(score - coalesce(nxt, 0), 6) AS gap,
       round(CASE WHEN nxt IS NULL THEN 1.0 ELSE least(1.0, score / total + least((score - nxt) / score, 0.3)) END, 6) AS confidence FROM w WHERE rank = 1"""
)
def keyword_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.best_with_confidence(_doc_scores(spark, sf), "doc_id")


_PAIRS = [("a", "tion", "the"), ("a", "ation", "heit"), ("c", "ing", "and"), ("d", "lich", "heit")]


@query(f"SELECT doc_id, genre, count(*) AS n_pairs FROM documents JOIN {values(_PAIRS, 'genre string, kw1 string, kw2 string')} k ON contains(lower(text), kw1) AND contains(lower(text), kw2) GROUP BY ALL")
def compound_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.compound_pairs(t(spark, sf, "documents"), spark.createDataFrame(_PAIRS, "genre string, kw1 string, kw2 string"), "doc_id", "text")


@query("SELECT c_mktsegment AS keyword, count(DISTINCT c_nationkey) AS n_genres, CASE count(DISTINCT c_nationkey) WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END AS specificity FROM customer GROUP BY 1")
def keyword_specificity(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.specificity(t(spark, sf, "customer").select(F.col("c_mktsegment").alias("keyword"), F.col("c_nationkey").alias("genre")))


_LISTED = [("a", "the"), ("a", "the"), ("a", "ing"), ("b", "lich")]


@query(f"SELECT doc_id, genre, count(*) AS score FROM documents JOIN {values(_LISTED, 'genre string, keyword string')} k ON contains(lower(text), keyword) GROUP BY ALL")
def list_scores(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.list_scores(t(spark, sf, "documents"), spark.createDataFrame(_LISTED, "genre string, keyword string"), "doc_id", "text")


# --- search hits and pages ---------------------------------------------------------------------


@query("""
SELECT page_id, CASE WHEN contains(u, 'ridibooks.com/books/') THEN 'ridibooks' WHEN contains(u, 'novelpia.com/novel/') THEN 'novelpia' WHEN contains(u, 'yes24.com/product/goods/') THEN 'yes24' END AS platform, split_part(u, '?', 1) AS bare
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://ridibooks.com/books/' || page_id || '?q=1' WHEN 1 THEN 'https://novelpia.com/novel/' || page_id WHEN 2 THEN 'http://www.yes24.com/product/goods/' || page_id ELSE url END AS u FROM pages)""")
def url_platform_route(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    u = F.when(i % 4 == 0, F.concat(F.lit("https://ridibooks.com/books/"), i.cast("string"), F.lit("?q=1"))).when(i % 4 == 1, F.concat(F.lit("https://novelpia.com/novel/"), i.cast("string"))).when(i % 4 == 2, F.concat(F.lit("http://www.yes24.com/product/goods/"), i.cast("string"))).otherwise(F.col("url"))
    return t(spark, sf, "pages").select("page_id", u.alias("u")).select("page_id", routing.platform_of(F.col("u")).alias("platform"), N.bare_url(F.col("u")).alias("bare"))


@query("SELECT min(page_id) AS page_id, split_part(url, '?', 1) AS bare FROM pages GROUP BY 2")
def url_first_dedup(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "pages").select(F.lit(0).alias("g"), "page_id", "url")
    return routing.first_by_url(p, "g", "page_id", "url").select("page_id", N.bare_url(F.col("url")).alias("bare"))


@query("SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 3")
def top3_per_host(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "pages").select(F.lit(0).alias("g"), "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return routing.best_hits(p, "g", "page_id", "host").select("page_id", "host")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS genre, arg_min(o_orderstatus, o_orderkey) AS query FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_custkey")
def best_first_result(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("genre"), F.col("o_orderstatus").alias("query"))
    return routing.first_result(o, "o_custkey", "o_orderkey")


@query("""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
       len(regexp_extract_all(html, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS n_links FROM pages""")
def page_titles_and_links(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", H.page_title(F.col("html")).alias("title"), F.size(H.links(F.col("html"))).cast("long").alias("n_links"))


@query()
def page_visible_text(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", H.visible_text(F.col("html")).alias("text"))


@query()
def page_genres(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", H.genre_of_page(F.col("html")).alias("g")).select("page_id", "g.*")


@query()
def page_catalogue_names(spark: SparkSession, sf: str) -> DataFrame:
    return page_catalogue(spark, sf)


QUERIES |= rule_queries.QUERIES
ORACLES |= rule_queries.ORACLES
QUERIES |= {"platform_page_genres": platform_queries.platform_page_genres, "platform_page_titles": platform_queries.platform_page_titles, "page_names": platform_queries.page_names}
ORACLES |= {"platform_page_genres": platform_queries.PLATFORM_SQL, "platform_page_titles": platform_queries.TITLE_SQL}


# --- cache and joins ---------------------------------------------------------------------------


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    return p.groupBy(N.cache_key(F.col("p_name")).alias("key")).agg(F.min("p_brand").alias("genre"), F.lit("high").alias("confidence"), F.min("p_type").alias("source"), F.lit("2024-01-01").alias("cached_at"))


@query("""
WITH c AS (SELECT lower(trim(p_name)) AS key, min(p_brand) AS genre FROM part WHERE p_size > 25 GROUP BY 1) SELECT p_partkey, c.genre AS cached_genre FROM part LEFT JOIN c ON lower(trim(p_name)) = key""")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    c = p.filter("p_size > 25").groupBy(N.cache_key(F.col("p_name")).alias("key")).agg(F.min("p_brand").alias("genre"), F.lit("high").alias("confidence"), F.lit("x").alias("source"))
    return cache.lookup(p.select("p_partkey", "p_name"), c, "p_name").select("p_partkey", "cached_genre")


@query("""
WITH old AS (SELECT lower(trim(p_name)) AS key, min(p_brand) AS genre, min(p_type) AS source FROM part GROUP BY 1),
new AS (SELECT lower(trim(p_name)) AS key, 'new' AS genre, 'x' AS source FROM part WHERE p_size > 40 GROUP BY 1)
SELECT old.key AS key, coalesce(new.genre, old.genre) AS genre, coalesce(new.source, old.source) AS source FROM old LEFT JOIN new USING (key)""")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = t(spark, sf, "part").filter("p_size > 40").select(F.col("p_name").alias("title"), F.lit("new").alias("genre"), F.lit("high").alias("confidence"), F.lit("x").alias("source"), F.lit("2025-01-01").alias("cached_at"))
    return cache.upsert(_cache(spark, sf), new).select("key", "genre", "source")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def unresolved_anti(spark: SparkSession, sf: str) -> DataFrame:
    return cache.without(t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_partkey FROM part WHERE lower(trim(p_name)) IN (SELECT lower(trim(p_name)) FROM part WHERE p_size > 45)")
def cache_semi(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    return cache.has(p.select("p_partkey", "p_name"), p.filter("p_size > 45").select(N.cache_key(F.col("p_name")).alias("key")).distinct(), "p_name").select("p_partkey")


@query("""
SELECT o_orderkey AS filename, CASE WHEN o_orderstatus = 'O' AND c_mktsegment <> 'BUILDING' THEN c_mktsegment WHEN o_orderstatus = 'O' THEN '미분류' ELSE o_orderstatus END AS genre FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def retry_update_join(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("filename"), "o_custkey", F.when(F.col("o_orderstatus") == "O", "미분류").otherwise(F.col("o_orderstatus")).alias("genre"), F.lit("low").alias("confidence"), F.lit("-").alias("source"))
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "미분류").otherwise(F.col("c_mktsegment"))
    r = o.select("filename", "o_custkey").join(t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("filename", seg.alias("genre"), F.lit("high").alias("confidence"), F.lit("retry").alias("source"))
    return cache.update_from_retry(o, r).select("filename", "genre")


# --- naming and archives -----------------------------------------------------------------------


@query("""
SELECT p_partkey AS original, CASE WHEN n = 1 THEN p_brand ELSE p_brand || ' (' || n || ')' END AS standard_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)""")
def duplicate_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return naming.number_duplicates(t(spark, sf, "part").select(F.col("p_partkey").alias("original"), "p_brand"), "original", "p_brand", "original").select("original", "standard_name")


QUERIES |= decision_queries.QUERIES
ORACLES |= decision_queries.ORACLES
