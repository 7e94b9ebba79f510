"""Queries of the catalogue's rules over whole tables: names, titles and links are made of the tables' columns, the SQL restates the rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions import normalize as N
from mulberry.functions import vocab as V
from mulberry.functions.titles import parse_titles, repair_jamo, standard_name, valid_genre
from mulberry.operators import archives, genres, keywords, naming, reports, review, routing
from mulberry.operators.hybrid import hybrid
from mulberry.operators.numbering import running
from mulberry.sources.dictionaries import platforms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def sql_pick(values: list, at: str) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], CAST({at} % {len(values)} + 1 AS INTEGER))"


def sql_rows(rows: list[tuple]) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# --- names -------------------------------------------------------------------------------------

_RAW = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' 1-' || (p_size + 100) || ' 完.txt' WHEN 1 THEN p_name || ' ' || (p_size + 100) || '화 完.txt' WHEN 2 THEN p_name || ' 1-' || (p_size + 100) || ' (완) + 외전' WHEN 3 THEN '[판타지] ' || p_name || ' 1-' || (p_size + 100) ELSE p_name END"
_PARSED = f"""
WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part),
b AS (SELECT p_partkey, raw, regexp_replace(regexp_replace(raw, '\\.txt$', ''), '^\\[판타지\\] ', '') AS bare FROM r),
p AS (SELECT p_partkey, raw, regexp_replace(bare, ' (1-)?[0-9]+(화)?( .*)?$', '') AS title, CASE WHEN regexp_matches(bare, ' 1-[0-9]') THEN regexp_extract(bare, ' (1-[0-9]+)', 1) WHEN regexp_matches(bare, '[0-9]화') THEN '1-' || regexp_extract(bare, ' ([0-9]+)화', 1) ELSE '' END AS range_info,
  regexp_matches(raw, '完|\\(완\\)') AS is_completed, CASE WHEN contains(raw, '+ 외전') THEN '외전' ELSE '' END AS side_story, regexp_matches(raw, '^\\[판타지\\]') AS tagged FROM b)
"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.expr(_RAW).alias("raw_name"))


@query(_PARSED + "SELECT p_partkey, title, '' AS volume_info, range_info, is_completed, side_story FROM p")
def title_parse_golden(spark: SparkSession, sf: str) -> DataFrame:
    return parse_titles(_names(spark, sf)).select("p_partkey", "title", "volume_info", "range_info", "is_completed", "side_story")


@query(_PARSED + "SELECT p_partkey, CASE WHEN tagged THEN '[판타지] ' ELSE '' END || title || CASE WHEN range_info <> '' THEN ' ' || range_info ELSE '' END || CASE WHEN is_completed THEN ' (완)' ELSE '' END || CASE WHEN side_story <> '' THEN ' + ' || side_story ELSE '' END AS standard_name FROM p")
def standard_names(spark: SparkSession, sf: str) -> DataFrame:
    name = standard_name(valid_genre(F.col("original_genre")), *map(F.col, ("title", "edition_info", "volume_info", "range_info", "is_completed", "side_story")))
    return parse_titles(_names(spark, sf)).select("p_partkey", name.alias("standard_name"))


@query("SELECT p_partkey, replace(CASE p_partkey % 2 WHEN 0 THEN 'ㄷH공ㅂlㄱr ' ELSE '' END || p_name, 'ㄷH공ㅂlㄱr', '대공비가') AS name FROM part")
def visual_jamo_repair(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, "ㄷH공ㅂlㄱr ").otherwise(""), "p_name")
    return t(spark, sf, "part").select("p_partkey", repair_jamo(raw).alias("name"))


_FILE = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' 1-' || p_size || ' (완) + 외전 1-79, 에필.txt' WHEN 1 THEN p_name || ' 1-' || p_size || ' (완).txt' WHEN 2 THEN p_name || ' 1-' || p_size || '화.txt' WHEN 3 THEN '[판타지] ' || p_name || ' 1-' || p_size || ' (완).epub' ELSE p_name || '_001.txt' END"


@query(f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace({_FILE}, '\\.(txt|epub)$', ''), '^\\[판타지\\] ', ''), '( 1-[0-9]+(화)?( .*)?|_001)$', '')) AS title FROM part")
def plain_titles(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", N.plain_title(F.expr(_FILE)).alias("title"))


@query("""
WITH j AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"genre": "' || event_type || '"}' WHEN 1 THEN '{"name": 1, "genre": ["' || event_type || '", "SF"]}' WHEN 2 THEN '{"genre": ' || event_type ELSE props END AS text FROM events)
SELECT event_id, CASE WHEN text IS NULL OR NOT json_valid(text) THEN '' WHEN json_type(text, '$.genre') = 'VARCHAR' THEN json_extract_string(text, '$.genre') WHEN json_type(text, '$.genre') = 'ARRAY' THEN array_to_string(CAST(json_extract(text, '$.genre') AS VARCHAR[]), '|') ELSE '' END AS genres FROM j""")
def json_genre(spark: SparkSession, sf: str) -> DataFrame:
    i, kind = F.col("event_id") % 4, F.col("event_type")
    text = F.when(i == 0, F.concat(F.lit('{"genre": "'), kind, F.lit('"}'))).when(i == 1, F.concat(F.lit('{"name": 1, "genre": ["'), kind, F.lit('", "SF"]}'))).when(i == 2, F.concat(F.lit('{"genre": '), kind)).otherwise(F.col("props"))
    return t(spark, sf, "events").select("event_id", F.array_join(N.json_genres(text), "|").alias("genres"))


# --- genres ------------------------------------------------------------------------------------

_CALLED = ["현대 판타지", "전쟁·밀리터리", "패러디", "공포", "로맨스 판타지", "무협", "라이트노벨", "대체 역사물", "", None]
_MAPPED = [(i, k, g) for i, (k, g) in enumerate((k, g) for g, names in V.GENRE_MAP.items() for k in names)]
_SUFFIX = ["", " 소설", " 작품"]


@query(f"""
WITH m AS (SELECT * FROM (VALUES {sql_rows(_MAPPED)}) m(pos, k, g)),
n AS (SELECT p_partkey, {sql_pick(_CALLED, "p_partkey")} || {sql_pick(_SUFFIX, "p_size")} AS name FROM part),
l AS (SELECT p_partkey, arg_min(g, (CASE WHEN k = trim(name) THEN 0 ELSE 1 END, -length(k), pos)) AS g FROM n JOIN m ON contains(trim(name), k) GROUP BY 1)
SELECT p_partkey, name, coalesce(g, '미분류') AS genre FROM n LEFT JOIN l USING (p_partkey)""")
def genre_map_exact_or_longest(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(pick(_CALLED, F.col("p_partkey")), pick(_SUFFIX, F.col("p_size")))
    return t(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("genre", genres.map_genre(F.col("name")))


_REMAP_TITLES = ["축구 감독의 회귀", "조선 왕조 연대기", "회귀한 용사", "축구 감독", "VR 게임 레벨업", "축구", "조선 왕조 마법", "야구 선수 드라마", ""]
_REMAP_GENRES = ["현판", "판타지", "무협", "퓨판"]
_RULES = [(i, target, least) for i, (target, (_, least, _, _)) in enumerate(V.TITLE_REMAP.items())]
_ORIGINS = [(target, g) for target, (gs, *_) in V.TITLE_REMAP.items() for g in gs]
_WORDS = [(target, w.lower()) for target, (_, _, ws, _) in V.TITLE_REMAP.items() for w in ws]
_FORBIDDEN = [(target, w.lower()) for target, (*_, ws) in V.TITLE_REMAP.items() for w in ws]


@query(f"""
WITH n AS (SELECT p_partkey, {sql_pick(_REMAP_GENRES, "p_partkey")} AS genre, {sql_pick(_REMAP_TITLES, "p_size")} AS title FROM part),
r AS (SELECT * FROM (VALUES {sql_rows(_RULES)}) r(pos, target, least)), o AS (SELECT * FROM (VALUES {sql_rows(_ORIGINS)}) o(target, genre)),
w AS (SELECT * FROM (VALUES {sql_rows(_WORDS)}) w(target, word)), f AS (SELECT * FROM (VALUES {sql_rows(_FORBIDDEN)}) f(target, word)),
d AS (SELECT DISTINCT genre, title FROM n),
h AS (SELECT genre, title, target, pos FROM d JOIN o USING (genre) JOIN r USING (target)
  WHERE title <> '' AND (SELECT count(*) FROM w WHERE w.target = r.target AND (contains(lower(title), word) OR contains(replace(lower(title), ' ', ''), word))) >= least
    AND NOT EXISTS (SELECT 1 FROM f WHERE f.target = r.target AND contains(lower(title), word)))
SELECT p_partkey, genre, title, coalesce((SELECT arg_min(target, pos) FROM h WHERE h.genre = n.genre AND h.title = n.title), genre) AS remapped FROM n""")
def title_remap(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "part").select("p_partkey", pick(_REMAP_GENRES, F.col("p_partkey")).alias("genre"), pick(_REMAP_TITLES, F.col("p_size")).alias("title"))
    return n.withColumn("remapped", genres.remap_by_title(F.col("genre"), F.col("title")))


_SAID = ["무협 소설", "현대 판타지", "판타지", "야구", "로맨스 판타지, 현판", "", "무협 판타지", "SF 호러"]
_PATTERNS = [(i, g, rank, "(?i)" + "|".join(ps)) for i, (g, (rank, ps)) in enumerate(V.EVIDENCE.items())]


@query(f"""
WITH x AS (SELECT p_partkey // 4 AS query_id, p_partkey % 4 AS n, p_name || ' ' || {sql_pick(_SAID, "p_size")} AS text FROM part),
e AS (SELECT * FROM (VALUES {sql_rows(_PATTERNS)}) e(pos, genre, rank, pattern)),
c AS (SELECT query_id, genre, any_value(rank) AS rank, count(*) AS score, min(n * 100 + pos) AS met FROM x JOIN e ON regexp_matches(text, pattern) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, score DESC, met) AS place FROM c)
SELECT query_id, genre, score, round(least(0.95e0, 0.6e0 + least(score, 5) * 0.07e0), 6) AS confidence FROM b WHERE place = 1 AND (score > 1 OR genre IN ({", ".join(f"'{g}'" for g in V.GENERIC_EVIDENCE)}))""")
def genre_evidence_resolve(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("p_partkey")
    df = t(spark, sf, "part").select(F.struct(F.floor(i / 4).alias("query_id"), (i % 4).alias("n")).alias("key"), F.concat("p_name", F.lit(" "), pick(_SAID, F.col("p_size"))).alias("text"))
    e = genres.text_evidence(df, "key", "text").select("key.query_id", "genre", (F.col("key.n") * 100 + F.col("pos")).alias("pos"))
    return genres.resolve_evidence(e, "query_id").withColumn("confidence", F.round("confidence", 6))


_TOLD, _SOUGHT = ["무협", "현판", "미분류"], ["무협", None, "현판", "판타지"]


@query(f"""
WITH o AS (SELECT o_orderkey AS id, {sql_pick(_TOLD, "o_orderkey")} AS kg, (o_orderkey % 100) / 100e0 AS kc, o_custkey % 4 AS n, {sql_pick(_SOUGHT, "o_custkey")} AS sg, (o_custkey * 7 % 100) / 100e0 AS sc FROM orders),
k AS (SELECT *, CASE WHEN n <= 1 THEN least(kc, 0.60e0) WHEN n = 2 THEN least(kc, 0.75e0) ELSE kc END AS k FROM o),
m AS (SELECT *, CASE WHEN sg IS NULL THEN 'keyword_only' WHEN kg = '미분류' THEN 'naver_only' WHEN kg = sg THEN 'both_agree' WHEN sc >= 0.80e0 THEN 'naver_high_confidence' WHEN k >= sc + 0.20e0 THEN 'keyword_high_confidence' WHEN sc > k THEN 'naver_higher_confidence' ELSE 'keyword_higher_confidence' END AS method FROM k)
SELECT id, CASE WHEN method IN ('naver_only', 'naver_high_confidence', 'naver_higher_confidence') THEN sg ELSE kg END AS genre,
  round(CASE method WHEN 'keyword_only' THEN kc WHEN 'naver_only' THEN sc WHEN 'both_agree' THEN least(0.95e0, 1 - (1 - kc) * (1 - sc)) WHEN 'naver_high_confidence' THEN sc WHEN 'keyword_high_confidence' THEN k WHEN 'naver_higher_confidence' THEN sc * 0.9e0 ELSE k * 0.9e0 END, 6) AS confidence, method FROM m""")
def merge_results(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    r = genres.merge_results(pick(_TOLD, o), o % 100 / 100.0, c % 4, pick(_SOUGHT, c), c * 7 % 100 / 100.0)
    return t(spark, sf, "orders").select(o.alias("id"), r.alias("r")).select("id", "r.*")


# --- authors, links, searches ------------------------------------------------------------------

_CREDIT = "CASE p_partkey % 5 WHEN 0 THEN 'Supplier #00000000' || (p_partkey % 10) WHEN 1 THEN 'plier#00000000' || (p_partkey % 10) WHEN 2 THEN 'Supplier#000000003 and others' WHEN 3 THEN 'nobody' ELSE '' END"


@query(f"""
WITH a AS (SELECT s_suppkey AS pos, replace(s_name, ' ', '') AS name, 'g' || s_nationkey AS genre FROM supplier WHERE s_suppkey <= 50),
n AS (SELECT p_partkey, {_CREDIT} AS author, replace({_CREDIT}, ' ', '') AS bare FROM part),
d AS (SELECT DISTINCT bare FROM n WHERE bare <> ''),
f AS (SELECT bare, arg_min(genre, (CASE WHEN name = bare THEN 0 ELSE 1 END, pos)) AS g FROM d JOIN a ON contains(name, bare) OR contains(bare, name) GROUP BY 1)
SELECT p_partkey, author, g AS author_genre FROM n LEFT JOIN f USING (bare)""")
def author_genres(spark: SparkSession, sf: str) -> DataFrame:
    known = t(spark, sf, "supplier").filter("s_suppkey <= 50").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("author"), F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("genre"))
    return keywords.author_genre(t(spark, sf, "part").select("p_partkey", F.expr(_CREDIT).alias("author")), known)


_LINK = "CASE page_id % 5 WHEN 0 THEN 'https://ssn.so/novel/' || page_id WHEN 1 THEN 'https://ssn.so/profile/user' || page_id WHEN 2 THEN 'https://ssn.so/board/comments/' || page_id WHEN 3 THEN 'https://ssn.so/novel/' || page_id || '/comments/1' ELSE url END"


@query(f"SELECT page_id, {_LINK} AS link, NOT (contains({_LINK}, 'ssn.so') AND (NOT contains({_LINK}, '/novel/') OR regexp_matches({_LINK}, '/(profile|author|notifications|comments)/'))) AS kept FROM pages")
def url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "pages").select("page_id", F.expr(_LINK).alias("link")).withColumn("kept", routing.is_novel_page(F.col("link")))


_PLATFORMS = [(name, rank, place) for name, (rank, place, _) in V.PLATFORMS.items()]


@query(f"""
WITH p AS (SELECT name, row_number() OVER (ORDER BY rank, place) AS ord FROM (VALUES {sql_rows(_PLATFORMS)}) p(name, rank, place))
SELECT page_id, name AS platform, CAST(ord AS INTEGER) AS ord, row_number() OVER (PARTITION BY ord ORDER BY page_id) AS turn FROM pages JOIN p ON name = {sql_pick([n for n, *_ in _PLATFORMS], "page_id")}""")
def platform_order(spark: SparkSession, sf: str) -> DataFrame:
    order = routing.platform_order(platforms(spark)).select("platform", "ord")
    pages = t(spark, sf, "pages").select("page_id", pick([n for n, *_ in _PLATFORMS], F.col("page_id")).alias("platform"))
    return running(pages.join(F.broadcast(order), "platform"), ["ord"], [F.col("page_id").asc()], name="turn")


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'master' || p_size || '권여행' WHEN 2 THEN '검' ELSE 'solo' END"
_SUB, _BY = "CASE WHEN p_partkey % 3 = 0 THEN 'sub ' || p_size ELSE '' END", "CASE WHEN p_partkey % 5 = 0 THEN 'by ' || p_brand ELSE '' END"


@query(f"""
WITH n AS (SELECT p_partkey AS id, {_TITLE} AS t, {_SUB} AS s, {_BY} AS a FROM part),
v AS (SELECT *, CASE WHEN contains(t, ' ') OR length(t) < 5 THEN t ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([가-힣])([A-Za-z])', '\\1 \\2', 'g'), '([A-Za-z])([가-힣])', '\\1 \\2', 'g'), '(\\d)([가-힣])', '\\1 \\2', 'g'), '([가-힣])(\\d)', '\\1 \\2', 'g') END AS x,
  NOT contains(trim(t), ' ') OR length(replace(t, ' ', '')) <= 6 AS short FROM n),
q AS (
  SELECT id, 1 AS k, t || ' ' || a AS query, 1 AS priority FROM v WHERE a <> ''
  UNION ALL SELECT id, 2, CASE WHEN short AND a = '' THEN '소설 ' || t ELSE t END, 2 FROM v
  UNION ALL SELECT id, 3, CASE WHEN short THEN t ELSE '소설 ' || t END, 3 FROM v
  UNION ALL SELECT id, 4, s, 4 FROM v WHERE s <> ''
  UNION ALL SELECT id, 5, s || ' ' || a, 5 FROM v WHERE s <> '' AND a <> ''
  UNION ALL SELECT id, 6, x, 4 FROM v WHERE x <> t
  UNION ALL SELECT id, 7, x || ' ' || a, 5 FROM v WHERE x <> t AND a <> '')
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS ord, query, priority FROM q""")
def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_TITLE).alias("title"), F.expr(_SUB).alias("subtitle"), F.expr(_BY).alias("author"))
    return df.select("id", F.posexplode(routing.search_queries(F.col("title"), F.col("subtitle"), F.col("author"))).alias("ord", "q")).select("id", "ord", "q.query", "q.priority")


# --- files -------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT p_partkey AS pos, substr(p_type, 1, 2) AS folder, p_brand AS stem, row_number() OVER (PARTITION BY substr(p_type, 1, 2), p_brand ORDER BY p_partkey) AS k FROM part),
u AS (SELECT DISTINCT substr(p_type, 1, 2) AS folder, p_brand AS stem, CAST(p_partkey % 7 AS BIGINT) AS no FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT folder, stem, max(k) + 8 AS most FROM n GROUP BY 1, 2),
c AS (SELECT folder, stem, unnest(range(0, most)) AS no FROM m),
f AS (SELECT folder, stem, no, row_number() OVER (PARTITION BY folder, stem ORDER BY no) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.folder = c.folder AND u.stem = c.stem AND u.no = c.no))
SELECT pos, stem || CASE WHEN no = 0 THEN '' ELSE ' (' || no || ')' END || '.txt' AS free_name FROM n JOIN f USING (folder, stem, k)""")
def collision_numbering(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    new = p.select(F.col("p_partkey").alias("pos"), F.substring("p_type", 1, 2).alias("folder"), F.concat("p_brand", F.lit(".txt")).alias("name"))
    number = F.col("p_partkey") % 7
    have = p.filter("p_partkey % 3 = 0").select(F.substring("p_type", 1, 2).alias("folder"), F.concat("p_brand", F.when(number == 0, "").otherwise(F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))), F.lit(".txt")).alias("name"))
    return naming.free_names(new, have).select("pos", "free_name")


_MEMBER = "CASE WHEN l_partkey % 4 = 0 THEN 'd' || (l_linenumber % 2) || '/i' || l_linenumber || '.jpg' WHEN l_partkey % 4 = 3 THEN 'b' || l_linenumber || '.epub' ELSE 't' || l_linenumber || '.txt' END"
_BYTES = "CAST(CASE WHEN l_partkey % 3 = 0 THEN l_quantity * 100000 ELSE l_quantity * 100 END AS BIGINT)"


@query(f"""
WITH m AS (SELECT l_orderkey AS archive, {_MEMBER} AS name, {_BYTES} AS size FROM lineitem),
x AS (SELECT *, name LIKE '%.txt' AS text, contains(name, '/') AS inside FROM m),
r AS (SELECT archive, name, size, row_number() OVER (PARTITION BY archive ORDER BY size DESC, name DESC) AS k FROM x WHERE text),
g AS (SELECT archive, count(*) FILTER (text) AS texts, count(*) FILTER (NOT inside) AS roots, min(name) FILTER (NOT inside) AS root, count(DISTINCT split_part(name, '/', 1)) FILTER (inside) AS tops FROM x GROUP BY 1),
h AS (SELECT g.*, a.name AS n1, a.size AS s1, b.size AS s2 FROM g LEFT JOIN r a ON a.archive = g.archive AND a.k = 1 LEFT JOIN r b ON b.archive = g.archive AND b.k = 2),
d AS (SELECT *, texts = 1 OR texts >= 2 AND (s1 >= greatest(1048576, 10 * greatest(s2, 1)) OR s2 <= 10240) AS single, roots = 0 AND tops > 1 AS folders, roots = 1 AND tops = 0 AS lone FROM h)
SELECT archive, CASE WHEN single THEN 'extract_single_file' WHEN folders THEN 'extract_and_recompress_folders' WHEN lone THEN 'extract_single_file' ELSE 'extract_all' END AS method, CASE WHEN single THEN n1 WHEN NOT folders AND lone THEN root END AS member FROM d""")
def archive_disposition(spark: SparkSession, sf: str) -> DataFrame:
    return archives.archive_methods(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("archive"), F.expr(_MEMBER).alias("name"), F.expr(_BYTES).alias("size"), F.lit(False).alias("is_dir")))


_ENTRY = "'n' || l_linenumber || CASE WHEN l_partkey % 6 = 0 THEN '.ZIP' ELSE '.txt' END"


@query(f"""
WITH f AS (SELECT 'x/' || l_orderkey AS folder, {_ENTRY} AS name, l_linenumber <> 7 AS is_file FROM lineitem),
a AS (SELECT *, is_file AND lower(name) LIKE '%.zip' AS arch FROM f),
n AS (SELECT *, count(*) FILTER (arch) OVER w AS n_arch, count(*) FILTER (is_file AND NOT arch) OVER w AS n_plain FROM a WINDOW w AS (PARTITION BY folder))
SELECT folder, name, CASE WHEN n_arch = 1 AND arch THEN 'process_archive' WHEN n_arch = 1 OR is_file THEN 'copy' ELSE 'leave' END AS action, CASE WHEN n_arch >= 1 OR n_plain > 3 THEN replace(folder, 'x/', '') ELSE '' END AS destination FROM n""")
def folder_disposition(spark: SparkSession, sf: str) -> DataFrame:
    return archives.folder_plan(t(spark, sf, "lineitem").select(F.concat(F.lit("x/"), F.col("l_orderkey").cast("string")).alias("folder"), F.expr(_ENTRY).alias("name"), (F.col("l_linenumber") != 7).alias("is_file")))


# --- review ------------------------------------------------------------------------------------

_STATES = [" 1-10 (완)", " 1-10 완결", " 100화 연재중", " 1-5 完 외전 연재중", " 미완", " 007", "12 (완)", " 1-20화", " _x", ""]


@query(f"""
WITH n AS (SELECT p_partkey, p_name || {sql_pick(_STATES, "p_partkey")} AS name FROM part)
SELECT p_partkey, regexp_matches(name, '미완|연재중') AND NOT regexp_matches(name, '(외전|外)\\s*(연재\\s*중|미완)') AS unfinished,
  regexp_matches(name, '완결|完|미완|_| 007|[a-z][0-9]+ - |-[0-9]+화') AS raw, NOT regexp_matches(name, '[0-9]+-[0-9]+') AND regexp_matches(name, '[a-z][0-9]+\\s*\\(완\\)') AS unclear,
  regexp_matches(name, '[0-9]+-[0-9]+') AS suspicious
FROM n""")
def name_signs(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_name", pick(_STATES, F.col("p_partkey")))
    return t(spark, sf, "part").select("p_partkey", name.alias("name")).select("p_partkey", review.is_unfinished(F.col("name")).alias("unfinished"), review.needs_normalising(F.col("name")).alias("raw"), review.needs_user(F.col("name")).alias("unclear"), review.is_suspicious(F.col("name")).alias("suspicious"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) AS step, 'b/' || o_orderkey AS from_path, 'a/' || o_orderkey AS to_path FROM orders WHERE o_orderkey % 5 <> 0")
def undo_order(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    new = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "a/").otherwise("b/"), key)
    return review.undo_steps(t(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("a/"), key).alias("old_path"), new.alias("new_path")))


@query("SELECT page_id, row_number() OVER (ORDER BY CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END ASC NULLS LAST, page_id) AS place FROM pages")
def column_sort(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("genre"))
    return reports.ranked(p, [*review.sorted_by(p, "genre"), F.col("page_id").asc()], "place").select("page_id", "place")


@query("SELECT event_id, row_number() OVER (ORDER BY CAST(floor(value) AS BIGINT) || '%', event_id) AS place FROM events")
def percent_text_sort(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select("event_id", F.concat(F.floor("value").cast("string"), F.lit("%")).alias("shown"))
    return reports.ranked(e, [F.col("shown").asc(), F.col("event_id").asc()], "place").select("event_id", "place")


@query("SELECT DISTINCT s_name AS author FROM supplier WHERE s_nationkey = 3")
def genre_authors(spark: SparkSession, sf: str) -> DataFrame:
    return review.authors_of(t(spark, sf, "supplier").select(F.col("s_name").alias("author"), F.col("s_nationkey").cast("string").alias("genre")), "3")


@query("SELECT p_brand AS genre, p_name AS keyword FROM part UNION SELECT p_brand, p_type FROM part UNION SELECT p_brand, p_name FROM part")
def keyword_union(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    return review.all_keywords(p.select(F.col("p_brand").alias("genre"), F.col("p_name").alias("keyword")), p.select(F.col("p_brand").alias("genre"), F.col("p_type").alias("kw1"), F.col("p_name").alias("kw2")))


_LISTS = {"스포츠": ["red", "blue"], "퓨판": ["green", "misty"], "역사": []}
_TARGETS = ["스포츠", "퓨판", "역사", "판타지", "무협"]


@query(f"""
WITH n AS (SELECT p_partkey, {sql_pick(_TARGETS, "p_partkey")} AS target, (p_partkey * 7 % 100) / 100e0 AS c, lower(p_name) AS low FROM part)
SELECT p_partkey, target, CASE target WHEN '스포츠' THEN contains(low, 'red') OR contains(low, 'blue') WHEN '퓨판' THEN contains(low, 'green') OR contains(low, 'misty') WHEN '판타지' THEN true ELSE c >= 0.8e0 END AS valid FROM n""")
def remap_validation(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("p_partkey")
    valid = review.valid_remap(F.col("p_name"), F.col("target"), i * 7 % 100 / 100.0, _LISTS)
    return t(spark, sf, "part").select("p_partkey", "p_name", pick(_TARGETS, i).alias("target")).select("p_partkey", "target", valid.alias("valid"))


_OWN, _HEADS = ["", "무협", "", "", "", ""], ["", "", "[로맨스] ", "", "", ""]


@query(f"""
WITH n AS (SELECT p_partkey AS task_id, {sql_pick(_HEADS, "p_partkey")} || p_name AS raw_name, p_name AS title, {sql_pick(_OWN, "p_partkey")} AS own FROM part),
c AS (SELECT lower(trim(p_name)) AS key, min(p_brand) AS genre FROM part WHERE p_size > 45 GROUP BY 1),
s AS (SELECT p_partkey AS task_id FROM part WHERE p_partkey % 6 = 3), k AS (SELECT p_partkey AS task_id FROM part WHERE p_partkey % 6 = 4)
SELECT n.task_id, CASE WHEN own <> '' THEN '무협' WHEN raw_name LIKE '[%' THEN '로판' WHEN c.key IS NOT NULL THEN c.genre WHEN s.task_id IS NOT NULL THEN '현판' WHEN k.task_id IS NOT NULL THEN '스포츠' ELSE '미분류' END AS genre,
  CASE WHEN own <> '' OR raw_name LIKE '[%' THEN 'high' WHEN c.key IS NOT NULL THEN 'high' WHEN s.task_id IS NOT NULL THEN 'high' WHEN k.task_id IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN own <> '' OR raw_name LIKE '[%' THEN 'tag' WHEN c.key IS NOT NULL THEN 'cached' WHEN s.task_id IS NOT NULL THEN 'found' WHEN k.task_id IS NOT NULL THEN 'keyword' ELSE '-' END AS source
FROM n LEFT JOIN c ON lower(trim(title)) = c.key LEFT JOIN s ON s.task_id = n.task_id LEFT JOIN k ON k.task_id = n.task_id""")
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    """All steps of the classification, with two search hits for every task that has any."""
    p, i = t(spark, sf, "part"), F.col("p_partkey")
    tasks = p.select(i.alias("task_id"), F.concat(pick(_HEADS, i), "p_name").alias("raw_name"), F.col("p_name").alias("title"), pick(_OWN, i).alias("genre"))
    known = p.filter("p_size > 45").groupBy(N.cache_key(F.col("p_name")).alias("key")).agg(F.min("p_brand").alias("genre"), F.lit("high").alias("confidence"), F.lit("cached").alias("source"))
    hits = p.filter("p_partkey % 6 = 3").select(i.alias("task_id"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("현대 판타지").alias("genre")), F.struct(F.lit(1).alias("pos"), F.lit("무협").alias("genre")))).alias("h"), F.lit("found").alias("source")).select("task_id", "h.pos", "h.genre", "source")
    words = p.filter("p_partkey % 6 = 4").select(i.alias("task_id"), F.lit("스포츠").alias("genre"))
    return genres.classify(tasks, known, hits, words).select("task_id", "genre", "confidence", "source")


@query("""
WITH g AS (SELECT event_type AS genre, value AS c, CAST(event_id AS VARCHAR) AS filename FROM events), s AS (SELECT genre, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, genre) AS rank FROM g GROUP BY 1)
SELECT 2 AS section, '[' || genre || '] ' || filename || ' ' || format('{:.1f}%', c * 100) AS line FROM g
UNION ALL SELECT 1, genre || ': ' || n || '개 (' || format('{:.1f}%', round(n / (SELECT count(*) FROM g), 6) * 100) || ')' FROM s
UNION ALL SELECT 0, '평균 신뢰도: ' || format('{:.1f}%', (SELECT round(avg(c) FILTER (c > 0), 6) FROM g) * 100)""")
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").select(F.col("event_type").alias("genre"), F.col("value").alias("confidence"), F.col("event_id").cast("string").alias("filename"))
    return review.report_lines(e).select("section", "line")


# --- the second classifier ---------------------------------------------------------------------

_FOUND, _FROM = ["판타지", "현판", "퓨판", "무협", None, "판타지"], ["naver_series_meta", "kakao_tag", "ridibooks_jsonld", "search_titles", "munpia_page"]
_KEYS, _BYS, _ON_TITLE = ["스포츠", "현판", "퓨판", "겜판", "역사", "미분류", "무협", "판타지"], [None, "선협", None], [None, "SF", None, None]
_SPECIALS, _COMPOUNDS = [("goldenrod", "로판"), ("ivory", "역사")], [("red", "blue", "스포츠", 0.9), ("misty", "green", "공포", 0.75)]
_HYBRID = f"""SELECT o_orderkey, p_name AS title, {sql_pick(_FOUND, "o_orderkey")} AS search_genre, (o_custkey * 13 % 100) / 100e0 AS search_confidence, {sql_pick(_FROM, "o_custkey")} AS search_source, {sql_pick(_KEYS, "(o_orderkey + o_custkey)")} AS keyword_genre,
  (o_orderkey * 7 % 100) / 100e0 AS keyword_confidence, o_custkey % 4 AS n_keywords, {sql_pick(_BYS, "o_orderkey")} AS author_genre, {sql_pick(_ON_TITLE, "o_custkey")} AS title_genre, (o_custkey * 3 % 100) / 100e0 AS title_confidence FROM orders JOIN part ON p_partkey = o_orderkey % 150 + 1"""


@query(f"""
WITH x AS ({_HYBRID}),
a AS (SELECT *, search_genre AS sg, search_confidence AS sc, keyword_genre AS kg, keyword_confidence AS kc, search_source AS src, replace(search_source, '_', '') AS nm, lower(title) AS low,
  search_genre IS NOT NULL AND search_confidence >= CASE WHEN search_source = 'search_titles' THEN 0.6e0 ELSE 0.8e0 END AS strong, CASE keyword_genre WHEN '현판' THEN '퓨판' ELSE keyword_genre END AS fg,
  contains(search_source, 'naver_series') OR contains(search_source, 'kakao') AS gen, contains(search_source, 'ridibooks') AS ridi, CASE WHEN n_keywords <= 1 THEN least(keyword_confidence, 0.6e0) WHEN n_keywords = 2 THEN least(keyword_confidence, 0.75e0) ELSE keyword_confidence END AS k FROM x),
v AS (SELECT *, CASE fg WHEN '스포츠' THEN contains(low, 'red') OR contains(low, 'blue') WHEN '퓨판' THEN contains(low, 'green') OR contains(low, 'misty') WHEN '판타지' THEN true ELSE kc >= 0.8e0 END AS valid,
  CASE WHEN sg IS NULL THEN 'keyword_only' WHEN kg = '미분류' THEN 'naver_only' WHEN kg = sg THEN 'both_agree' WHEN sc >= 0.8e0 THEN 'naver_high_confidence' WHEN k >= sc + 0.2e0 THEN 'keyword_high_confidence' WHEN sc > k THEN 'naver_higher_confidence' ELSE 'keyword_higher_confidence' END AS mm FROM a),
w AS (SELECT *, CASE WHEN mm IN ('naver_only', 'naver_high_confidence', 'naver_higher_confidence') THEN sg ELSE kg END AS mg,
  round(CASE mm WHEN 'keyword_only' THEN kc WHEN 'naver_only' THEN sc WHEN 'both_agree' THEN least(0.95e0, 1 - (1 - kc) * (1 - sc)) WHEN 'naver_high_confidence' THEN sc WHEN 'keyword_high_confidence' THEN k WHEN 'naver_higher_confidence' THEN sc * 0.9e0 ELSE k * 0.9e0 END, 6) AS mc FROM v),
s AS (SELECT *, CASE
  WHEN strong AND (gen OR ridi) AND sg = '현판' AND kg = '스포츠' AND kc >= 0.7e0 THEN 1
  WHEN strong AND gen AND sg = '판타지' AND fg NOT IN ('퓨판', '판타지', '겜판', '역사') AND kc >= 0.6e0 THEN 2
  WHEN strong AND gen AND sg = '판타지' AND fg IN ('퓨판', '판타지', '겜판', '역사') AND kc >= CASE fg WHEN '퓨판' THEN 0.6e0 WHEN '판타지' THEN 0.5e0 ELSE 0.7e0 END AND (kg = '현판' OR valid) THEN 3
  WHEN strong AND ridi AND sg = '퓨판' AND kg IN ('겜판', '역사') AND kc >= 0.7e0 AND valid THEN 4
  WHEN strong THEN 5 WHEN contains(title, 'goldenrod') THEN 6 WHEN contains(title, 'ivory') THEN 7 WHEN contains(low, 'red') AND contains(low, 'blue') THEN 8 WHEN contains(low, 'misty') AND contains(low, 'green') THEN 9
  WHEN sg IS NULL AND author_genre IS NOT NULL THEN 10 WHEN sg IS NULL AND title_genre IS NOT NULL AND title_confidence >= 0.8e0 THEN 11 WHEN mc >= 0.4e0 THEN 12 WHEN author_genre IS NOT NULL AND mg = '미분류' THEN 13 ELSE 14 END AS step FROM w)
SELECT o_orderkey, CASE step WHEN 1 THEN '스포츠' WHEN 2 THEN '퓨판' WHEN 3 THEN fg WHEN 4 THEN kg WHEN 5 THEN sg WHEN 6 THEN '로판' WHEN 7 THEN '역사' WHEN 8 THEN '스포츠' WHEN 9 THEN '공포' WHEN 10 THEN author_genre WHEN 11 THEN title_genre WHEN 12 THEN mg WHEN 13 THEN author_genre ELSE '미분류' END AS genre,
  round(CASE step WHEN 1 THEN least(sc, kc + 0.1e0) WHEN 2 THEN least(sc, kc) WHEN 3 THEN least(sc, kc) WHEN 4 THEN least(sc, kc) WHEN 5 THEN sc WHEN 6 THEN 0.95e0 WHEN 7 THEN 0.95e0 WHEN 8 THEN 0.9e0 WHEN 9 THEN 0.75e0 WHEN 10 THEN 0.85e0 WHEN 11 THEN title_confidence WHEN 13 THEN 0.85e0 ELSE mc END, 6) AS confidence,
  CASE step WHEN 1 THEN nm || '_sports_refined' WHEN 2 THEN nm || '_fusion_refined' WHEN 3 THEN nm || '_keyword_refined' WHEN 4 THEN CASE kg WHEN '겜판' THEN 'ridibooks_game_refined' ELSE 'ridibooks_history_refined' END WHEN 5 THEN 'naver_' || src || '_priority' WHEN 6 THEN 'special_case' WHEN 7 THEN 'special_case'
    WHEN 8 THEN 'compound_pattern' WHEN 9 THEN 'compound_pattern' WHEN 10 THEN 'author_genre_db' WHEN 11 THEN 'title_keyword_analysis' WHEN 12 THEN mm WHEN 13 THEN 'author_genre_db_fallback' ELSE mm || '_low_confidence' END AS method FROM s""")
def hybrid_genres(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = t(spark, sf, "orders").join(t(spark, sf, "part"), F.col("p_partkey") == o % 150 + 1)
    rows = rows.select(
        o, F.col("p_name").alias("title"), pick(_FOUND, o).alias("search_genre"), (c * 13 % 100 / 100.0).alias("search_confidence"), pick(_FROM, c).alias("search_source"), pick(_KEYS, o + c).alias("keyword_genre"),
        (o * 7 % 100 / 100.0).alias("keyword_confidence"), (c % 4).alias("n_keywords"), pick(_BYS, o).alias("author_genre"), pick(_ON_TITLE, c).alias("title_genre"), (c * 3 % 100 / 100.0).alias("title_confidence"),
    )
    return hybrid(rows, _SPECIALS, _COMPOUNDS, _LISTS).select("o_orderkey", "genre", "confidence", "method")


# --- names, labels, plans ----------------------------------------------------------------------

_NOTED = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' (완결)' WHEN 1 THEN p_name || '·' || p_brand WHEN 2 THEN 'Solo' ELSE '[19금] ' || p_name END"
_KNOWN = "CASE p_partkey % 3 WHEN 0 THEN p_name || '.txt' WHEN 1 THEN p_name || ' .ZIP' ELSE p_name || '.jpg' END"


@query(f"""
WITH n AS (SELECT p_partkey, p_name, {_NOTED} AS noted, {_KNOWN} AS file FROM part)
SELECT p_partkey, trim(regexp_replace(replace(replace(replace(noted, ' (완결)', ' '), '[19금] ', ' '), '·', ' '), '\\s+', ' ', 'g')) AS searched, NOT contains(trim(noted), ' ') OR length(replace(noted, ' ', '')) <= 6 AS short,
  CASE WHEN regexp_matches(file, '(?i)\\.(txt|zip)$') THEN trim(regexp_replace(file, '\\.[^.]*$', '')) ELSE file END AS stem, CASE WHEN regexp_matches(file, '(?i)\\.(txt|zip)$') THEN regexp_extract(file, '\\.[^.]*$', 0) ELSE '' END AS suffix,
  lower(regexp_replace(noted, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) AS fuzzy, '[무협] ' || p_name AS renamed, CASE WHEN p_partkey % 2 = 0 THEN '[SF] ' || p_name ELSE '[SF] [현판] ' || p_name END AS edited FROM n""")
def name_functions(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "part").select("p_partkey", "p_name", F.expr(_NOTED).alias("noted"), F.expr(_KNOWN).alias("file"))
    stem, suffix = N.split_known_suffix(F.col("file"))
    tagged = F.concat(F.when(F.col("p_partkey") % 2 == 0, "[무협] ").otherwise("[현판] "), "p_name")
    return n.select("p_partkey", N.search_title(F.col("noted")).alias("searched"), N.is_short_title(F.col("noted")).alias("short"), stem.alias("stem"), suffix.alias("suffix"), N.fuzzy_title(F.col("noted")).alias("fuzzy"), N.rename_by("[장르] 제목", F.lit("무협"), F.col("p_name")).alias("renamed"), N.edit_genre(tagged, F.lit("무협"), F.lit("SF")).alias("edited"))


@query("""
WITH n AS (SELECT p_partkey, unnest(list_filter(list_transform(string_split(p_brand || ', ' || p_type || ',', ','), lambda x: trim(x)), lambda x: x <> '')) AS a FROM part),
v AS (SELECT p_partkey, a AS form FROM n UNION SELECT p_partkey, right(a, 3) FROM n WHERE length(a) > 3 UNION SELECT p_partkey, right(a, 2) FROM n WHERE length(a) > 2)
SELECT p_partkey, form FROM v WHERE form <> 'SS'""")
def author_forms(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.explode(N.author_variants(F.concat("p_brand", F.lit(", "), "p_type", F.lit(",")), ["SS"])).alias("form"))


@query("""
WITH t AS (SELECT o_orderkey AS task_id, o_orderstatus AS genre, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, o_orderkey % 5 = 0 AS asked, CASE WHEN o_orderkey % 10 = 0 THEN '무협' END AS chosen FROM orders)
SELECT task_id, CASE WHEN asked AND confidence = 'medium' AND chosen IS NOT NULL THEN chosen ELSE genre END AS genre, CASE WHEN asked AND confidence = 'medium' AND chosen IS NOT NULL THEN 'high' ELSE confidence END AS confidence,
  CASE WHEN asked AND confidence = 'medium' AND chosen IS NOT NULL THEN '사용자' ELSE '-' END AS source, CASE WHEN asked AND confidence = 'medium' AND chosen IS NULL THEN 'skipped' ELSE 'pending' END AS status FROM t""")
def user_overrides(spark: SparkSession, sf: str) -> DataFrame:
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    level = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")
    tasks = o.select(k.alias("task_id"), F.col("o_orderstatus").alias("genre"), level.alias("confidence"), F.lit("-").alias("source"), F.lit("pending").alias("status"))
    return genres.apply_overrides(tasks, o.filter("o_orderkey % 5 = 0").select(k.alias("task_id"), F.when(k % 10 == 0, "무협").alias("selected_genre")))


_SITES, _SEEN = ["https://namu.wiki/w/", "https://example.com/", "https://gall.dcinside.com/b/"], ["판타지|소설", "무협", "", "소설"]


@query(f"""
WITH p AS (SELECT page_id, {sql_pick(_SITES, "page_id")} || page_id AS url, {sql_pick(_SEEN, "page_id")} AS seen FROM pages)
SELECT page_id, seen = '' OR regexp_matches(url, 'namu\\.wiki|dcinside\\.com') AND seen IN ('판타지|소설', '소설') AS scrape FROM p""")
def scrape_decisions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    p = t(spark, sf, "pages").select("page_id", F.concat(pick(_SITES, i), i.cast("string")).alias("url"), F.filter(F.split(pick(_SEEN, i), r"\|"), lambda x: x != "").alias("seen"))
    return p.select("page_id", genres.should_scrape(F.col("url"), F.col("seen")).alias("scrape"))


@query("""
WITH n AS (SELECT p_partkey, 'in/' || p_name || ' 1-' || (p_size + 100) || ' 完.txt' AS original_path, p_name || ' 1-' || (p_size + 100) || ' (완)' AS name, p_partkey % 7 = 0 AS skipped, p_partkey % 5 = 0 AS edited FROM part)
SELECT original_path, CASE WHEN skipped THEN '' WHEN edited THEN 'by hand.txt' ELSE CASE WHEN p_partkey % 2 = 0 THEN '[무협] ' ELSE '' END || name || '.txt' END AS normalized_path, CASE WHEN p_partkey % 2 = 0 THEN '무협' ELSE '' END AS genre, 'none' AS confidence, CASE WHEN skipped THEN 'skipped' ELSE 'pending' END AS status, '' AS error_message FROM n""")
def mapping_file(spark: SparkSession, sf: str) -> DataFrame:
    """Names of files filled in, planned and put into the rows of the mapping file."""
    i, none = F.col("p_partkey"), F.lit("")
    file = F.concat("p_name", F.lit(" 1-"), (F.col("p_size") + 100).cast("string"), F.lit(" 完.txt"))
    empty = {c: none for c in ("title", "author", "volume_info", "range_info", "side_story", "edition_info", "target_path", "error_message")}
    given = {
        "task_id": i, "raw_name": file, "original_path": F.concat(F.lit("in/"), file), "current_path": F.concat(F.lit("in/"), file), "genre": F.when(i % 2 == 0, "무협").otherwise(""), "is_completed": F.lit(False),
        "user_edited": i % 5 == 0, "normalized_name": F.when(i % 5 == 0, "by hand").otherwise(""), "status": F.when(i % 7 == 0, "skipped").otherwise("pending"), "confidence": F.lit("none"),
    }
    tasks = t(spark, sf, "part").select(*[c.alias(n) for n, c in (empty | given).items()])
    return reports.mapping_rows(naming.plan_names(naming.fill_from_names(tasks)))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS genre, count(DISTINCT s_name) AS n_authors FROM supplier GROUP BY 1")
def genre_author_counts(spark: SparkSession, sf: str) -> DataFrame:
    return review.authors_by_genre(t(spark, sf, "supplier").select(F.col("s_name").alias("author"), F.col("s_nationkey").cast("string").alias("genre")))


@query("SELECT o_orderkey, 'broken ' || o_custkey AS error_message FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 10")
def shown_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A report's first ten errors; the limit is the feature."""
    rows = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("broken "), F.col("o_custkey").cast("string"))).alias("error_message"))
    return review.first_errors(rows, "o_orderkey")
