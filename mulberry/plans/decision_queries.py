"""Queries of the rules that decide on a genre or a title, over whole tables; the SQL states the rules anew, over the same fixed values as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions import html, matching
from mulberry.functions import normalize as N
from mulberry.functions import rules
from mulberry.functions import vocab as V
from mulberry.operators import first_rule, genres, inference, keywords, review, similarity, versions
from mulberry.plans.rule_queries import pick, sql_pick, sql_rows, t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- keywords ----------------------------------------------------------------------------------

_KEYED = "SELECT DISTINCT 'g' || (item_id % 7) AS genre, lower(word) AS word FROM (SELECT item_id, unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM benchmark) WHERE length(word) >= 4"


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all benchmark items as keywords of seven genres, weighing as much as they are long."""
    words = t(spark, sf_dir, "benchmark").select((F.col("item_id") % 7).cast("int").alias("genre_pos"), F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).filter("length(w) >= 4")
    return words.select("genre_pos", F.concat(F.lit("g"), F.col("genre_pos").cast("string")).alias("genre"), F.lit(0).alias("pos"), F.lower("w").alias("keyword"), F.length("w").alias("weight")).distinct()


@query(f"""
WITH k AS ({_KEYED}), w AS (SELECT DISTINCT word FROM k),
m AS (SELECT doc_id, genre, word FROM (SELECT doc_id, word FROM documents JOIN w ON contains(lower(text), word)) JOIN k USING (word)),
i AS (SELECT DISTINCT o.genre, o.word AS outside, x.word AS word FROM k o JOIN k x ON o.genre = x.genre AND o.word <> x.word AND contains(o.word, x.word)),
d AS (SELECT DISTINCT m.doc_id, i.genre, i.word FROM m JOIN i ON i.genre = m.genre AND i.outside = m.word)
SELECT doc_id, genre, count(*) AS n_keywords, CAST(sum(length(word)) AS BIGINT) AS weight FROM m ANTI JOIN d USING (doc_id, genre, word) GROUP BY 1, 2""")
def dictionary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of a dictionary of thousands in every document, without those within longer ones of their genre: one walk over each text."""
    found = keywords.keyword_matches(t(spark, sf_dir, "documents"), _dictionary(spark, sf_dir), "doc_id", "text")
    return found.groupBy("doc_id", "genre").agg(F.count("*").alias("n_keywords"), F.sum("weight").cast("long").alias("weight"))


_SURE = {"스포츠": ["gear", "Rod"], "현판": ["bolt"], "역사": ["RING", "gear"]}
_LESS = [(0, "무협", 0, "red", 5), (0, "무협", 1, "pl", 2), (1, "판타지", 0, "hot", 5), (1, "판타지", 1, "ate", 3), (2, "공포", 0, "widget", 30), (2, "공포", 1, "Hot", 9), (3, "SF", 0, "old", 4), (3, "SF", 1, "small", 4)]


@query(f"""
WITH s(ord, genre, pos, word) AS (VALUES {sql_rows([(i, g, j, w) for i, (g, ws) in enumerate(_SURE.items()) for j, w in enumerate(ws)])}), k(ord, genre, pos, word, weight) AS (VALUES {sql_rows(_LESS)}),
h AS (SELECT p_partkey, s.ord, any_value(genre) AS genre, list(word ORDER BY pos) AS words FROM part JOIN s ON contains(lower(p_name), lower(word)) GROUP BY 1, 2),
a AS (SELECT p_partkey, arg_min(genre, ord) AS genre, arg_min(words, ord) AS words FROM h GROUP BY 1),
l AS (SELECT p_partkey, k.ord, any_value(genre) AS genre, sum(weight) AS n, list(word ORDER BY pos) AS words FROM part JOIN k ON contains(p_name, word) GROUP BY 1, 2),
b AS (SELECT p_partkey, arg_max(genre, (n, -ord)) AS genre, arg_max(words, (n, -ord)) AS words, max(n) AS n FROM l GROUP BY 1)
SELECT p_partkey, coalesce(a.genre, b.genre) AS genre, CASE WHEN a.genre IS NOT NULL THEN 0.9e0 WHEN b.genre IS NOT NULL THEN least(0.6e0, b.n / 20e0) ELSE 0e0 END AS confidence, array_to_string(coalesce(a.words, b.words, []), ',') AS matched
FROM part LEFT JOIN a USING (p_partkey) LEFT JOIN b USING (p_partkey)""")
def title_keyword_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = spark.createDataFrame(_LESS, "genre_pos int, genre string, pos int, keyword string, weight int")
    found = keywords.title_keywords(t(spark, sf_dir, "part"), kw, "p_partkey", "p_name", _SURE)
    return found.select("p_partkey", "genre", "confidence", F.array_join("matched_keywords", ",").alias("matched"))


@query("""
WITH v AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS valid_from, arg_max(o_orderpriority, o_orderkey) AS genre FROM orders GROUP BY 1, 2),
f AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) - 30 AS t FROM orders)
SELECT o_orderkey, CAST(t AS VARCHAR) AS t, CASE WHEN genre <> '5-LOW' THEN genre END AS genre FROM f ASOF LEFT JOIN v ON o_custkey = k AND t >= valid_from""")
def genre_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of a customer thirty days before each order: versions by order, those of low priority end what was known."""
    o = t(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    rows = o.select("o_custkey", F.col("day").alias("valid_from"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("genre"), (F.col("o_orderpriority") == "5-LOW").alias("gone"))
    facts = o.select("o_orderkey", "o_custkey", F.date_sub("day", 30).alias("t"))
    return versions.as_of_join(facts, rows, "o_custkey", "t", ["genre"], order=["seq"]).select("o_orderkey", F.col("t").cast("string").alias("t"), "genre")


# --- platforms ---------------------------------------------------------------------------------

_SITES = list(V.PLATFORMS)
_GENRES = ["판타지", "현판", "무협", "소설", "스포츠", "", "역사", "겜판", None]
_RANKED = [(p, rank * 100 + place) for p, (rank, place, _) in V.PLATFORMS.items()]
_SPECIFIC = [(g, n) for n, gs in V.SPECIFICITY.items() for g in gs]
_AT, _G = "(l_linenumber * 5 + l_orderkey)", "(l_partkey + l_linenumber)"
_TITLES = ["제목", "축구 감독", "조선의 황제", "VR 게임 스킬", "회귀한 기사", "마왕과 야구 선수", "소설 속 전쟁 제국", "title"]
_MOVES = [(i, target, least) for i, (target, (_, least, *_)) in enumerate(V.TITLE_REMAP.items())]
_FROM = [(target, g) for target, (gs, *_) in V.TITLE_REMAP.items() for g in gs]
_HITS = [(target, w.lower(), forbids) for target, (*_, ws, fs) in V.TITLE_REMAP.items() for words, forbids in ((ws, False), (fs, True)) for w in words]


@query(f"""
WITH RECURSIVE e AS (SELECT l_orderkey AS query_id, {sql_pick(_TITLES, "(l_orderkey // 7)")} AS title, {sql_pick(_SITES, _AT)} AS platform, {sql_pick(_GENRES, _G)} AS genre, round(l_discount * 10, 2) AS c, l_returnflag = 'R' AS sports, l_returnflag = 'A' AS fantasy FROM lineitem),
p(platform, turn) AS (VALUES {sql_rows(_RANKED)}), s(genre, n) AS (VALUES {sql_rows(_SPECIFIC)}), m(pos, target, least) AS (VALUES {sql_rows(_MOVES)}), o(target, genre) AS (VALUES {sql_rows(_FROM)}), w(target, word, forbids) AS (VALUES {sql_rows(_HITS)}),
d AS (SELECT DISTINCT title, genre FROM e),
h AS (SELECT title, genre, target, pos FROM d JOIN o USING (genre) JOIN m USING (target) JOIN w USING (target) GROUP BY ALL
  HAVING count(*) FILTER (NOT forbids AND (contains(lower(title), word) OR contains(replace(lower(title), ' ', ''), word))) >= any_value(least) AND count(*) FILTER (forbids AND contains(lower(title), word)) = 0),
t AS (SELECT title, genre, arg_min(target, pos) AS target FROM h GROUP BY 1, 2),
r AS (SELECT query_id, {{'platform': platform, 'genre': genre, 'c': c}} AS own, {{'platform': platform, 'genre': coalesce(target, genre), 'c': CASE WHEN target IS NULL OR target = genre THEN c ELSE greatest(0.85e0, c - 0.03e0) END}} AS mine, coalesce(n, 2) AS n,
    sports AND genre = '현판' AS holds_modern, fantasy AND genre = '판타지' AS holds_fantasy, platform IN ('리디북스', '문피아') AS first_two,
    bool_or(platform = '리디북스') OVER q AND bool_or(platform = '문피아') OVER q AS two, row_number() OVER (PARTITION BY query_id ORDER BY turn, genre, c, sports, fantasy) AS i
  FROM e JOIN p USING (platform) LEFT JOIN s USING (genre) LEFT JOIN t USING (title, genre) WHERE coalesce(genre, '') <> '' WINDOW q AS (PARTITION BY query_id)),
a AS (SELECT query_id, 0::BIGINT AS i, false AS done, NULL::STRUCT(platform VARCHAR, genre VARCHAR, c DOUBLE) AS out, NULL::STRUCT(platform VARCHAR, genre VARCHAR, c DOUBLE) AS ridi, 0 AS ridi_n, NULL::STRUCT(platform VARCHAR, genre VARCHAR, c DOUBLE) AS modern, NULL::STRUCT(platform VARCHAR, genre VARCHAR, c DOUBLE) AS fantasy, NULL::STRUCT(platform VARCHAR, genre VARCHAR, c DOUBLE) AS novel FROM r GROUP BY 1
  UNION ALL
  SELECT query_id, i, does IN ('best', 'own', 'mine'), CASE does WHEN 'best' THEN CASE WHEN ridi IS NULL OR n > ridi_n THEN own ELSE ridi END WHEN 'own' THEN own WHEN 'mine' THEN mine END, CASE does WHEN 'ridi' THEN own ELSE ridi END, CASE does WHEN 'ridi' THEN n ELSE ridi_n END,
    CASE does WHEN 'modern' THEN own ELSE modern END, CASE does WHEN 'fantasy' THEN own ELSE fantasy END, CASE does WHEN 'novel' THEN coalesce(novel, mine) ELSE novel END
  FROM (SELECT r.query_id, r.i, r.own, r.mine, r.n, a.ridi, a.ridi_n, a.modern, a.fantasy, a.novel,
      CASE WHEN two AND first_two AND own.platform = '리디북스' THEN 'ridi' WHEN two AND first_two THEN 'best' WHEN holds_modern THEN 'modern' WHEN holds_fantasy THEN 'fantasy'
        WHEN a.modern IS NOT NULL AND own.genre IN ('스포츠', '역사') OR a.fantasy IS NOT NULL AND own.genre IN ('역사', '겜판', '퓨판', '스포츠') THEN 'own' WHEN a.fantasy IS NOT NULL AND own.genre = '판타지' THEN ''
        WHEN a.ridi IS NOT NULL AND a.ridi.genre <> '소설' AND a.ridi_n >= n THEN '' WHEN a.modern IS NOT NULL AND mine.genre IN ('스포츠', '역사') OR a.fantasy IS NOT NULL AND mine.genre IN ('역사', '겜판', '퓨판', '스포츠') THEN 'mine'
        WHEN mine.genre = '소설' THEN 'novel' ELSE 'mine' END AS does
    FROM a JOIN r ON r.query_id = a.query_id AND r.i = a.i + 1 WHERE NOT a.done)),
l AS (SELECT query_id, arg_max(coalesce(out, ridi, modern, fantasy, novel), i) AS o FROM (SELECT query_id, i, out, ridi, modern, fantasy, novel FROM a WHERE i > 0) GROUP BY 1)
SELECT query_id, o.platform AS platform, o.genre AS genre, round(o.c, 6) AS confidence FROM l""")
def platform_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results that lines of an order give of platforms, fused under the order's title."""
    line, key = t(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    title, platform, genre = pick(_TITLES, F.floor(key / 7)), pick(_SITES, F.col("l_linenumber") * 5 + key), pick(_GENRES, F.col("l_partkey") + F.col("l_linenumber"))
    rows = line.select(key.alias("query_id"), title.alias("title"), platform.alias("platform"), genre.alias("genre"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), (F.col("l_returnflag") == "R").alias("needs_sports_check"), (F.col("l_returnflag") == "A").alias("needs_fantasy_refinement"))
    return genres.fuse_platforms(rows)


# --- names -------------------------------------------------------------------------------------

_SAID = [w.removeprefix("/(?U)\\b(") for groups, forbidden, *_ in inference.RULES for g in groups for w in [*g[:2], *forbidden[:1]] if not w.startswith("/")] + ["1999년", "sss급", "마나", "협", "엘프"]
_OWN = [(0, "판타지", "마나"), (0, "판타지", "엘프"), (1, "무협", "협"), (1, "무협", "red"), (2, "게임", "gear"), (2, "게임", "old")]
_WORDS = [(i, j, w, 0) for i, (gs, *_) in enumerate(inference.RULES, 1) for j, g in enumerate(gs) for w in g if not w.startswith("/")]
_REGEX = [(i, j, w[1:].replace("(?U)", "").replace("\\b", "(?:^|[^\\p{L}\\p{N}_])"), 1) for i, (gs, *_) in enumerate(inference.RULES, 1) for j, g in enumerate(gs) for w in g if w.startswith("/")]
_BUT = [(i, w) for i, (_, fs, *_) in enumerate(inference.RULES, 1) for w in fs]
_OUT = [(i, len(gs), g, c) for i, (gs, _, g, c) in enumerate(inference.RULES, 1)]


@query(f"""
WITH n AS (SELECT p_partkey AS pos, lower(p_name || ' ' || {sql_pick(_SAID, "p_partkey")} || ' ' || {sql_pick(_SAID, "(p_partkey // 7 + p_size)")}) AS low FROM part),
w(rule, grp, word, kind) AS (VALUES {sql_rows(_WORDS + _REGEX)}), f(rule, word) AS (VALUES {sql_rows(_BUT)}), o(rule, n, genre, confidence) AS (VALUES {sql_rows(_OUT)}), k(gpos, genre, word) AS (VALUES {sql_rows(_OWN)}),
h AS (SELECT pos, rule, count(DISTINCT grp) AS met FROM n JOIN w ON CASE kind WHEN 0 THEN contains(low, word) ELSE regexp_matches(low, word) END GROUP BY 1, 2),
x AS (SELECT DISTINCT pos, rule FROM n JOIN f ON contains(low, word)),
r AS (SELECT pos, min(rule) AS rule FROM h JOIN o USING (rule) ANTI JOIN x USING (pos, rule) WHERE met = o.n GROUP BY 1),
c AS (SELECT pos, gpos, genre, count(*) AS score FROM n JOIN k ON contains(low, word) GROUP BY ALL),
b AS (SELECT pos, arg_max(genre, (score, -gpos)) AS genre, max(score) AS score FROM c GROUP BY 1)
SELECT n.pos, CASE WHEN r.rule IS NOT NULL THEN o.genre WHEN score >= 2 THEN b.genre WHEN score = 1 AND b.genre IN ({", ".join(f"'{g}'" for g in inference.ALONE_ENOUGH)}) THEN b.genre END AS genre,
  CASE WHEN r.rule IS NOT NULL THEN o.confidence WHEN score >= 2 THEN 'high' WHEN score = 1 AND b.genre IN ({", ".join(f"'{g}'" for g in inference.ALONE_ENOUGH)}) THEN 'medium' ELSE 'low' END AS confidence
FROM n LEFT JOIN r USING (pos) LEFT JOIN o USING (rule) LEFT JOIN b USING (pos)""")
def legacy_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with two words of the rules each, inferred by rules and keywords."""
    i = F.col("p_partkey")
    names = t(spark, sf_dir, "part").select(i.alias("pos"), F.concat_ws(" ", "p_name", pick(_SAID, i), pick(_SAID, F.floor(i / 7) + F.col("p_size"))).alias("raw_name"))
    return inference.infer_genre(names, spark.createDataFrame(_OWN, "genre_pos int, genre string, keyword string"))


_TITLE = """lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')))"""


@query(f"""
WITH n AS (SELECT page_id, {_TITLE} AS title FROM pages), i AS (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z]+') AS l FROM benchmark), s AS (SELECT item_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM i),
w AS (SELECT item_id * 1000 + pos // 4 AS rule, CASE pos % 4 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS grp, word FROM s WHERE word <> ''),
h AS (SELECT page_id, rule, count(DISTINCT grp) FILTER (grp > 0) AS met, min(grp) AS least FROM n JOIN w ON contains(title, word) GROUP BY 1, 2),
o AS (SELECT rule, count(DISTINCT grp) AS needs FROM w WHERE grp > 0 GROUP BY 1)
SELECT page_id, min(rule) AS rule FROM h JOIN o USING (rule) WHERE met = needs AND least > 0 GROUP BY 1""")
def ordered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that the title of each page fits; four words of a benchmark item make a rule: one of the first two and the third must be there, the fourth must not."""
    words = t(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("pos", "word")).filter("word <> ''")
    grp = F.when(F.col("pos") % 4 == 2, 2).when(F.col("pos") % 4 == 3, 0).otherwise(1)
    terms = words.select((F.col("item_id") * 1000 + F.floor(F.col("pos") / 4)).alias("rule"), grp.alias("grp"), "word", F.lit(False).alias("pattern"))
    pages = t(spark, sf_dir, "pages").select("page_id", F.lower(html.page_title(F.col("html"))).alias("title"))
    return first_rule.first_rule(pages, terms, "page_id", "title")


_HEADS, _TAILS = [*V.TAG_SYNONYMS, *V.TAG_GENRES_KEPT, "골든아공간", "Brand"], ["", " AI번역", "손번역", " 번역가", "A번역"]
_TAG = f"{sql_pick(_HEADS, 'p_partkey')} || {sql_pick(_TAILS, 'p_size')} || {sql_pick(['', '.', ' , ', '·'], '(p_partkey // 3)')} || CASE WHEN (p_partkey // 3) % 4 > 0 THEN {sql_pick(_HEADS, '(p_partkey // 5 + p_size)')} ELSE '' END"
_BARE = r"trim(regexp_replace(x, '(?i)\s*(A[ㅣlI]?번역|AI번역|기계번역|손번역|번역가?|A[lI]?번역)\s*', '', 'g'))"


@query(f"""
WITH n AS (SELECT p_partkey, p_name, p_partkey % 11 > 0 AS tagged, {_TAG} AS tag FROM part), s(k, g) AS (VALUES {sql_rows(list(V.TAG_SYNONYMS.items()))}),
l AS (SELECT p_partkey, generate_subscripts(string_split_regex(tag, '[.,·]'), 1) AS i, trim(unnest(string_split_regex(tag, '[.,·]'))) AS x FROM n WHERE tagged),
b AS (SELECT p_partkey, i, x, {_BARE} AS bare FROM l),
g AS (SELECT p_partkey, i, CASE WHEN list_contains({V.TAG_GENRES_KEPT}, coalesce(sb.g, bare)) THEN coalesce(sb.g, bare) ELSE coalesce(sx.g, x) END AS genre FROM b LEFT JOIN s sb ON sb.k = bare LEFT JOIN s sx ON sx.k = x),
c AS (SELECT p_partkey, '[' || string_agg(genre, '.' ORDER BY i) || ']' AS category FROM g WHERE list_contains({V.TAG_GENRES_KEPT}, genre) GROUP BY 1)
SELECT p_partkey, category, p_name AS rest FROM n LEFT JOIN c USING (p_partkey)""")
def leading_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of one or two genres by any of their names, with marks of translation, in brackets of both kinds before the names of parts."""
    i, size = F.col("p_partkey"), F.col("p_size")
    third = F.floor(i / 3)
    tag = F.concat(pick(_HEADS, i), pick(_TAILS, size), pick(["", ".", " , ", "·"], third), F.when(third % 4 > 0, pick(_HEADS, F.floor(i / 5) + size)).otherwise(""))
    shown = F.when(i % 2 == 0, F.concat(F.lit("["), tag, F.lit("] "))).otherwise(F.concat(F.lit("( "), tag, F.lit(" )")))
    head = F.concat(F.when(i % 11 > 0, shown).otherwise(""), "p_name")
    return t(spark, sf_dir, "part").select("p_partkey", review.leading_tag(head).alias("x")).select("p_partkey", "x.*")


_FOUND = [*V.SOURCE_NAMES, "Other", "plain", "", None]


@query(f"""
WITH o AS (SELECT o_orderkey, {sql_pick(_FOUND, 'o_orderkey')} || {sql_pick(["", "_meta", "_JSONLD_page", " x"], 'o_custkey')} AS source FROM orders), s(ord, k, v) AS (VALUES {sql_rows([(i, k, v) for i, (k, v) in enumerate(V.SOURCE_NAMES.items())])}),
h AS (SELECT o_orderkey, arg_min(v, ord) AS label FROM o JOIN s ON contains(lower(source), k) OR contains(source, k) GROUP BY 1)
SELECT o_orderkey, CASE WHEN coalesce(source, '') = '' THEN '-' WHEN label IS NOT NULL THEN label WHEN contains(source, '_') THEN upper(substr(split_part(source, '_', 1), 1, 1)) || lower(substr(split_part(source, '_', 1), 2)) ELSE source END AS label FROM o LEFT JOIN h USING (o_orderkey)""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(pick(_FOUND, F.col("o_orderkey")), pick(["", "_meta", "_JSONLD_page", " x"], F.col("o_custkey")))
    return t(spark, sf_dir, "orders").select("o_orderkey", N.source_label(source).alias("label"))


_NAMED = """CASE p_partkey % 8 WHEN 0 THEN p_name || ' [1-' || (p_size + 100) || ']' WHEN 1 THEN p_name || p_size || '부 ' || p_size || ' - ' || (p_size + 100) WHEN 2 THEN p_name || '_001_' || (p_size + 100) || ' 외전 1-' || p_size WHEN 3 THEN p_name || ' ' || (p_size + 100) || '화 후기 번외' WHEN 4 THEN p_name || ' (00' || (p_size % 9 + 1) || '회~' || (p_size + 100) || '회) 특외' || p_size || '화'
  WHEN 5 THEN p_name || ' (~' || (p_size + 100) || ') 에필로그후기' WHEN 6 THEN p_name || '1-' || (p_size + 100) || '+추가외전' ELSE p_name END"""


@query(f"""
SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN p_name || ' ' || p_size || '부' ELSE p_name END AS title,
  CASE p_partkey % 8 WHEN 1 THEN p_size || '-' || (p_size + 100) WHEN 4 THEN (p_size % 9 + 1) || '-' || (p_size + 100) WHEN 7 THEN NULL ELSE '1-' || (p_size + 100) END AS range_info,
  CASE p_partkey % 8 WHEN 2 THEN '외전 1-' || p_size WHEN 3 THEN '번외,후기' WHEN 4 THEN '특외 ' || p_size WHEN 5 THEN '에필,후기' WHEN 6 THEN '외전,추가외전' ELSE '' END AS extras FROM part""")
def range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with ranges, parts and side stories in eight ways of writing, read by the rule tables."""
    names = t(spark, sf_dir, "part").select("p_partkey", F.expr(_NAMED).alias("name"))
    read = names.select("p_partkey", rules.range_and_extras(rules.standard_symbols(F.col("name"))).alias("r"))
    return read.select("p_partkey", "r.title", "r.range_info", F.array_join("r.extras", ",").alias("extras"))


# --- titles ------------------------------------------------------------------------------------

_PAGE = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' 12권' WHEN 1 THEN '[단행본] ' || p_name WHEN 2 THEN p_name || ' - 문피아' WHEN 3 THEN p_name || ' ' || p_brand WHEN 4 THEN p_brand || p_name || p_brand || p_brand ELSE p_type END"
_FORM = "replace(lower(regexp_replace({}, '[^A-Za-z0-9가-힣 ]', '', 'g')), ' ', '')"


@query(f"""
WITH n AS (SELECT p_partkey, p_name, {_PAGE} AS page, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE {_PAGE} END AS told FROM part),
f AS (SELECT *, {_FORM.format("p_name")} AS s, {_FORM.format("regexp_replace(told, '\\s+[0-9]+\\s*$', '')")} AS p FROM n)
SELECT p_partkey, page, s = p OR length(s) > 6 AND (contains(p, s) OR contains(s, p)) AND abs(length(s) - length(p)) / greatest(length(s), length(p)) <= 0.3 AS same FROM f""")
def title_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of parts against the titles of pages made of them and of their brands."""
    rows = t(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(_PAGE).alias("page"))
    return rows.select("p_partkey", "page", matching.same_title(F.col("p_name"), F.col("page"), F.lit(""), F.lit("")).alias("same"))


_BY = ["홍길동", "김영하,이순신", "외전", "서문 & 남궁"]
_SHAPED = f"""CASE p_partkey % 5 WHEN 0 THEN p_name || ' - ' || {sql_pick(_BY, "(p_partkey // 5)")} WHEN 1 THEN p_name || ' ' || (p_size % 9 + 1) || '부 ' || p_type WHEN 2 THEN p_name || '(' || p_type || ')' WHEN 3 THEN p_name || ' 1-' || p_size || '화' ELSE p_name || ' (완결)' END"""


@query(f"""
WITH n AS (SELECT *, {_SHAPED} AS title, {sql_pick(_BY, "(p_partkey // 5)")} AS b FROM part)
SELECT p_partkey, title, CASE WHEN p_partkey % 5 = 0 AND b = '외전' THEN title ELSE p_name END AS main_title,
  CASE p_partkey % 5 WHEN 1 THEN (p_size % 9 + 1) || '부 ' || p_type WHEN 2 THEN p_type END AS subtitle, CASE WHEN p_partkey % 5 = 0 AND b <> '외전' THEN regexp_replace(b, '\\s*([,&])\\s*', '\\1 ') END AS author FROM n""")
def title_part_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t(spark, sf_dir, "part").select("p_partkey", F.expr(_SHAPED.replace("list_extract([", "element_at(array(").replace("], CAST(", "), CAST(").replace("//", "div")).alias("title"))
    return df.select("p_partkey", "title", matching.title_parts(F.col("title")).alias("p")).select("p_partkey", "title", "p.*")


_BARE_TITLE = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_]', '', 'g'))"


@query(f"""
WITH RECURSIVE p AS (SELECT p_partkey, concat_ws(' ', p_brand, p_name) AS title, CAST(p_partkey % 9 + 1 AS INTEGER) AS pos FROM part), q AS (SELECT p_partkey, title, substr(title, 1, pos) || 'x' || substr(title, pos + 2) AS asked FROM p),
l AS (SELECT p_partkey, asked, {_BARE_TITLE.format("asked")} AS a, {_BARE_TITLE.format("title")} AS own FROM q), k AS (SELECT {_BARE_TITLE.format("title")} AS b, arg_min(title, p_partkey) AS match_title, min(p_partkey) AS match_id FROM p GROUP BY 1),
la AS (SELECT a, letter, count(*) AS n FROM (SELECT a, unnest(string_split(a, '')) AS letter FROM (SELECT DISTINCT a FROM l WHERE a <> '')) GROUP BY 1, 2), lb AS (SELECT b, letter, count(*) AS n FROM (SELECT b, unnest(string_split(b, '')) AS letter FROM k WHERE b <> '') GROUP BY 1, 2),
c AS MATERIALIZED (SELECT a, b FROM la JOIN lb USING (letter) GROUP BY 1, 2 HAVING 2 * sum(least(la.n, lb.n)) >= 0.85 * (length(a) + length(b))),
s AS (SELECT a AS x, b AS y, a, b, 0::BIGINT AS met FROM c
  UNION ALL
  SELECT unnest([substr(x, 1, i - 1), substr(x, i + n)]), unnest([substr(y, 1, j - 1), substr(y, j + n)]), a, b, unnest([n, 0])
  FROM (SELECT a, b, x, y, -f.i AS i, f.n AS n, instr(y, substr(x, -f.i, f.n)) AS j
    FROM (SELECT *, list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(list_filter(range(1, length(x) - i + 2), lambda n: contains(y, substr(x, i, n))), lambda n: {{'n': n, 'i': -i}})))) AS f FROM s WHERE x <> '' AND y <> '') WHERE f IS NOT NULL)),
r AS (SELECT a, b, 2e0 * sum(met) / (length(a) + length(b)) AS ratio FROM s GROUP BY 1, 2 HAVING 2e0 * sum(met) / (length(a) + length(b)) >= 0.85),
m AS (SELECT a, arg_min(b, (-ratio, b)) AS b, max(ratio) AS ratio, count(*) AS n FROM r GROUP BY 1),
i AS (SELECT a, min(p_partkey) AS class_id FROM l WHERE a <> '' GROUP BY 1), o AS (SELECT b AS own, match_id AS title_id FROM k WHERE b <> ''),
e AS (SELECT a, class_id AS p_partkey, match_id AS link_id, match_title AS link_title, ratio AS link_ratio FROM r JOIN i USING (a) JOIN k USING (b))
SELECT p_partkey, asked, match_id, match_title, ratio, coalesce(n, 0) AS n_links, class_id, title_id, link_id, link_title, link_ratio
FROM l LEFT JOIN m USING (a) LEFT JOIN k USING (b) LEFT JOIN i USING (a) LEFT JOIN o USING (own) LEFT JOIN e USING (a, p_partkey)""")
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands and names of all parts, a letter each changed, against all of them: every link between different titles, and what titles the parts have.

    Parts that ask the same are a class (class_id), parts of one title another
    (title_id, which link_id and match_id name).  The part that names a class has
    a row a link, each other one a row.
    """
    p = t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("title"))
    at = (F.col("p_partkey") % 9 + 1).cast("int")
    asked = F.concat(F.substring("title", F.lit(1), at), F.lit("x"), F.substring("title", at + F.lit(2), F.length("title")))
    rows = similarity.title_classes(p, "p_partkey", "title", "title_id").select("p_partkey", asked.alias("asked"), "title_id")
    return similarity.linked_titles(rows, p, "p_partkey", "asked", "p_partkey", "title").select("p_partkey", "asked", "match_id", "match_title", "ratio", "n_links", "class_id", "title_id", "link_id", "link_title", "link_ratio")
