"""Queries of the platforms' extractors: the pages of the table with a piece of each platform's markup in front, and the rules in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions.platforms import clean_page_title, page_fields, page_name, platform_genre

WORDS = ["현대판타지", "무협", "로맨스", "스포츠", "대체역사", "SF", "없음"]
#: Platform, address and markup around a word.
MARKUP = [
    ("ridibooks", "https://ridibooks.com/books/", '<script type="application/ld+json">{"genre": "%s"}</script>'),
    ("munpia", "https://novel.munpia.com/", '<p class="meta-path">홈 > 웹소설 > %s</p>'),
    ("naver_series", "https://series.naver.com/novel/", '<meta name="description" content="소개 #%s">'),
    ("kakao", "https://page.kakao.com/content/", '<span class="break-all align-middle">%s</span>'),
    ("novelnet", "https://novelnet.co.kr/", '<meta name="keywords" content="%s, 소개">'),
    ("novelpia", "https://novelpia.com/novel/", '<span class="hashtag">#%s</span>'),
    ("joara", "https://www.joara.com/book/", '<div class="items"><span>%s</span></div>'),
    ("webtoonguide", "https://webtoonguide.com/", '<div class="sc-gEvEer"><b>웹소설</b><div class="sc-cwHptR">%s</div></div>'),
    ("mrblue", "https://mrblue.com/", '<span class="badge">%s</span>'),
    ("kyobo", "https://product.kyobobook.co.kr/detail/", '<div class="category">홈 > 국내도서 > %s소설</div>'),
    ("yes24", "http://www.yes24.com/product/goods/", '<script type="application/ld+json">{"@type": "Book", "genre": ["국내", "%s"]}</script>'),
    ("aladin", "https://www.aladin.co.kr/", '<a href="/x?CID=1">%s</a>'),
]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def platform_pages(pages: DataFrame) -> DataFrame:
    """(page_id, platform, url, html): each page as one of a platform, by its number."""
    i = F.col("page_id") % len(MARKUP)
    n = F.when(i == 2, len(WORDS) - 1).otherwise(len(WORDS))
    word = _pick(WORDS, F.floor(F.col("page_id") / len(MARKUP)) % n)
    markup = F.replace(_pick([m for *_, m in MARKUP], i), F.lit("%s"), word)
    return pages.select("page_id", _pick([p for p, *_ in MARKUP], i).alias("platform"), F.concat(_pick([u for _, u, _ in MARKUP], i), F.col("page_id").cast("string")).alias("url"), F.concat(markup, F.coalesce("html", F.lit(""))).alias("html"))


def platform_page_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = platform_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("p", page_fields("html"))
    found = p.select("page_id", "platform", platform_genre(F.col("platform"), F.col("p"), F.col("url")).alias("g"))
    return found.select("page_id", "platform", "g.genre", "g.raw_genre", "g.source", "g.confidence")


def _platform_sql() -> str:
    platforms = ", ".join(f"({i}, '{p}')" for i, (p, *_) in enumerate(MARKUP))
    words = ", ".join(f"({i}, '{w}')" for i, w in enumerate(WORDS))
    return f"""
WITH t AS (
  SELECT page_id, page_id % 12 AS i, (page_id // 12) % (CASE WHEN page_id % 12 = 2 THEN 6 ELSE 7 END) AS n,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS txt
  FROM pages
), w AS (
  SELECT page_id, i, p.platform, w.word, CASE word WHEN '현대판타지' THEN '현판' WHEN '로맨스' THEN '로판' WHEN '대체역사' THEN '역사' WHEN '없음' THEN NULL ELSE word END AS g,
         CASE WHEN contains(txt, 'BL') THEN 'BL' WHEN contains(txt, 'SF') THEN 'SF' WHEN i = 1 THEN '소설' END AS told
  FROM t JOIN (VALUES {platforms}) p(k, platform) ON k = i JOIN (VALUES {words}) w(j, word) ON j = n
), r AS (
  SELECT page_id, platform, word, told, CASE
    WHEN i = 7 AND word IN ('스포츠', 'SF') THEN NULL
    WHEN i = 9 AND word = '현대판타지' THEN '판타지'
    WHEN i = 9 AND word = '없음' THEN '소설'
    WHEN i = 5 AND word = '대체역사' THEN NULL
    ELSE g END AS own,
    i IN (1, 3, 4, 5, 8) AS tells, i
  FROM w
)
SELECT page_id, platform,
       CASE WHEN own IS NOT NULL THEN own WHEN i = 5 AND word = '대체역사' THEN '역사' WHEN tells THEN CASE told WHEN 'BL' THEN '로판' ELSE told END END AS genre,
       CASE WHEN own IS NOT NULL THEN CASE WHEN i = 9 AND word = '없음' THEN '소설' WHEN i = 9 AND word = '스포츠' THEN '스포츠' WHEN i = 9 THEN word || '소설' ELSE word END
            WHEN i = 5 AND word = '대체역사' THEN word WHEN tells THEN told END AS raw_genre,
       CASE WHEN own IS NOT NULL THEN
              CASE i WHEN 0 THEN '리디북스_jsonld' WHEN 1 THEN '문피아_meta_path' WHEN 2 THEN '네이버시리즈_meta' WHEN 3 THEN '카카오페이지_tag' WHEN 4 THEN '소설넷_meta' WHEN 5 THEN '노벨피아_hashtag'
                     WHEN 6 THEN '조아라_selenium' WHEN 7 THEN '웹툰가이드_selenium' WHEN 8 THEN '미스터블루_tag' WHEN 9 THEN '교보문고_category' WHEN 10 THEN 'yes24_jsonld' ELSE '알라딘_category' END
            WHEN i = 5 AND word = '대체역사' THEN '노벨피아_page'
            WHEN tells AND told IS NOT NULL THEN CASE i WHEN 1 THEN '문피아_page' WHEN 3 THEN '카카오페이지_page' WHEN 4 THEN '소설넷_page' WHEN 5 THEN '노벨피아_page' ELSE '미스터블루_page' END END AS source,
       CAST(CASE WHEN own IS NOT NULL THEN CASE i WHEN 0 THEN 0.95 WHEN 1 THEN 0.92 WHEN 2 THEN 0.88 WHEN 3 THEN 0.9 WHEN 4 THEN 0.88 WHEN 5 THEN 0.92 WHEN 7 THEN 0.75 WHEN 10 THEN 0.7 ELSE 0.85 END
            WHEN i = 5 AND word = '대체역사' THEN 0.8
            WHEN tells AND told IS NOT NULL THEN CASE i WHEN 1 THEN 0.85 WHEN 3 THEN 0.85 WHEN 4 THEN 0.8 WHEN 5 THEN 0.8 ELSE 0.75 END END AS DOUBLE) AS confidence
FROM r"""


PLATFORM_SQL = _platform_sql()

#: What platforms put around a title, by the page's number.
FRAMES = [
    ("ridibooks", "", " - 판타지 웹소설 - 리디"), ("munpia", "[연재] ", " - 웹소설 문피아"), ("naver_series", "(완결) ", " | 네이버 시리즈"), ("kakao", "", " - 웹소설 | 카카오페이지"),
    ("novelpia", "노벨피아 - 웹소설로 꿈꾸는 세상! - ", ""), ("webtoonguide", "[웹소설/소설] ", " [단행본]"), ("yes24", "", " | 홍길동 | 출판사 - 예스24"), ("kyobo", "", " 7(1부 완결) | 홍길동 - 교보문고"), ("aladin", "", " 1-5 완결 /출판사 - 알라딘"),
]


def platform_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all parts as titles of platforms' pages, cleaned of what the platform adds."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    i = F.col("p_partkey") % len(FRAMES)
    platform = _pick([p for p, *_ in FRAMES], i)
    title = F.concat(_pick([a for _, a, _ in FRAMES], i), F.col("p_name"), _pick([b for *_, b in FRAMES], i))
    return parts.select("p_partkey", platform.alias("platform"), clean_page_title(platform, title).alias("title"))


TITLE_SQL = f"""
SELECT p_partkey, list_extract([{", ".join(f"'{p}'" for p, *_ in FRAMES)}], CAST(p_partkey % {len(FRAMES)} + 1 AS INTEGER)) AS platform, p_name AS title FROM part"""


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title by which each page is verified, as its platform takes it."""
    p = platform_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("p", page_fields("html"))
    return p.select("page_id", page_name(F.col("platform"), F.col("p")).alias("title"))
