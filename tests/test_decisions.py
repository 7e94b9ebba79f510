"""Known answers of the rules that decide on genres and titles."""

from pyspark.sql import functions as F

from mulberry.functions import matching
from mulberry.operators import genres, inference, review

_FUSE = [
    (1, "제목", "리디북스", "판타지", 0.95, False, False), (1, "제목", "문피아", "현판", 0.92, False, False),
    (2, "제목", "네이버시리즈", "판타지", 0.88, False, True), (2, "제목", "카카오페이지", "겜판", 0.90, False, False),
    (3, "제목", "네이버시리즈", "현판", 0.88, True, False), (3, "제목", "노벨피아", "판타지", 0.92, False, False),
    (4, "제목", "교보문고", "소설", 0.85, False, False), (5, "축구 감독", "조아라", "현판", 0.85, False, False), (6, "제목", "리디북스", "", 0.95, False, False),
]
_FUSED = [(1, "문피아", "현판", 0.92), (2, "카카오페이지", "겜판", 0.9), (3, "노벨피아", "판타지", 0.92), (4, "교보문고", "소설", 0.85), (5, "조아라", "스포츠", 0.85)]
_INFER = [(1, "갓겜 이야기", "겜판", "high"), (2, "재벌집 검사", "현판", "high"), (3, "조선의 왕", "역사", "high"), (4, "유조선 선장", None, "low"), (5, "천마님 방송하신다", "현판", "high"), (6, "천마 강림", "무협", "high"), (7, "sss급 무언가", "퓨판", "medium"), (8, "가나다라마바사", None, "low"), (9, "감독 이야기", None, "low"), (10, "1999년의 한국", "현판", "high"), (11, "마나와 엘프", "판타지", "high"), (12, "협 하나", "무협", "medium"), (13, "엘프 하나", None, "low"), (14, "병장의 검", "퓨판", "medium")]
_INFER_KW = [(0, "판타지", "마나"), (0, "판타지", "엘프"), (1, "무협", "협")]
_MATCH = [("신세계의 사령술사", "신세계 사령술사 - 판타지 웹소설 - 리디", True), ("마왕", "마왕 2권", True), ("전혀 다른 긴 제목입니다", "무관한 것", False), ("Re 영웅 이야기들", "[완결] Re 영웅 이야기들 - 문피아", True)]
_FUZZY = [("영웅왕 그 미래는", "영웅왕 그의 미래는", True), ("영마스터여행기", "영 마스터 여행기", True), ("올 리셋 라이프", "올리셋라이프", True), ("가나다", "라마바", False)]
_PARTS = [("구룡겁 - 천중행,천중화", "구룡겁", None, "천중행, 천중화"), ("초능력 연대기 1부 더 맨이터", "초능력 연대기", "1부 더 맨이터", None), ("초능력 연대기(맨이터)", "초능력 연대기", "맨이터", None), ("제목 (완) - 홍길동", "제목", None, "홍길동"), ("트립한국 1913 1-126화", "트립한국 1913", None, None)]
_TAGS = ["[현대 판타지 AI번역] ", "(무협) ", "[판타지.무협] ", "[골든아공간] ", "[BL] ", "[게임·퓨전] ", "", "[신무협, 역사] "]
_TAGGED = {"[현대 판타지 AI번역] ": "[현판]", "(무협) ": "[무협]", "[판타지.무협] ": "[판타지.무협]", "[BL] ": "[로판]", "[게임·퓨전] ": "[겜판.퓨판]", "[신무협, 역사] ": "[무협.역사]"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fusion(spark):
    df = spark.createDataFrame(_FUSE, "query_id long, title string, platform string, genre string, confidence double, needs_sports_check boolean, needs_fantasy_refinement boolean")
    assert rows(genres.fuse_platforms(df)) == sorted(_FUSED, key=str)


def test_inference(spark):
    names = spark.createDataFrame([r[:2] for r in _INFER], "pos long, raw_name string")
    got = inference.infer_genre(names, spark.createDataFrame(_INFER_KW, "genre_pos int, genre string, keyword string"))
    assert rows(got) == sorted([(r[0], *r[2:]) for r in _INFER], key=str)


def test_titles(spark):
    df = spark.createDataFrame(_MATCH, "a string, b string, x boolean")
    assert rows(df.select("a", "b", matching.same_title(F.col("a"), F.col("b"), F.lit(""), F.lit("")))) == sorted(_MATCH, key=str)
    df = spark.createDataFrame(_FUZZY, "a string, b string, x boolean")
    assert rows(df.select("a", "b", matching.is_fuzzy_match(F.col("a"), F.col("b")))) == sorted(_FUZZY, key=str)
    df = spark.createDataFrame([(p[0],) for p in _PARTS], "title string")
    assert rows(df.select("title", matching.title_parts(F.col("title")).alias("p")).select("title", "p.*")) == sorted(_PARTS, key=str)


def test_leading_tags(spark):
    df = spark.createDataFrame([(t + "제목",) for t in _TAGS], "name string")
    got = {r.name: (r.x.category, r.x.rest) for r in df.select("name", review.leading_tag(F.col("name")).alias("x")).collect()}
    assert got == {t + "제목": (_TAGGED.get(t), "제목") for t in _TAGS}
