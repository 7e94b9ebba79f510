import difflib
import random

import pytest
from pyspark.sql import functions as F

from mulberry.functions import html as H
from mulberry.functions import normalize as N
from mulberry.functions.titles import _compose, parse_titles, side_label, valid_genre


def one(spark, column, **given):
    df = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (N.cache_key, "  Ab C ", "ab c"),
        (N.collapse, " a　b \t c ", "a b c"),
        (N.similarity_title, "A-b! é가", "ab é가"),
        (N.fuzzy_title, "영 마스터, 여행기", "영마스터여행기"),
        (N.search_title, "제목 (완) ㆍ둘~셋", "제목 둘 셋"),
        (N.spaced_title, "영ABC마스터3", "영 ABC 마스터 3"),
        (N.spaced_title, "가3", "가3"),
        (N.bare_url, "http://a/b?c=1", "http://a/b"),
        (N.strip_zeros, "0012", "12"),
        (N.strip_zeros, "0", "0"),
        (N.tag_genre, "현대판타지", "현판"),
        (N.tag_genre, "모름", "모름"),
        (N.source_label, "naver_문피아_meta", "문피아"),
        (N.source_label, "", "-"),
        (N.source_label, "other_thing", "Other"),
        (side_label, " + 番外 1-3", "외전 1-3"),
        (side_label, "에필로그", "에필"),
        (valid_genre, "없는", "미분류"),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


@pytest.mark.parametrize(("name", "want"), [("a.txt", ("a", ".txt")), (".txt", ("", ".txt")), ("a. (완)", ("a. (완)", "")), ("경기당 1.12골", ("경기당 1", ".12골")), ("a", ("a", "")), ("", ("", "")), ("a.b.zip", ("a.b", ".zip"))])
def test_suffixes(spark, name, want):
    stem, suffix = N.split_suffix(F.col("t"))
    assert one(spark, F.struct(stem, suffix), t=name) == want


def test_similarity_properties(spark):
    rng = random.Random(1)
    rows = [("", ""), ("가", ""), ("가나다", "가다"), *[("".join(rng.choices("가나다라 ab", k=rng.randint(0, 8))), "".join(rng.choices("가나다라 ab", k=rng.randint(0, 8)))) for _ in range(50)]]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(N.similarity(a, b), N.similarity(b, a), N.similarity(a, a)).collect()
    assert [r[0] for r in got[:3]] == [1.0, 0.0, pytest.approx(2 / 3)]
    assert all(0 <= r[0] <= 1 and r[0] == r[1] and r[2] == 1.0 for r in got)
    assert difflib.SequenceMatcher(None, "영마스터여행기", "영마스터여행기").ratio() == 1


def test_jamo():
    assert [_compose(x) for x in ("ㄷH공ㅂlㄱr", "ㄹㅔㅂ 1", "ㄱㅗㅣ", "rpm 가", "각ㅏ", "")] == ["대공비가", "렙 1", "괴", "rpm 가", "각ㅏ", ""]


def test_names_with_everything(spark):
    rows = [(None,), ("",), (".txt",), ("제목 😀 1-10 (완)",), ("x" * 5000,), ("[무협] [개정판] 어떤 제목 (19금) [노벨피아] 01-0100화 완결 + 에필로그 - 작자",)]
    df = spark.createDataFrame(rows, "raw_name string").withColumn("title", F.lit("clash"))
    got = [r.asDict() for r in parse_titles(df).collect()]
    assert [g["title"] for g in got[:5]] == ["", "", "", "제목 😀", "x" * 5000]
    assert got[3]["is_completed"] and got[3]["range_info"] == "1-10"
    assert (got[5]["title"], got[5]["original_genre"], got[5]["edition_info"], got[5]["range_info"]) == ("어떤 제목", "무협", "[개정판]", "1-100")


PAGE = """<html><head><title> A &amp; B </title><meta name="keywords" content="재미, 현대 판타지"><meta property="og:title" content="OG">
<script type="application/ld+json">{"genre": ["무협"]}</script></head><body><nav>menu</nav><h1>Head <b>line</b></h1><a href="/x">로판</a><p class="meta-path">a &gt; b</p><footer>f</footer></body></html>"""


def test_pages(spark):
    p = F.col("p")
    got = one(spark, F.struct(H.page_title(p), H.meta(p, "og:title"), H.heading(p), H.links(p), H.by_class(p, "p", "meta-path"), H.visible_text(p), H.genre_of_page(p)), p=PAGE)
    assert got[0] == "A & B" and got[1] == "OG" and got[2] == "Head line" and got[3] == ["/x"] and got[4] == "a > b"
    assert got[5] == "A & B Head line 로판 a > b" and tuple(got[6]) == ("무협", "jsonld", 0.95)
    assert one(spark, H.genre_of_page(p)["source"], p=PAGE.replace("application/ld+json", "x")) == "meta"
    assert one(spark, H.genre_of_page(p), p="<p>nothing</p>") is None


def test_small_ones(spark):
    n, o, w = F.col("n"), F.col("o"), F.col("w")
    edits = [("[무협] 제목", "무협", "선협", "[선협] 제목"), ("제목", "무협", "선협", "[선협] 제목"), ("a [x] b [x]", "x", "y", "a [y] b [x]")]
    assert all(one(spark, N.edit_genre(n, o, w), n=a, o=b, w=c) == d for a, b, c, d in edits)
    assert one(spark, N.rename_by("제목 [장르]", n, o), n="무협", o="제목") == "제목 [무협]"
    assert one(spark, N.author_variants(n), n="홍길동수, 김용") == ["홍길동수", "길동수", "동수", "김용"]
    assert one(spark, N.looks_garbled(F.array(n)), n="a└b") is True
    assert one(spark, N.complexity(n), n="가a (1)!") == 7 + 2 * 3
