"""Dictionaries of any size against plain Python, in one part and in many."""

import random

import pytest

from mulberry.operators import dictionary as d
from mulberry.operators import keywords as k

KW = "genre_pos int, genre string, pos int, keyword string, weight int"


@pytest.fixture(params=[2_000_000, 40])
def part(request, monkeypatch):
    monkeypatch.setattr(d, "PART_CHARS", request.param)
    return request.param


def texts_of(rng, n):
    return [(i, "".join(rng.choice("abc 가나😀") for _ in range(rng.choice([0, 3, 30, 200])))) for i in range(n)] + [(n, None), (n + 1, "")]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_contained(spark, part):
    rng = random.Random(1)
    texts, words = texts_of(rng, 60), sorted({"".join(rng.choice("abc 가😀") for _ in range(rng.randint(1, 5))) for _ in range(80)})
    df = spark.createDataFrame(texts, "id long, text string")
    got = d.contained(df, spark.createDataFrame([(w,) for w in [*words, *words[:3], "", None]], "word string"), "id", "text")
    assert rows(got) == sorted((i, w) for i, t in texts if t for w in words if w in t)
    assert rows(d.contained(df, spark.createDataFrame([("",)], "word string"), "id", "text")) == []


def test_keyword_matches_equal_the_array_path(spark, part, monkeypatch):
    rng = random.Random(2)
    kw = [(g, f"g{g}", p, "".join(rng.choice("abC가") for _ in range(rng.randint(1, 4))), rng.randint(1, 9)) for g in range(4) for p in range(15)]
    kw += [kw[0], (0, "g0", 99, kw[1][3], 5)]  # a keyword listed twice
    texts = spark.createDataFrame(texts_of(rng, 50), "id long, text string")
    words = spark.createDataFrame(kw, KW)
    pairs = spark.createDataFrame([(f"g{i % 3}", a[3], b[3]) for i, (a, b) in enumerate(zip(kw[:20], kw[20:40], strict=True))], "genre string, kw1 string, kw2 string")

    def every():
        return [rows(f) for f in (k.keyword_matches(texts, words, "id", "text"), k.list_scores(texts, words, "id", "text"), k.compound_pairs(texts, pairs, "id", "text"))]

    few = every()
    monkeypatch.setattr(k, "ARRAY_KEYWORDS", 3)
    assert every() == few and all(few)


def test_author_genre_of_any_size(spark, part, monkeypatch):
    rng = random.Random(3)
    names = [(i, "".join(rng.choice("가나다 ") for _ in range(rng.randint(1, 4))), f"g{i % 5}") for i in range(40)]
    credits = spark.createDataFrame([(i, "".join(rng.choice("가나다라 ") for _ in range(rng.randint(0, 6)))) for i in range(120)] + [(200, None)], "id long, author string")
    for listed in (names, [*names, (40, " ", "blank")], [(3, "없", "x")] * 5 + names[:2]):
        authors = spark.createDataFrame(listed, "pos int, author string, genre string")
        monkeypatch.setattr(k, "ARRAY_KEYWORDS", 1000)
        few = sorted(map(str, k.author_genre(credits, authors).collect()))
        monkeypatch.setattr(k, "ARRAY_KEYWORDS", 0)
        assert sorted(map(str, k.author_genre(credits, authors).collect())) == few


def test_texts_are_not_shuffled(spark, tmp_path):
    """The plan of a large dictionary has one exchange, of the words found."""
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "ab cd")], "id long, text string").write.parquet(path)
    found = d.contained(spark.read.parquet(path), spark.createDataFrame([("ab",)], "word string"), "id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_dictionary_of_a_hundred_thousand_words(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7))) for _ in range(140_000)})
    assert len(words) > 90_000
    texts = [(i, "".join(rng.choice("abcdefghij ") for _ in range(3000))) for i in range(40)]
    got = rows(d.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "word string"), "id", "text"))
    known = set(words)
    want = {(i, t[a : a + n]) for i, t in texts for a in range(len(t)) for n in range(4, 8) if t[a : a + n] in known}
    assert got == sorted(want)


def test_title_keywords(spark):
    titles = [(1, "축구 감독의 회귀"), (2, "mma 선수"), (3, "천마 님의 검"), (4, "마법 천마"), (5, "없음"), (6, None), (7, "검 MAGIC"), (8, "재벌과 조선")]
    kw = [(0, "무협", 0, "천마", 5), (0, "무협", 1, "검", 2), (1, "판타지", 0, "마법", 5), (1, "판타지", 1, "magic", 30), (2, "공포", 0, "님의", 40)]
    got = {r["id"]: (r["genre"], r["confidence"], r["matched_keywords"]) for r in k.title_keywords(spark.createDataFrame(titles, "id long, title string"), spark.createDataFrame(kw, KW), "id", "title").collect()}
    assert got == {
        1: ("스포츠", 0.9, ["축구"]), 2: ("스포츠", 0.9, ["MMA"]), 3: ("공포", 0.6, ["님의"]), 4: ("무협", 0.25, ["천마"]), 5: (None, 0.0, []), 6: (None, 0.0, []), 7: ("무협", 0.1, ["검"]), 8: ("현판", 0.9, ["재벌"]),
    }
