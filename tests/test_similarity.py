"""The similarity join against the ratio of every pair."""

import difflib
import random

import pytest

from mulberry.operators import similarity as s


def titles(rng, n):
    out = ["".join(rng.choice("abcdeㄱ가나😀 ") for _ in range(rng.choice([0, 1, 2, 3, 8, 20, 33]))) for _ in range(n)]
    for t in list(out)[: n // 2]:
        letters = list(t)
        for _ in range(rng.randint(0, 3)):
            if letters:
                letters[rng.randrange(len(letters))] = rng.choice("abxyz")
        out.append("".join(letters))
    return out


@pytest.mark.parametrize("bar", [0.85, 0.6, 0.4, 1.0])
def test_all_pairs(spark, bar):
    rng = random.Random(int(bar * 100))
    left, right = titles(rng, 50), titles(rng, 40)
    right += [t[1:] + t[:1] for t in left[:20]] + left[:5]
    want = {(a, b) for a in left for b in right if a == b or difflib.SequenceMatcher(None, a, b).ratio() >= bar}
    df = [spark.createDataFrame([(t,) for t in [*x, None, x[0]]], "t string") for x in (left, right)]
    got = s.similar_titles(*df, bar).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.ratio - (1.0 if r.a == r.b else difflib.SequenceMatcher(None, r.a, r.b).ratio())) < 1e-12 for r in got)


def test_best(spark):
    left = spark.createDataFrame([(1, "The 영웅 Story!"), (2, "nothing like it"), (3, None), (4, "..."), (5, "The 영웅 Story!")], "id int, name string")
    right = spark.createDataFrame([(9, "the 영웅 storys"), (8, "The 영웅 story"), (7, "the 영웅 Story"), (6, ""), (5, None)], "page int, title string")
    got = {r.id: (r.match_id, r.match_title, r.ratio) for r in s.best_titles(left, right, "name", "page", "title").collect()}
    assert got == {1: (7, "the 영웅 Story", 1.0), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None), 5: (7, "the 영웅 Story", 1.0)}
    assert s.best_titles(left, right.limit(0), "name", "page", "title").filter("match_id is null").count() == 5


def test_no_cross_join(spark):
    df = spark.createDataFrame([("abcdef",), ("abcdeg",)], "t string")
    plan = s.similar_titles(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_all_titles_of_parts_against_themselves(spark):
    """The titles of the smallest tables, edited, against all of them: as brute force has it."""
    parts = [r.p_name for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()]
    left = [p[: i % 9] + "x" + p[i % 9 + i % 3 :] for i, p in enumerate(parts)]
    got = {(r.a, r.b) for r in s.similar_titles(spark.createDataFrame([(t,) for t in left], "t string"), spark.createDataFrame([(t,) for t in parts], "t string")).collect()}
    assert got == {(a, b) for a in left for b in parts if difflib.SequenceMatcher(None, a, b).ratio() >= 0.85} and len(got) > 100


def test_the_query_against_every_ratio(spark):
    from mulberry.plans.decision_queries import fuzzy_matches

    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    known = sorted({"".join(c for c in f"{r.p_brand} {r.p_name}".lower() if c.isalnum() or c == "_") for r in parts})
    for r in fuzzy_matches(spark, "/root/testdata/sf0.001").collect():
        asked = "".join(c for c in r.asked.lower() if c.isalnum() or c == "_")
        best = max(1.0 if t == asked else difflib.SequenceMatcher(None, asked, t).ratio() for t in known)
        assert (r.ratio is None) == (best < 0.85) and (r.ratio is None or abs(r.ratio - best) < 1e-12)
