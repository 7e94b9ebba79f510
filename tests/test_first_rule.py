"""Ordered rules as bit sets, as an automaton and as joins, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mulberry.operators import first_rule as fr

TERMS = "rule long, grp int, word string, pattern boolean"


def made(rng, rules, letters="abc가😀"):
    out = []
    for r in rng.sample(range(-5, 3 * rules), rules):
        for g in range(1, rng.randint(1, 3) + 1):
            out += [(r, 3 * g, "".join(rng.choice(letters) for _ in range(rng.randint(2, 4))), rng.choice([False, None])) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.4:
            out += [(r, 0, rng.choice(letters) * 2, False)]
    return out


def brute(texts, terms):
    rules = {}
    for r, g, w, p in terms:
        if r is not None and g is not None:
            rules.setdefault(r, {}).setdefault(g, []).append((w, p))

    def has(t, g):
        return any(w and (re.search(w, t) if p else w in t) for w, p in g)

    out = {}
    for i, t in texts:
        for r in sorted(rules) if t is not None else ():
            gs = {g: ws for g, ws in rules[r].items() if g > 0}
            if gs and all(has(t, ws) for ws in gs.values()) and not has(t, rules[r].get(0, [])):
                out[i] = r
                break
    return out


@pytest.mark.parametrize("limits", [(20_000, 4_096, 512), (20_000, 4_096, 5), (20_000, 1, 5), (3, 4_096, 512)])
def test_every_way_equals_plain_python(spark, monkeypatch, limits):
    for name, n in zip(("MASK_TERMS", "MASK_LONGS", "WORDS_IN_ARRAY"), limits, strict=True):
        monkeypatch.setattr(fr, name, n)
    rng = random.Random(7)
    terms = made(rng, 150)
    terms += [(-9, 1, "", False), (-8, 1, None, False), (-8, 2, "a", False), (-7, 0, "zz", False), (None, 1, "a", False), (-6, None, "a", False), terms[0], terms[0]]
    terms += [(200, 1, "^b.*c$", True), (201, 1, "[가]{2}", True), (201, 0, "^a", True), (-4, 1, "(?U)\\bcab\\b", True)]
    texts = [(i, "".join(rng.choice("abc가 😀") for _ in range(rng.choice([3, 8, 20, 60])))) for i in range(200)] + [(900, None), (901, "")]
    got = fr.first_rule(spark.createDataFrame(texts, "id long, body string").withColumn("rule", F.lit("x")), spark.createDataFrame(terms, TERMS).withColumn("k", F.lit(1)), "id", "body")
    want = brute(texts, [t for t in terms if t[0] != -4 or not t[3]] + [(-4, 1, r"(?<!\w)cab(?!\w)", True)])
    assert got.columns == ["id", "rule"] and dict(map(tuple, got.collect())) == want
    assert len(set(want.values())) > 20 and len(want) < 202


def test_empty(spark):
    texts, terms = spark.createDataFrame([(1, "a")], "id long, body string"), spark.createDataFrame([(1, 1, "a", False)], TERMS)
    assert fr.first_rule(texts, terms.limit(0), "id", "body").collect() == []
    assert fr.first_rule(texts.limit(0), terms, "id", "body").collect() == []


def test_the_plan_does_not_grow(spark):
    texts = spark.createDataFrame([(1, "a")], "id long, body string")

    def size(rules):
        words = [(r, g, f"{r}w{g}", False) for r in range(rules) for g in (1, 2)]
        plan = fr.first_rule(texts, spark.createDataFrame(words, TERMS), "id", "body")._jdf.queryExecution().analyzed().toString()
        return plan.count("CASE WHEN"), plan.count("contains("), plan.count("from_json("), plan.count("lambdafunction(")

    assert size(10) == size(30) and size(40) == size(500)
