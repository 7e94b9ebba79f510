import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mulberry.llm import mixing as m

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share, stop at the caps, share the excess anew until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if t[s] > most * sizes[s]]
        if not over:
            return full | t
        full |= {s: most * sizes[s] for s in over}


def brute_seats(votes, seats):
    got = [0] * len(votes)
    if sum(votes) > 0:
        for _ in range(seats):
            i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
            got[i] += 1
    return got


@given(st.lists(st.lists(st.integers(0, 1000), min_size=1, max_size=12), min_size=1, max_size=4), st.integers(0, 300))
@settings(max_examples=8, deadline=None)
def test_highest_quotients(spark, groups, seats):
    rows = [(g, i, v, seats) for g, votes in enumerate(groups) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, v long, s long")
    got = {(r.g, r.i): r.quota for r in m.sainte_lague(df, ["g"], "v", "s", ["i"]).collect()}
    for g, votes in enumerate(groups):
        assert [got[g, i] for i in range(len(votes))] == brute_seats(votes, seats)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = m.mix(docs).collect()
    again = m.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    sizes, taken = {}, {}
    for r in plan:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute_targets(sizes)
    for r in plan:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 32
    mixed = m.mixed_rows(docs, m.mix(docs))
    assert mixed.columns == docs.columns
    by = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(m.word_count(F.col("text")))).collect()}
    assert by == taken


def test_odd_rows(docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 50))), None if i % 3 == 0 else "a") for i in range(60)]
    rows += [(60, None, "a"), (61, "", "empty"), (62, "x " * 30_000, "b"), (5, rows[5][1], rows[5][2]), (None, "one two", "a")]
    docs = docs_of(rows)
    plan = m.mix(docs).collect()
    assert len(plan) == len(rows)
    sizes = {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    for s, t in want.items():
        assert abs(sum(r.taken for r in plan if r.source == s) - t) <= 0.02 * t + 32
    assert all(0 <= r.taken <= 2 * r.size for r in plan)
    mixed = m.mixed_rows(docs, m.mix(docs)).agg(F.sum(m.word_count(F.col("text")))).first()[0]
    assert mixed == sum(r.taken for r in plan)


def test_nothing_to_mix(docs_of):
    assert m.mix(docs_of([])).count() == 0
    got = m.mix(docs_of([(1, None), (2, " ")])).collect()
    assert [r.taken for r in got] == [0, 0]
