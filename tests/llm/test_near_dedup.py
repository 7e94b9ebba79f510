import random
import re

import numpy as np
from pyspark.sql import functions as F

from mulberry.llm import near_dedup as n
from mulberry.llm import setsketch as s
from mulberry.llm.components import connected_components


def brute(rows, width, per_cent):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda c: c[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def corpus(rng, bases=12, near=8):
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(near):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
            i += 1
    return rows


def test_against_all_pairs(docs_of):
    rng = random.Random(5)
    rows = corpus(rng)
    k = len(rows)
    rows += [(k, None), (k + 1, ""), (k + 2, "one"), (k + 3, "ONE"), (k + 4, "É one"), (k + 5, "é one"), (k + 6, "a b"), (k + 7, "A b"), (k + 8, rows[0][1].upper()), (k + 9, "x y " * 30_000), (k + 10, "y x " * 30_000)]
    for width in (2, 5):
        got = n.near_duplicates(docs_of(rows), width).collect()
        assert sorted(map(tuple, got)) == brute(rows, width, 80)


def test_chains_of_links(docs_of):
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(30)]
    got = n.near_duplicates(docs_of(rows), 2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 80)


def test_odd_rows(docs_of):
    got = n.near_duplicates(docs_of([(1, "a b c"), (1, "a b c"), (None, "a b c"), (0, "a b c")]), 2).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 0, False), (1, 2, 0, False), (0, 2, 0, True), (None, 2, None, True)], key=str)
    assert n.near_duplicates(docs_of([])).count() == 0


def test_unlike_texts_under_one_identifier(docs_of):
    """One of them is linked, the same in any order; all rows of the identifier share its component."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z"), (4, "m n")]
    seen = [sorted(map(tuple, n.near_duplicates(docs_of(r), 2).collect())) for r in (rows, rows[::-1])]
    assert seen[0] == seen[1]
    component = {r[0]: r[2] for r in seen[0]}
    assert len(seen[0]) == 5 and component[4] == 4 and (component[2], component[3]) in ((1, 3), (2, 2))


def test_ids_beyond_the_broadcast(docs_of, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(40):
        t = list(base)
        t[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(n, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, n.near_duplicates(docs_of(rows), 2).collect())) == brute(rows, 2, 80)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    least = {}

    def find(i):
        while least.setdefault(i, i) != i:
            i = least[i]
        return i

    for u, v in links:
        if u is not None and u != v:
            a, b = sorted((find(u), find(v)))
            least[b] = a
    assert got == {i: find(i) for i in least}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = x[:3000], x[1000:]
    ra, rb, both = s.registers(a, 4096), s.registers(b, 4096), s.registers(np.unique(x), 4096)
    assert (s.merge(ra, rb) == both).all()
    d = [np.array([k]) for k in ((ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum())]
    assert abs(s.jaccard(*d, np.array([3000]), np.array([3000]))[0] - 0.5) < 0.04
    assert (s.registers(x[:7], 200) == s.registers(x[:7][::-1], 200)).all()


def test_registers_agree_as_often_as_sets_do(docs_of):
    rng = np.random.default_rng(7)
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 110).astype(np.uint64)
        agree.append((s.registers(x[:100], 200) == s.registers(x[10:], 200)).mean())
    assert abs(np.mean(agree) - 90 / 110) < 0.02


def test_bands_have_the_registers(docs_of):
    r = n.sketches(docs_of([(1, "a b c d")]), 2).select(F.octet_length("regs")).first()[0]
    assert r == 2 * n.BANDS * n.ROWS


def test_family_around_the_threshold(docs_of):
    """Many near copies of which most pairs lie just below the threshold and some above it."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        for at in rng.sample(range(150), 8 if i % 3 else 5):
            t[at] = f"n{i}x{at}"
        rows.append((i, " ".join(t)))
    got = n.near_duplicates(docs_of(rows), 2).collect()
    assert sorted(map(tuple, got)) == brute(rows, 2, 80)
