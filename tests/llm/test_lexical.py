import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from mulberry.llm import lexical as x

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_all, l_all = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 100 - 75 + (75 * c.total() * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def words(rng, n):
    return " ".join(rng.choice("abcdefghij")[: 1 + int(rng.random() * 2)] + str(int(rng.paretovariate(0.6)) % 200) for _ in range(n))


@pytest.mark.parametrize("first,growth", [(1, 2), (4, 3), (20, 5), (1024, 16)])
def test_every_tier_gives_what_brute_force_gives(spark, docs_of, first, growth):
    rng = random.Random(first)
    items = [(i, words(rng, rng.choice([1, 3, 12]))) for i in range(25)]
    docs = [(i, words(rng, rng.choice([1, 5, 40, 90]))) for i in range(300)]
    docs += [(1000 + i, items[i % 8][1] + " " + words(rng, 3)) for i in range(60)]  # passages of the items: these are settled early
    docs += [(2000 + i, items[3][1]) for i in range(40)] + [(7, items[3][1])] * 2  # ties and repeated rows
    docs += [(3000, ""), (3001, None), (3002, "... --"), (None, items[0][1]), (3003, "Ünï ÄB äb A_b a9")]
    items += [(100, None), (101, ""), (102, "zzzz"), (103, "ÄB ünï AB a")]
    got = x.search(docs_of(docs), spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash")), first=first, growth=growth)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 10)


def test_items_are_settled_in_the_first_tier_where_that_is_proved(spark, docs_of, monkeypatch):
    rng = random.Random(5)
    docs = [(i, "the of and " * rng.randint(1, 30) + words(rng, 5)) for i in range(400)]
    docs += [(1000 + i, "alpha beta gamma delta the of and " + words(rng, 2)) for i in range(12)]
    items = [(1, "alpha beta gamma delta the"), (2, "the of and")]
    seen = []
    inner = x._Blocks.__init__

    def noted(self, asked, weight, left, open_items):
        seen.append(sorted(asked.items[i] for i in open_items))
        inner(self, asked, weight, left, open_items)

    monkeypatch.setattr(x._Blocks, "__init__", noted)
    got = x.search(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), first=20, growth=4)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 10)
    assert seen[:3] == [[1, 2], [1], [2]]  # both are asked, the first is proved, the second falls through


def test_the_same_with_many_chunks_of_items(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(x, "CHUNK_TERMS", 40)
    items, docs = [(i, words(rng, 8)) for i in range(20)], [(i, words(rng, 30)) for i in range(120)]
    got = x.search(docs_of(docs), spark.createDataFrame(items, "item_id long, text string"), first=8, growth=4)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 10)


def test_long_texts_are_counted_in_windows(monkeypatch):
    text = ("Wort" * 50 + " kurz, ") * 40
    whole = x.term_counts(text.encode())
    monkeypatch.setattr(x, "WINDOW", 7)
    assert x.term_counts(text.encode()) == whole == Counter(t.encode() for t in plain_terms(text))


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert x.search(docs_of([]), items).collect() == []
    assert x.search(docs_of([(1, "a")]), items.limit(0)).collect() == []
    assert x.search(docs_of([(1, "b")]), items).collect() == []


def test_sums_beyond_exact_doubles(spark, docs_of):
    docs = [(i, "rare " * (i + 1) + "x" * i) for i in range(12)] + [(99, "other")] * 30
    once = {r["doc_id"]: r["score"] for r in x.search(docs_of(docs), spark.createDataFrame([(1, "rare")], "item_id long, text string"), k=20).collect()}
    asked = x.Asked([{"item": 1, "term": b"rare", "n": 10**8 + 1}])
    got = x._search_chunk(docs_of(docs), asked, 20, "doc_id", "text", x.FIRST, x.GROWTH)
    assert {r["doc_id"]: r["score"] for r in got.collect()} == {i: s * (10**8 + 1) for i, s in once.items()} and len(once) == 12


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, x.op11_lexical_search(spark, sf).collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert got == sorted(con.execute(x.OP11_SQL).fetchall())
