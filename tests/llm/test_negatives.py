import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from mulberry.llm import negatives as n

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    got = sorted(map(tuple, n.op12_hard_negatives(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(n.OP12_SQL).fetchall()) and got


def brute(rows, positives, negatives, low, high, every):
    good = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in good if i % every == 0}):
        v, label = min((v, label) for i, v, label in good if i == a)
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, own) for i, w, own in good if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p)[:negatives]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("digit,values", [(8, [-0.5, 0.0, 0.25, 1.0]), (2, [-3.0, 0.5, 7.0, 1e4]), (1, [0.0, 0.125])])
def test_against_brute_force_with_ties_and_odd_rows(spark, monkeypatch, digit, values):
    monkeypatch.setattr(n, "DIGIT", digit)
    rng = random.Random(digit)
    rows = [(i, [rng.choice(values) + rng.choice([0.0, 0.0, 0.01]) for _ in range(5)], rng.choice([0, 0, 1, 2])) for i in range(260)]
    rows += [(1000 + i, rows[4][1], 1 + i % 2) for i in range(40)]  # equal vectors
    rows += [(300, None, 1), (350, [1.0] * 5, None), (301, [1.0, None, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 5, 1), (400, [float("-inf")] * 5, 0), (None, [1.0] * 5, 0), (50, rows[51][1], 2), (450, [1.0, 2.0], 1), (451, [1.0, 3.0], 1), (452, [1.0, 1.5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("clash") for c in ("v", "shard", "block", "pos", "low", "score", "rank")})
    got = sorted(map(tuple, n.hard_negatives(df).collect()))
    assert got == brute(rows, 5, 3, 50, 95, 50) and len(got) > 5
    got = sorted(map(tuple, n.hard_negatives(df, 2, 30, 0, 200, F.col("vec_id") % 13 == 0).collect()))
    assert got == brute(rows, 2, 30, 0, 200, 13)


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert n.hard_negatives(spark.createDataFrame([], kind)).collect() == []
    assert n.hard_negatives(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], kind)).collect() == []
    assert n.hard_negatives(spark.createDataFrame([(0, [-1.0], 1), (1, [1.0], 1), (2, [0.5], 2)], kind)).collect() == []


def test_labels_are_moved_by_the_query_only(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 3), (1, [1.0, 0.0], 4), (2, [0.75, 0.0], 3), (7, [0.9, 0.0], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    got = sorted(map(tuple, n.op12_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == [(a, p, r, i, x, y) for a, p, r, i, x, y in brute([(i, [float(c) for c in v], label) for i, v, label in moved], 5, 3, 50, 95, 50)] and got
