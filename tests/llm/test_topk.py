import math
import random

import duckdb
from pyspark.sql import functions as F

from mulberry.llm import topk as k

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    got = sorted(map(tuple, k.op7_topk(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(k.OP7_SQL).fetchall())


def brute(rows, n, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        v = min(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:n]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_ties_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1e-9]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (None, [1.0] * 4), (50, rows[50][1]), (310, [1.0, 2.0]), (350, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    for n in (1, 5, 400):
        assert sorted(map(tuple, k.top_k(df, n).collect())) == brute(rows, n, 50)
    assert sorted(map(tuple, k.top_k(df, 5, F.col("vec_id") % 7 == 0, shards=3).collect())) == brute(rows, 5, 7)


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert k.top_k(spark.createDataFrame([], kind)).count() == 0
    assert k.top_k(spark.createDataFrame([(0, [1.0])], kind)).count() == 0


def test_large_components(spark):
    rows = [(0, [3e6, -2e6]), (1, [2e6, 1e6]), (2, [-1e6, 1.5e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, k.top_k(df).collect())) == brute(rows, 5, 50)
