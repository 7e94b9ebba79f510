import numpy as np
import pytest
from pyspark.sql import functions as F

from mulberry.llm import vptree as t

SF = "/root/testdata/sf0.01"


def brute(rows, k, every):
    good = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        v = min(v for i, v in good if i == q)
        best = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("leaf,spread", [(2, 1.0), (4, 0.02), (16, 0.3)])
def test_factor_one_is_exact(spark, monkeypatch, leaf, spread):
    monkeypatch.setattr(t, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 700)] + spread * rng.normal(size=(700, 8))
    x[::5] *= rng.lognormal(size=(140, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = rows_of(t.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 7, 1.0)), brute(rows, 7, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def test_ties_equal_vectors_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(t, "LEAF", 4)
    monkeypatch.setattr(t, "POOL", 3)
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.choice([-0.5, 0.0, 0.25, 1.0], 4).tolist()) for i in rng.permutation(400)]
    rows += [(1000 + i, [1.0, 0.25, 1.0, 0.0]) for i in range(200)]  # a third are one vector
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0]), (520, [float("nan")] * 4), (503, [float("inf")] * 4), (540, [0.0] * 4), (541, [-0.0] * 4), (None, [1.0] * 4), (20, rows[3][1]), (560, [1.0, 2.0]), (561, [1.0, 3.0]), (580, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "shard", "block", "score", "rank", "d")})
    for k in (1, 20, 900):
        assert rows_of(t.nearest(df, k, 1.0)) == brute(rows, k, 20)
    monkeypatch.setattr(t, "MERGED", 2)
    assert rows_of(t.nearest(df, 20, 1.0)) == brute(rows, 20, 20)


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e200, 1e-200]), (1, [1e150, 3.0]), (2, [-1e200, 1.0]), (3, [1e-300, 5e-324]), (4, [0.5, 0.25])]
    got = t.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).select("rank", "vec_id").collect()
    assert [tuple(r) for r in sorted(got)][0] == (1, 1) and len(got) == 4


def test_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert t.nearest(spark.createDataFrame([], kind)).collect() == []
    assert t.nearest(spark.createDataFrame([(0, [1.0])], kind)).collect() == []
    assert rows_of(t.nearest(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], kind))) == [(0, 1, 1, -1.0)]


def test_a_factor_prunes(spark):
    """A greater factor leaves out leaves, and so neighbours now and then; factor one does neither."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    q = x[::100]
    order, vantage, bounds = t._tree(x)
    unit = t._lengths_one(x[order])
    key = np.maximum(0, t._leaf_bounds((q / np.linalg.norm(q, axis=1)[:, None]) @ unit[vantage].T, bounds))
    near = np.arccos(np.clip((q / np.linalg.norm(q, axis=1)[:, None]) @ unit.T, -1, 1))
    n, leaves = len(x), key.shape[1]
    for i in range(leaves):
        a, e = n * i // leaves, n * (i + 1) // leaves
        assert (near[:, a:e].min(1) >= key[:, i] - 1e-6).all()  # a bound is a bound
    assert (key > 0.2).mean() > 0.3


def test_recall_of_the_query(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    rows = list(zip(table["vec_id"], table["embedding"], strict=True))
    got = {(r["query_id"], r["vec_id"]) for r in t.op13_nearest(spark, SF).collect()}
    want = {(w[0], w[2]) for w in brute(rows, 20, 20)}
    assert len(got & want) >= 0.95 * len(want)
