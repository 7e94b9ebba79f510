import hashlib

import duckdb
import pytest

from mulberry.llm import exact_dedup as x

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 100_000), (6, "B"), (7, "a "), (8, "b" * 100_000), (9, "é"), (9, "é"), (None, "z"), (None, "a")]


@pytest.mark.parametrize("bits", [256, 4])
def test_decisions(docs_of, bits):
    got = x.exact_dedup(docs_of(ROWS), digest_bits=bits).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_state_goes_on_over_batches(docs_of):
    docs = docs_of([(i, f"t{i % 7}") for i in range(100)]).repartition(8)
    got = x.exact_dedup(docs, files_per_batch=1).collect()
    assert sorted(map(tuple, got), key=str) == brute([(i, f"t{i % 7}") for i in range(100)])


def test_rows_that_stay(docs_of):
    docs = docs_of(ROWS)
    kept = x.kept_rows(docs, x.exact_dedup(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(2, "a"), (4, ""), (6, "B"), (7, "a "), (8, "b" * 100_000), (9, "é")]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["z"]


def test_texts_that_stay_are_not_shuffled(spark, docs_of, monkeypatch):
    """Few rows go, so the others stay where they lie, with no sort or shuffle of texts; where many go, the same rows stay."""
    docs = docs_of([(i, f"t{i if i > 5 else 0}") for i in range(30)])
    want = sorted((i, f"t{i if i > 5 else 0}") for i in range(5, 30))
    decisions = x.exact_dedup(docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = x.kept_rows(docs, decisions)
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == want
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan
        monkeypatch.setattr(x, "BROADCAST_DIGESTS", 0)
        assert sorted((r.doc_id, r.text) for r in x.kept_rows(docs, decisions).collect()) == want
        docs = docs_of(ROWS)
        kept = x.kept_rows(docs, x.exact_dedup(docs)).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "z"), (2, "a"), (4, ""), (6, "B"), (7, "a "), (8, "b" * 100_000), (9, "é")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty(docs_of):
    docs = docs_of([])
    d = x.exact_dedup(docs)
    assert d.count() == 0 and x.kept_rows(docs, d).count() == 0


def test_oracle(spark):
    got = sorted(map(tuple, x.op8_exact_dedup(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(x.OP8_SQL).fetchall())


def test_a_later_run_hits(spark, docs_of, tmp_path):
    state = str(tmp_path / "state")
    first, second = [(1, "a"), (2, "b"), (3, "a"), (4, None)], [(5, "a"), (6, "c"), (0, "b"), (7, "")]
    docs_of(first).write.parquet(str(tmp_path / "one"))
    got = x.exact_dedup(spark.read.parquet(str(tmp_path / "one")), state_dir=state).collect()
    assert sorted(map(tuple, got), key=str) == brute(first)
    got = x.exact_dedup(docs_of(second), state_dir=state).collect()
    assert sorted(map(tuple, got), key=str) == [r for r in brute(first + second) if r[0] in (5, 6, 0, 7)]
    located = {r.digest: r.locator for r in x.known_state(spark, state).collect()}
    assert sum("/one/" in (v or "") for v in located.values()) >= 1


def test_earlier_bytes_are_compared(spark, docs_of, tmp_path, monkeypatch):
    """One digest for all texts: what the locators name tells a later text apart."""
    state = str(tmp_path / "state")
    docs_of([(1, "a"), (2, "a")]).write.parquet(str(tmp_path / "one"))
    x.exact_dedup(spark.read.parquet(str(tmp_path / "one")), state_dir=state, digest_bits=0).count()
    got = {r.doc_id: (r.keep_id, r.group_size) for r in x.exact_dedup(docs_of([(5, "z"), (3, "a")]), state_dir=state, digest_bits=0).collect()}
    assert got == {5: (5, 1), 3: (3, 3)}


def test_many_repeated_digests_are_joined(docs_of, monkeypatch):
    rows = [(i, f"t{i % 20 if i < 60 else 0}") for i in range(100)]
    monkeypatch.setattr(x, "BROADCAST_DIGESTS", 3)
    monkeypatch.setattr(x, "HOT_GROUP", 10)
    assert sorted(map(tuple, x.exact_dedup(docs_of(rows)).collect()), key=str) == brute(rows)


def test_a_run_that_died_is_started_again(spark, tmp_path, monkeypatch):
    """With a run id no row counts twice, wherever a run stopped; a later run goes on from what all have left."""
    folder, base = f"{tmp_path}/docs", f"{tmp_path}/state"
    spark.createDataFrame([(i, f"text {i % 40}") for i in range(60)], "doc_id long, text string").write.parquet(folder)
    docs = spark.read.parquet(folder)
    want = sorted(map(tuple, x.exact_dedup(docs).collect()))

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(x, "stream_state", stopped)  # after the arrivals are written
        with pytest.raises(RuntimeError):
            x.exact_dedup(docs, state_dir=base, run_id="one")
    with monkeypatch.context() as m:
        m.setattr(x, "_told_apart", stopped)  # after the stream
        with pytest.raises(RuntimeError):
            x.exact_dedup(docs, state_dir=base, run_id="one")
    for _ in range(2):
        assert sorted(map(tuple, x.exact_dedup(docs, state_dir=base, run_id="one").collect())) == want
    later = spark.createDataFrame([(100, "text 3"), (101, "new")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in x.exact_dedup(later, state_dir=base, run_id="two").collect()}
    assert got == {100: (100, 3, True), 101: (101, 1, True)}


def test_many_stores_take_little_memory(spark, docs_of, tmp_path):
    """Stores of a few rows share an executor: what each sets aside at its first row is small."""
    name, n = "spark.sql.shuffle.partitions", 48
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        rows = spark.range(2000).selectExpr("sha2(string(id), 256) digest", "1L n_bytes", "id", "'' locator", "'' sha")
        rows.write.parquet(f"{tmp_path}/arrivals/a")
        state = [p["stateOperators"][0] for p in x.stream_state(spark, str(tmp_path)).recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(name, before)
    assert max(s["numRowsTotal"] for s in state) == 2000
    assert max(s["memoryUsedBytes"] for s in state) < n * 600_000
