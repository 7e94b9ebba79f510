"""The pipeline against plain Python, stage by stage, on a small corpus of its own."""

import hashlib
import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
from mulberry.llm.bpe import tokenizer_path
from mulberry.llm.toxicity import score_toxicity
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_dedup import brute


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(9)
    calm = [f"{a}{b}" for a in ("riv", "ston", "gard", "pap", "wind", "mus") for b in ("er", "e", "en", "ow", "ic", "a", "el")]
    rows = []
    for i in range(240):
        w = rng.choices(calm, k=rng.randint(30, 90))
        if i % 6 == 0:
            w[5:5] = ["scoundrel", "nitwit", "dimwit"]
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
    for i in range(240, 300):
        base = rows[i - 240][1].split(" ")
        if i % 2:
            base[rng.randrange(len(base))] = "changed"
        rows.append((i, " ".join(base), "en", f"s{i % 5}"))
    rows += [(300, None, None, None), (301, "", "en", "s0"), (302, "", "en", "s0")]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_rows_without_an_identifier_of_their_own(spark, sf):
    """Decisions take effect on rows whose doc_id is null or shared, and none of their texts gets lost."""
    rng = random.Random(4)
    base = rng.choices([f"w{i}" for i in range(500)], k=80)
    near = [*base[:40], "other", *base[41:]]
    far = rng.choices([f"v{i}" for i in range(500)], k=80)
    rude = "scoundrel nitwit dimwit " * 3
    rows = [(1007, " ".join(base)), (None, " ".join(near)), (None, " ".join(far)), (1008, " ".join(far[:60])), (1008, " ".join(near[::-1])), (None, rude + " ".join(far)), (1008, rude)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet"))

    def own(df):
        assert df.columns == docs.columns
        return sorted((r.doc_id or 0, r.text) for r in df.collect() if r.text and (r.doc_id is None or r.doc_id > 1000))

    one = p.drop_toxic(spark, docs, sf)
    assert own(one) == sorted((i or 0, t) for i, t in rows[:5])
    got = own(p.drop_near_copies(spark, p.drop_copies(spark, one, sf), sf))
    # of the first two, near copies, that with a doc_id of its own stays
    assert got == sorted((i or 0, t) for i, t in (rows[0], *rows[2:5]))


def test_near_copies_go_without_a_shuffle_of_texts(spark, sf):
    """Few identifiers go, so the rows that stay are neither sorted nor shuffled, whatever Spark would broadcast by itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id is not null")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = p.drop_near_copies(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or seen[-1].columns == docs.columns
    rows = [[tuple(r) for r in s.collect()] for s in seen]
    toxic = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    assert {i for i in range(240) if i % 6 == 0} <= toxic
    assert sorted(r[0] for r in rows[1]) == sorted(r[0] for r in rows[0] if r[0] not in toxic)
    last = {r[1] or "": r[0] for r in sorted(rows[1])}
    assert sorted(r[0] for r in rows[2]) == sorted(last.values())
    assert sorted(r[0] for r in rows[3]) == sorted(i for i, _, _, kept in brute([r[:2] for r in rows[2]], 5, 80) if kept)
    sizes = {}
    for r in rows[3]:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    mixed = {}
    own = {r[0]: r for r in rows[3]}
    for i, text, lang, source, n in rows[4]:
        mixed[source] = mixed.get(source, 0) + len(words(text))
        assert " ".join(words(text)) in " ".join(words(own[i][1])) and (lang, source) == own[i][2:4] and n == len(text)
    for s, t in brute_targets(sizes).items():
        assert abs(mixed.get(s, 0) - t) <= 0.01 * t + 32
    tk = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in rows[4]:
        ids = tk.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(rows[5]) == sorted(want)
    assert sorted(map(tuple, p.run(spark, sf).collect())) == sorted(want)
