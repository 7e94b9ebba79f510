import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mulberry.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = t.op1_toxicity(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    both = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    both = both[both["held_out"]]
    pos, neg = both.loc[both["toxic"] == 1, "score"].to_numpy(), both.loc[both["toxic"] == 0, "score"].to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.8


def synthetic():
    rng = random.Random(1)
    calm = ["river", "stone", "garden", "paper", "window", "music", "letter", "morning", "the", "and", "of", "train"]
    rude = ["scoundrel", "nitwit", "dimwit"]
    rows = []
    for i in range(400):
        w = [rng.choice(calm) for _ in range(40)]
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(rude))
        rows.append((i, " ".join(w)))
    return rows, calm


def disguise(word, rng):
    how = rng.randrange(3)
    if how == 0:
        return "".join({"o": "0", "i": "1", "e": "3", "t": "7", "s": "$"}.get(c, c) for c in word)
    return " ".join(word) if how == 1 else "".join(c * (3 if c in "oiu" else 1) for c in word)


def test_disguised_words_are_found(spark, docs_of):
    rows, calm = synthetic()
    rng = random.Random(2)
    hidden = [(1000 + k, " ".join([*rng.choices(calm, k=20), *[disguise(w, rng) for w in ("scoundrel", "nitwit", "dimwit", "nitwit")], *rng.choices(calm, k=20)])) for k in range(20)]
    odd = [(2000, None), (2001, ""), (2002, "123 456"), (2003, "river " * 50_000), (2003, "river"), (None, "river")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i, _ in rows] + [(1, None, None), (None, 1, None)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in t.score_toxicity(docs_of(rows + hidden + odd), labels).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i, _ in rows)
    assert np.mean([got[i].predicted for i, _ in hidden]) > 0.8
    assert all(got[i].predicted == 0 for i in (2000, 2001, 2002, 2003, None))


def test_no_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in t.score_toxicity(docs_of([(1, "a b"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert t.score_toxicity(docs_of([]), none).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert {r.score for r in t.score_toxicity(docs_of([(i, "a b") for i in range(5)]), one).collect()} == {1.0}


def test_best_path_is_the_best_of_all_paths(docs_of):
    docs = docs_of(synthetic()[0])
    d = t.Decoder(t.language_model(t.trigram_counts(docs).toPandas()))

    def cost(parts):
        a = b = 0
        total = 0.0
        for text, own in parts:
            total += own
            for ch in text:
                z = d._class(ch)
                if z or b:
                    total += float(d.costs[a, b, z])
                    a, b = b, z
        return total

    def paths(lattice):
        if not lattice:
            yield []
            return
        for r in lattice[0]:
            for rest in paths(lattice[1:]):
                yield [r, *rest]

    for token, spaced in (("sc0undr3l", False), ("n 1 t w i t", True), ("d1mw1t", False), ("stooone", False), ("7r41n", False)):
        lattice = d.lattice(token, spaced)
        best = min(map(cost, paths(lattice)))
        want = {"".join(x for x, _ in p).strip() for p in paths(lattice) if cost(p) == pytest.approx(best)}
        assert d.best(token, spaced) in want
    assert d.restore("The river, and THE stone!!") == "the river and the stone"
    assert d.restore("n i t w i t of the tr41n") == "nitwit of the train"


def test_counts_cover_all_texts(docs_of):
    docs = docs_of([(i, "abc abd") for i in range(50)])
    one = t.trigram_counts(docs.limit(1)).agg(F.sum("n")).first()[0]
    all_ = t.trigram_counts(docs).agg(F.sum("n")).first()[0]
    assert all_ >= 49 * one


def test_other_disguises_are_restored(docs_of):
    d = t.Decoder(t.language_model(t.trigram_counts(docs_of(synthetic()[0])).toPandas()))
    for hidden in ("n i t w i t", "n  i  t  w  i  t", "n/i/t/w/i/t", "n,i,t,w,i,t", "n\ni\nt\nw\ni\nt", "nit w i t", "n i t w it", "nniittwwiitt", "n 1 7 w 1 7"):
        assert d.restore(f"the {hidden} of") == "the nitwit of", hidden
    for plain in ("a b", "1 2 3 4 5", "letter and garden"):
        assert d.restore(plain) == plain


def test_scores_are_those_of_a_plain_computation(spark, docs_of):
    rows, _ = synthetic()
    rows = rows[:120] + [(900, None), (901, "n 1 t w i t the river")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in t.score_toxicity(docs, labels).collect()}
    fold = {r.i: r.f for r in docs.select(F.col("doc_id").alias("i"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(t.FOLDS)).alias("f")).collect()}
    d = t.Decoder(t.language_model(t.trigram_counts(docs).toPandas()))
    tokens = {i: [d.token(x) for x in d.tokens(text)] for i, text in rows}
    places = {i: {p for x in ts for w in t._WORD.findall(x) for p in t.beginnings(w)} for i, ts in tokens.items()}
    known = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    toxic = {i: i % 4 == 0 for i in known}

    def weights(some):
        n = [sum(not toxic[i] for i in some), sum(toxic[i] for i in some)]
        out = {}
        for p in set().union(*(places[i] for i in known)):
            all_ = [sum(p in places[i] and toxic[i] == k for i in known) for k in (False, True)]
            if all_[1] < 2 or all_[1] * sum(not toxic[i] for i in known) <= all_[0] * sum(toxic[i] for i in known):
                continue
            a, b = (sum(p in places[i] and toxic[i] == k for i in some) for k in (False, True))
            w = np.log((b + 0.5) / (n[1] + 1)) - np.log((a + 0.5) / (n[0] + 1)) - t.SHRINK * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if b and w > 0:
                out[p] = np.float32(w)
        return out

    def evidence(i, w):
        of = [max((float(w.get(p, 0)) for x in t._WORD.findall(r) for p in t.beginnings(x)), default=0.0) for r in tokens[i]]
        hit = {r: v for r, v in zip(tokens[i], of, strict=True) if v}
        n = sum(v > 0 for v in of)
        return [np.log1p(sum(hit.values())), max(of, default=0.0), np.log1p(n), np.log1p(len(hit)), np.log1p(1000 * n / (len(of) + 20))]

    by_fold = {f: weights([i for i in known if fold[i] != f]) for f in range(t.FOLDS)}
    w, mean, scale = t.logistic(np.array([evidence(i, by_fold[fold[i]]) for i in known]), np.array([float(toxic[i]) for i in known]))
    full = weights(known)
    for i, _ in rows:
        z = float(((np.array(evidence(i, full)) - mean) / scale) @ w[:-1] + w[-1])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-4), i


def test_rows_are_judged_by_their_own_text(spark, docs_of):
    rows, _ = synthetic()
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    rude, calm = rows[0][1], rows[1][1]
    docs = docs_of([*rows, (None, rude), (None, calm), (1, rude), (5000, None)]).withColumn("score", F.lit(1)).withColumn("c0", F.lit("x"))
    left = t.without_toxic(docs, labels)
    assert left.dtypes == docs.dtypes
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert (None, calm) in got and (None, rude) not in got and (1, calm) in got and (1, rude) not in got and (5000, None) in got
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.without_toxic(docs, none).count() == docs.count()


def test_trigrams_are_counted_in_bounded_memory():
    """A slice of the joined texts at a time, with the counts of the whole."""
    text = " " + "a ß, word  and\n\n- another é€ " * 150_000
    classes, total = t.class_table(), np.zeros(t.CLASSES**3, np.int64)
    tracemalloc.start()
    t.count_trigrams(text, classes, total)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32e6
    c = classes[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), t.LAST_LATIN + 1)]
    c = c[(c > 0) | (np.concatenate(([1], c[:-1])) > 0)]
    assert (total == np.bincount((c[:-2] << 12) | (c[1:-1] << 6) | c[2:], minlength=t.CLASSES**3)).all()
