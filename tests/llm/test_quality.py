import random
import zlib

import numpy as np

from mulberry.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = q.op9_quality(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    both = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(got, on="doc_id")
    both = both[[zlib.crc32(str(i).encode()) % 5 == 0 for i in both["doc_id"]]]
    assert both.loc[both["quality"] == 1, "kept"].mean() > 0.95
    assert both.loc[both["quality"] == 0, "kept"].mean() < 0.2


def sites(seed, hosts):
    """Documents of hosts with a share of good ones; a text of few words says little about its own."""
    rng = random.Random(seed)
    rows = []
    for host, path, share, n in hosts:
        for _ in range(n):
            good = rng.random() < share
            text = " ".join(rng.choices(["river", "stone", "window", "garden", "music."], k=30) + ["###"] * (rng.random() < (0.35 if good else 0.65)))
            rows.append((len(rows), text, path, host, int(good)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    return docs, spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")


def test_scores_are_those_of_a_plain_computation(spark):
    rows = sites(1, [("good", "a", 0.95, 200), ("good", "b", 0.6, 60), ("bad", "a", 0.05, 200), ("one", "a", 0.0, 1), (None, None, 0.5, 20)])
    docs, labels = frames(spark, rows)
    got = q.score_quality(docs, labels).toPandas().set_index("doc_id")
    learned = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    says = {r[0]: float(r[4]) if r[0] in learned else got["own"][r[0]] for r in rows}
    by_host, by_path = {}, {}
    for i, _, path, host, _ in rows:
        by_host.setdefault(host, []).append(i)
        by_path.setdefault((host, path), []).append(i)
    prior = np.mean(list(says.values()))

    def strength(groups, prior_of):
        m = np.array([np.mean([says[i] for i in g]) for g in groups.values()])
        n = np.array([len(g) for g in groups.values()], float)
        p = np.array([prior_of(k) for k in groups])
        between = ((n * (m - p) ** 2).sum() - (p * (1 - p)).sum()) / n.sum()
        return q.STRONGEST if between <= 0 else min(max((n * p * (1 - p)).sum() / n.sum() / between - 1, q.WEAKEST), q.STRONGEST)

    a = strength(by_host, lambda k: prior)
    b = strength(by_path, lambda k: (sum(says[i] for i in by_host[k[0]]) + a * prior) / (len(by_host[k[0]]) + a))
    for i, _, path, host, _ in rows:
        h = (sum(says[j] for j in by_host[host] if j != i) + a * prior) / (len(by_host[host]) - 1 + a)
        p = (sum(says[j] for j in by_path[host, path] if j != i) + b * h) / (len(by_path[host, path]) - 1 + b)
        assert abs(got["host_mean"][i] - h) < 1e-9 and abs(got["path_mean"][i] - p) < 1e-9
        assert abs(got["score"][i] - 1 / (1 + np.exp(-(_logit(got["own"][i]) + _logit(p) - _logit(prior))))) < 1e-6


def test_the_hierarchy_helps_where_texts_say_little(spark):
    rng = random.Random(3)
    hosts = [(f"h{k}", "a", rng.choice([0.05, 0.95]), rng.choice([2, 3, 40])) for k in range(60)]
    rows = sites(2, hosts)
    docs, labels = frames(spark, rows)
    got = q.score_quality(docs, labels).toPandas()
    truth = {r[0]: r[4] for r in rows}
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]]
    y = held["doc_id"].map(truth).to_numpy()

    def auc(s):
        pos, neg = s[y == 1], s[y == 0]
        return (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()

    assert auc(held["score"].to_numpy()) > auc(held["own"].to_numpy()) + 0.15
    # shrunken sites do better than their bare means
    size = docs.groupBy("source").count().toPandas().set_index("source")["count"]
    sparse = held["doc_id"].map({r[0]: size[r[3]] < 5 for r in rows}).to_numpy()
    assert ((held["path_mean"] > 0.01) & (held["path_mean"] < 0.99))[sparse].all()


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def test_odd_rows(spark, docs_of):
    rows = [(1, None, None), (2, "", "a"), (3, "x " * 50_000, "a"), (3, "x", "a"), (None, "x", "a")]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = q.score_quality(docs_of(rows), none).collect()
    assert len(got) == 5 and all(r.own == 0.5 and r.kept for r in got)
    assert q.score_quality(docs_of([]), none).count() == 0


def test_many_paths_are_salted(spark, docs_of, monkeypatch):
    rows = [(i, f"text {i % 5}", f"s{i % 9}") for i in range(90)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = sorted(map(tuple, q.score_quality(docs_of(rows), none).collect()))
    monkeypatch.setattr(q, "BROADCAST_PATHS", 1)
    assert sorted(map(tuple, q.score_quality(docs_of(rows), none).collect())) == one


def test_every_label_counts(spark, docs_of):
    """More labels than a fit once took: the good ones of one path all raise its mean, and the weights are those of Newton's method over all rows."""
    from pyspark.sql import functions as F

    from mulberry.llm.toxicity import logistic

    n = 90_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("river stone "), F.repeat(F.lit("! "), (F.col("id") % 7).cast("int")), F.lit("end")).alias("text"), F.lit("a").alias("lang"), F.lit("h").alias("source"))
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) < F.col("doc_id") % 7).cast("int").alias("quality"))
    got = q.score_quality(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").toPandas()
    learned = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in got["doc_id"]])
    assert learned.sum() > 60_000
    x = spark.createDataFrame(got[["doc_id", "text"]]).select("doc_id", *[c.alias(k) for k, c in q.figures(F.col("text")).items()]).toPandas().set_index("doc_id").loc[got["doc_id"]].to_numpy(dtype=float)
    x = np.hstack([x, np.sqrt(np.maximum(x, 0))])
    w, mean, scale = logistic(x[learned], got["quality"].to_numpy(dtype=float)[learned])
    own = 1 / (1 + np.exp(-((x - mean) / scale @ w[:-1] + w[-1])))
    assert np.abs(own - got["own"]).max() < 1e-5
    says = np.where(learned, got["quality"], got["own"])
    assert abs(got["path_mean"].mean() - says.mean()) < 1e-3
