"""Quality of documents by hierarchical empirical Bayes.

A document's own evidence is a logistic model over figures of its text.  Hosts
and paths have posteriors: the mean of what is known of their documents (the
label of a labelled one, the evidence of others) is shrunk, a path's towards
its host's, a host's towards the global mean, by strengths estimated from the
spread between groups (method of moments), so sparse sites say little.  The
odds of the path without the document, against the global odds, then weigh the
document's own: none is counted twice, none is scored by its own label.  All
figures and means are DataFrame expressions over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.llm.common import cut, table, word_count

#: Paths that are broadcast at most (beyond, a salted join); salts.
BROADCAST_PATHS, SALTS = 100_000, 64
#: Penalty of squared weights, rounds of Newton's method at most, and the parts of one in which slopes and curvatures are summed (integers: in any order the same sum).
RIDGE, ROUNDS, SLOPE_PARTS, CURVE_PARTS = 1.0, 50, 2.0**30, 2.0**20
#: Strengths of the priors are kept within these bounds.
WEAKEST, STRONGEST = 2.0, 1e6


def figures(text: Column) -> dict[str, Column]:
    """What the document classifier sees of a text; all finite, also for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")
    words = word_count(t).cast("double")
    tokens = F.split(F.lower(t), r"[\x20\x09-\x0D]+")
    lines = F.split(t, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / (n + 1)

    return {
        "length": F.log1p(words),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:'\"!?()-]"),
        "shouts": share(r"[!?]{2,}"),
        "stops": F.regexp_count(t, F.lit(r"[.,;:]")) / (words + 1),
        "word_length": n / (words + 1),
        "new_words": F.size(F.array_distinct(tokens)) / (F.size(tokens) + 1),
        "new_lines": F.size(F.array_distinct(lines)) / (F.size(lines) + 1),
    }


def _strength(groups: DataFrame, mean: Column, size: Column, prior: Column) -> float:
    """Prior strength by the method of moments: how many documents the prior of a group is worth."""
    row = groups.select(mean.alias("m"), size.cast("double").alias("n"), prior.alias("p")).agg(F.sum(F.col("n") * (F.col("m") - F.col("p")) ** 2), F.sum(F.col("p") * (1 - F.col("p"))), F.sum("n"), F.count("*"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p")))).first()
    spread, within, n, k, weighted = (float(x or 0) for x in row)
    between = (spread - within) / n if n else 0.0
    if k < 2 or between <= 0:
        return STRONGEST
    return float(min(max(weighted / n / between - 1, WEAKEST), STRONGEST))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _moments(rows: DataFrame, x: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations, by exact sums."""

    def means(of: list[Column]) -> np.ndarray:
        return np.array([float(v) for v in rows.agg(*[F.sum(c.cast("decimal(38,18)")) / F.count("*") for c in of]).first()])

    mean = means(x)
    return mean, np.sqrt(means([(c - float(m)) * (c - float(m)) for c, m in zip(x, mean, strict=True)])) + 1e-9


def _logistic(rows: DataFrame, x: list[Column]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on all ``rows`` (column good): a round sums slopes and curvatures where rows lie; (weights with the intercept last, means, scales)."""
    mean, scale = _moments(rows, x)
    k = len(x) + 1
    upper = np.triu_indices(k)
    w, penalty = np.zeros(k), np.full(k, RIDGE)
    penalty[-1] = 1e-6
    seen = rows.select("good", *[c.alias(f"x{i}") for i, c in enumerate(x)])
    for _ in range(ROUNDS):

        def sums(batches: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            slope, curve = np.zeros(k, dtype=np.int64), np.zeros(len(upper[0]), dtype=np.int64)
            for pdf in batches:
                a = pdf.to_numpy(dtype=float)
                z = np.hstack([(a[:, 1:] - mean) / scale, np.ones((len(a), 1))])
                p = 1 / (1 + np.exp(-np.clip((z * w).sum(1), -30, 30)))
                slope += np.rint(z * (a[:, :1] - p[:, None]) * SLOPE_PARTS).astype(np.int64).sum(0)
                bent = z * (p * (1 - p))[:, None]
                curve += np.rint(bent[:, upper[0]] * z[:, upper[1]] * CURVE_PARTS).astype(np.int64).sum(0)
            both = np.concatenate([slope, curve])
            yield pd.DataFrame({"at": range(len(both)), "v": both})

        parts = seen.mapInPandas(sums, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("at")
        got = np.array([float(r["v"]) for r in parts.collect()])  # a value for each weight and each two of them
        h = np.zeros((k, k))
        h[upper] = got[k:] / CURVE_PARTS
        h = h + np.triu(h, 1).T + np.diag(penalty)
        d = np.linalg.solve(h, got[:k] / SLOPE_PARTS - penalty * w)
        w = w + d
        if np.abs(d).max() < 1e-8:
            break
    return w, mean, scale


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: doc_id, own, host_mean, path_mean, score, kept.

    own is the document's own probability of good quality, host_mean and
    path_mean are the shrunken means of the others of its host and path, score
    combines them, kept is score >= 0.5.  Labels are learned from all rows with
    crc32(doc_id) mod 5 <> 0; those of others are never looked at.  Null
    hosts and paths are groups of their own.  Null and empty texts have figures
    of zero words and are scored like others.  Without labels of both kinds own
    is the share of good ones (0.5 if there are none).
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text_col).alias("text"))
    named = figures(F.col("text"))
    slim = slim.select("doc_id", "host", "path", *[c.alias(k) for k, c in named.items()])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("good")).filter("doc_id is not null and good is not null").filter(~held_out)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("good").alias("good"))
    slim = cut(slim.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    fit = slim.filter("good is not null")
    n, good = fit.agg(F.count("*"), F.sum(F.col("good").cast("long"))).first()
    if n and 0 < good < n:
        x = [F.col(c) for c in named] + [F.sqrt(F.greatest(F.col(c), F.lit(0.0))) for c in named]
        w, mean, scale = _logistic(fit, x)
        z = F.lit(float(w[-1] - (w[:-1] * mean / scale).sum()))
        for c, v in zip(x, w[:-1] / scale, strict=True):
            z = z + c * float(v)
        own = 1 / (1 + F.exp(-F.greatest(F.lit(-15.0), F.least(F.lit(15.0), z))))
    else:
        own = F.lit(good / n if n else 0.5)
    # what is known of a document: the label of a labelled one, else its evidence
    rows = cut(slim.select("doc_id", "host", "path", own.alias("own"), F.coalesce(F.col("good").cast("double"), own).alias("says")))
    paths = cut(rows.groupBy("host", "path").agg(F.sum(F.col("says").cast("decimal(38,12)")).cast("double").alias("s"), F.count("*").alias("n")))
    total = paths.agg(F.sum("s"), F.sum("n"), F.count("*")).first()
    prior = float(total[0] / total[1]) if total[1] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    a = _strength(hosts, F.col("hs") / F.col("hn"), F.col("hn"), F.lit(prior))
    paths = cut(paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h"))
    b = _strength(paths, F.col("s") / F.col("n"), F.col("n"), (F.col("hs") + a * prior) / (F.col("hn") + a))
    paths = paths.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "s", "n", "hs", "hn")
    same = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))
    if total[2] <= BROADCAST_PATHS:
        joined = rows.join(F.broadcast(paths), same)
    else:  # a hot path's rows are dealt over the salts
        salted = paths.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "own"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("_t")))
    # all of a site but the document itself
    joined = joined.withColumn("host_mean", (F.col("hs") - F.col("says") + a * prior) / (F.col("hn") - 1 + a))
    joined = joined.withColumn("path_mean", (F.col("s") - F.col("says") + b * F.col("host_mean")) / (F.col("n") - 1 + b))
    odds = _logit(F.col("own")) + _logit(F.col("path_mean")) - _logit(F.lit(prior))
    score = 1 / (1 + F.exp(-odds))
    return joined.select("doc_id", "own", "host_mean", "path_mean", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
