"""Hard-negative mining by distributed radix selection.

Of every anchor and positive the scores of rows of other labels within a window
below the positive's score count.  A task counts, of its block of anchors and
its shard of rows, how many scores of each window fall into each value of the
leading digit (of base 256) of their distance from the window's lower end;
counts are added up over the shards, which tells the digit that the k-th best
score has.  The next round counts the next digit of the scores within it.  Only
when every window knows its k-th best score are rows gathered: those at or
above it, k of a task at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.llm.common import cut, table
from mulberry.llm.tiles import QUERY_TILE, TILE, dealt, finite, layout, matrix, met, numbers, packed
from mulberry.llm.topk import LOWEST, NO_ID, _best, _exact_product

#: Bits of a digit.
DIGIT = 8


def _positives(q_tiles: list[dict], c_tiles: list[dict], k: int) -> pa.Table:
    """(anchor_id, vec_id, score): the k best other rows of each anchor's label, label by label."""
    out: list[tuple[np.ndarray, ...]] = []
    for q in q_tiles:
        ids, m = matrix(q)
        labels = numbers(q["label"])
        best = np.full((len(ids), k), LOWEST), np.full((len(ids), k), NO_ID)
        for c in c_tiles:
            if c["d"] != q["d"]:
                continue
            c_ids, c_m = matrix(c)
            c_labels = numbers(c["label"])
            order = np.argsort(c_labels, kind="stable")
            for label in np.intersect1d(labels, c_labels):
                mine = np.flatnonzero(labels == label)
                there = order[np.searchsorted(c_labels[order], label) : np.searchsorted(c_labels[order], label, "right")]
                s = _exact_product(m[mine], c_m[there])
                s[ids[mine][:, None] == c_ids[there][None, :]] = LOWEST
                i = np.where(s == LOWEST, NO_ID, np.broadcast_to(c_ids[there], s.shape))
                top = _best(np.hstack([best[0][mine], s]), np.hstack([best[1][mine], i]), k)
                best[0][mine], best[1][mine] = top
        real = best[1] != NO_ID
        out.append((np.repeat(ids, real.sum(1)), best[1][real], best[0][real]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(["anchor_id", "vec_id", "score"], cols, strict=True)))


def _windows(q: dict) -> list[list[tuple[int, int, int, int]]]:
    """Of each anchor of a tile its windows: (pos, low, high, need)."""
    cols = [numbers(q[c]).tolist() for c in ("pos", "low", "high", "need")]
    flat, out, at = list(zip(*cols, strict=True)), [], 0
    for n in numbers(q["pos_n"]).tolist():
        out.append(flat[at : at + n])
        at += n
    return out


def _others(q: dict, c_tiles: list[dict]):
    """(anchor's place, windows, identifiers, scores) of the rows of other labels in each tile that reach the lowest of an anchor's windows."""
    ids, m = matrix(q)
    labels, windows = numbers(q["label"]), _windows(q)
    floor = np.array([min(w[1] for w in ws) for ws in windows])
    for c in c_tiles:
        if c["d"] != q["d"]:
            continue
        c_ids, c_m = matrix(c)
        s = _exact_product(m, c_m)
        good = (s >= floor[:, None]) & (labels[:, None] != numbers(c["label"])[None, :]) & (ids[:, None] != c_ids[None, :])
        for i in np.flatnonzero(good.any(1)):
            at = np.flatnonzero(good[i])
            yield i, windows[i], c_ids[at], s[i, at]


def _digits(low: int, high: int) -> int:
    """Bits below the leading digit of distances within a window."""
    return DIGIT * (max(0, (high - low).bit_length() - 1) // DIGIT)


def _counts(q_tiles: list[dict], c_tiles: list[dict]) -> pa.Table:
    """(anchor_id, pos, low, high, n): scores of each value of the windows' leading digit, from the best value on as long as a task's own scores do not fill the window's need."""
    rows = []
    for q in q_tiles:
        ids, held = numbers(q["ids"]), {}
        for i, windows, _, s in _others(q, c_tiles):
            for pos, low, high, need in windows:
                inside = s[(s >= low) & (s <= high)]
                if len(inside):
                    found = held.setdefault((i, pos, low, high, need), np.zeros(1 << DIGIT, np.int64))
                    found += np.bincount((inside - low) >> _digits(low, high), minlength=1 << DIGIT)
        for (i, pos, low, high, need), found in held.items():
            bits, above = _digits(low, high), 0
            for digit in np.flatnonzero(found)[::-1].tolist():
                if above >= need:
                    break
                edge = low + (digit << bits)
                rows.append((int(ids[i]), pos, edge, min(high, edge + (1 << bits) - 1), int(found[digit])))
                above += int(found[digit])
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(["anchor_id", "pos", "low", "high", "n"], cols, strict=True)})


def _gathered(q_tiles: list[dict], c_tiles: list[dict]) -> pa.Table:
    """(anchor_id, pos, vec_id, score): rows within the windows, of a task the ``need`` best of each."""
    rows = []
    for q in q_tiles:
        ids, held = numbers(q["ids"]), {}
        for i, windows, c_ids, s in _others(q, c_tiles):
            for pos, low, high, need in windows:
                inside = (s >= low) & (s <= high)
                if inside.any():
                    old = held.get((i, pos), (np.zeros((1, 0), np.int64),) * 2)
                    held[i, pos] = _best(np.hstack([old[0], s[None, inside]]), np.hstack([old[1], c_ids[None, inside]]), need)
        rows += [(int(ids[i]), pos, v, s) for (i, pos), (ss, vs) in held.items() for s, v in zip(ss[0].tolist(), vs[0].tolist(), strict=True)]
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(["anchor_id", "pos", "vec_id", "score"], cols, strict=True)})


def _floor_div(a: Column, b: int) -> Column:
    """Of a long, rounded down."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b).cast("long"))


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, is_anchor: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor and positive the best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Scores are integer inner products of the components times ``scale``, rounded
    down (64 bits; a hundred times a score must fit them).  Positives are the
    best other rows of the anchor's label; ties go to the smaller vec_id.  Rows
    without identifier or label, and vectors that are null or hold null or
    non-finite components, take no part; vectors of different dimension don't
    meet.  Rows that repeat a vec_id are candidates each; as anchors the least
    of them by components and label counts.  Windows that hold no row have no
    result.  Empty tables give none.
    """
    label = label if label is not None else F.col("label")
    is_anchor = is_anchor if is_anchor is not None else F.col("vec_id") % 50 == 0
    rows = finite(vectors, id_col, vec_col, label=label.cast("long")).filter("label is not null")
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    blocks, shards = layout(rows, is_anchor)
    anchors = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a")).select("vec_id", "a.v", "a.label")
    anchors = cut(anchors)
    c = cut(packed(rows.withColumn("shard", dealt(shards, "shard")).repartition(shards, "shard"), "shard", TILE, "<i8", ("label",)))

    def asked(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
        return packed(df.withColumn("block", dealt(blocks, "block")).repartition(blocks, "block"), "block", QUERY_TILE, "<i8", ("label", *more))

    def with_windows(windows: DataFrame) -> DataFrame:
        per = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "low", "high", "need"))).alias("w"))
        return asked(anchors.join(per, "vec_id").select("vec_id", "v", "label", *(F.col(f"w.{x}").alias(x) for x in ("pos", "low", "high", "need"))), ("pos", "low", "high", "need"))

    best = met(asked(anchors), c, blocks, shards, lambda q, x: _positives(q, x, positives), "anchor_id long, vec_id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("pos", F.row_number().over(order).cast("long")).filter(F.col("pos") <= positives)
    p = F.col("positive_score")
    best = best.select("anchor_id", "pos", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = cut(best.withColumns({"low": -_floor_div(-p * low, 100), "high": _floor_div(p * high, 100)}).filter("low <= high"))

    open_ = best.select("anchor_id", "pos", "low", "high", F.lit(negatives).cast("long").alias("need"))
    settled = []
    while not open_.isEmpty():
        counts = met(with_windows(open_), c, blocks, shards, _counts, "anchor_id long, pos long, low long, high long, n long")
        counts = counts.groupBy("anchor_id", "pos", "low", "high").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("anchor_id", "pos").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(down))
        w = open_.select("anchor_id", "pos", F.col("low").alias("window_low"), "need")
        # the digit's value that the k-th best score has is the first that fills the need; where none does, all scores of the window qualify
        fills = F.when(F.col("upto") >= F.col("need"), F.struct("low", "high", "n", "upto"))
        first = counts.join(w, ["anchor_id", "pos"]).groupBy("anchor_id", "pos", "need", "window_low").agg(F.max(fills).alias("d"))
        done = F.col("d").isNull() | (F.col("d.low") == F.col("d.high")) | (F.col("d.upto") == F.col("need"))
        now = cut(first.select("anchor_id", "pos", F.coalesce("d.low", "window_low").alias("low"), F.col("d.high").alias("high"), (F.col("need") - F.col("d.upto") + F.col("d.n")).alias("need"), done.alias("done")))
        settled.append(now.filter("done").select("anchor_id", "pos", "low"))
        open_ = now.filter("not done").select("anchor_id", "pos", "low", "high", "need")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not settled:
        return vectors.sparkSession.createDataFrame([], schema)
    edges = settled[0]
    for s in settled[1:]:
        edges = edges.unionByName(s)
    final = cut(best.select("anchor_id", "pos", "high").join(edges, ["anchor_id", "pos"]).withColumn("need", F.lit(negatives).cast("long")))
    found = met(with_windows(final), c, blocks, shards, _gathered, "anchor_id long, pos long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "pos").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    return found.join(best.select("anchor_id", "pos", "positive_id", "positive_score"), ["anchor_id", "pos"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS pos FROM s WHERE same) WHERE pos <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.pos ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
