"""Nearest neighbours by largest inner product: vantage-point trees per shard, pruned by a triangle inequality that a factor relaxes.

Vectors of a shard are divided by their greatest length and lifted to the unit
sphere by one more component, which a query, of length one, has as 0: the angle
between a query and a lifted vector then falls as their inner product grows,
and angles obey the triangle inequality.  Every inner node of a tree halves its
rows by their angle to a vantage point and keeps the least and greatest angle
of either half.  A query at angle a to the vantage point is no nearer to a half
than a - greatest or least - a; it visits leaves in the order of that bound and
stops where ``factor`` times the bound is beyond the angle of its k-th best
neighbour.  Factor one stops at what can't be nearer: exact search.

Equal vectors are one entry of a tree, with all their identifiers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.llm.common import cut, stored, table
from mulberry.llm.tiles import QUERY_TILE, dealt, finite, layout, matrix, met, numbers, packed

#: Entries of a leaf at most; how much the triangle inequality is relaxed.
LEAF, FACTOR = 128, 4.0
#: Angles and cosines are known to about this much.
ANGLE_SLACK, COSINE_SLACK = 1e-6, 1e-12
#: Entries kept of the queries at hand, in multiples of their number, before those beyond the k-th best go; products of pairs at once.
POOL, PAIRS = 256, 65_536
#: Shards whose lists are merged at once.
MERGED = 64

_TREE = "shard int, d int, ids binary, sizes binary, m binary, vantage binary, bounds binary"


def _lengths_one(x: np.ndarray) -> np.ndarray:
    """Vectors divided by the greatest length among them; safe for very large and small components."""
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum(1).max())


def _tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by leaves, vantage points (rows of that order) and bounds of the inner nodes, level by level.

    Node i of level l holds rows n*i >> l to n*(i+1) >> l.
    """
    n, unit = len(x), _lengths_one(x)
    y = np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))])
    order, vantage, bounds = np.arange(n), [], []
    for level in range(max(0, math.ceil(math.log2(n / LEAF)))):
        for i in range(1 << level):
            a, e = n * i >> level, n * (i + 1) >> level
            rows = order[a:e]
            point = rows[np.argmin(y[rows] @ y[rows[0]])]  # far from any one row: its angles spread
            angle = np.arccos(np.clip(y[rows] @ y[point], -1, 1))
            half = (n * (2 * i + 1) >> (level + 1)) - a
            part = np.argpartition(angle, half)
            order[a:e], angle = rows[part], angle[part]
            vantage.append(point)
            bounds.append((angle[:half].min(), angle[:half].max(), angle[half:].min(), angle[half:].max()))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place[np.array(vantage, np.int64)], np.array(bounds).reshape(-1, 4)


def _build(group: pa.Table) -> pa.Table:
    """A tree of each dimension of a shard's rows (shard, vec_id, v)."""
    shard, ids, v = group.column("shard")[0].as_py(), group.column("vec_id").to_numpy(), group.column("v").combine_chunks()
    sizes, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
    ends, out = np.cumsum(sizes), []
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        x, entry = np.unique(flat[(ends[rows] - d)[:, None] + np.arange(d)[None, :]] + 0.0, axis=0, return_inverse=True)
        order, vantage, bounds = _tree(x)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        entry = place[entry.ravel()]
        by = np.lexsort((ids[rows], entry))
        out.append((shard, d, ids[rows][by].astype("<i8").tobytes(), np.bincount(entry, minlength=len(x)).astype("<i8").tobytes(), x[order].astype("<f8").tobytes(), vantage.astype("<i8").tobytes(), bounds.astype("<f8").tobytes()))
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["shard", "d", "ids", "sizes", "m", "vantage", "bounds"])


def index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shards: int = 12) -> DataFrame:
    """The trees of all vectors with an identifier that are finite and not zero: a row a shard and dimension, a task a shard."""
    rows = _taking_part(vectors, id_col, vec_col)
    return rows.withColumn("shard", dealt(shards, "shard")).repartition(shards, "shard").groupBy("shard").applyInArrow(_build, _TREE)


def _taking_part(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return finite(vectors, id_col, vec_col).filter(F.exists("v", lambda x: x != 0))


def _leaf_bounds(cosines: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each query and leaf the greatest of the bounds on its path; below 0 the deeper a query lies within."""
    angle, levels = np.arccos(np.clip(cosines, -1, 1)), (len(bounds) + 1).bit_length() - 1
    key, at = np.full((len(angle), 1), -np.inf), 0
    for level in range(levels):
        a, b = angle[:, at : at + (1 << level)], bounds[at : at + (1 << level)]
        halves = [np.maximum(key, np.maximum(a - b[:, 2 * h + 1], b[:, 2 * h] - a)) for h in (0, 1)]
        key, at = np.stack(halves, axis=2).reshape(len(angle), -1), at + (1 << level)
    return key


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs, the same for equal pairs wherever they stand."""
    return np.concatenate([(q[qi[i : i + PAIRS]] * x[xi[i : i + PAIRS]]).sum(1) for i in range(0, len(qi), PAIRS)] or [np.zeros(0)])


def _search_tree(q_ids: np.ndarray, q: np.ndarray, tree: dict, k: int, factor: float) -> list[np.ndarray]:
    """query_id, vec_id, score of the k nearest found of each query."""
    sizes, ids = numbers(tree["sizes"]), numbers(tree["ids"])
    x = numbers(tree["m"], "<f8").reshape(len(sizes), tree["d"])
    starts = np.cumsum(sizes) - sizes
    unit, least = _lengths_one(x), ids[starts]
    q_unit = q / np.abs(q).max(1)[:, None]
    q_unit /= np.sqrt((q_unit * q_unit).sum(1))[:, None]
    bounds = numbers(tree["bounds"], "<f8").reshape(-1, 4)
    key = _leaf_bounds(q_unit @ unit[numbers(tree["vantage"])].T, bounds)
    turn, leaves, n, kept = np.argsort(key, axis=1, kind="stable"), key.shape[1], len(x), k + 1
    shift = leaves.bit_length() - 1
    best = np.full((len(q), kept), -np.inf)  # cosines of the best entries; one more than k, as a query's own may be among them
    pool: list[tuple[np.ndarray, ...]] = []
    pooled = 0

    def settle() -> None:
        """Entries that can't be among the best go; of ties those of the smallest identifiers stay."""
        nonlocal pool, pooled
        qi, xi, s = (np.concatenate(c) for c in zip(*pool, strict=True))
        near = s >= best[qi, 0] - COSINE_SLACK
        qi, xi, s = qi[near], xi[near], s[near]
        order = np.lexsort((least[xi], -_exact(q, x, qi, xi), qi))
        qi, xi, s = qi[order], xi[order], s[order]
        near = np.arange(len(qi)) - np.searchsorted(qi, qi) < kept
        pool = [(qi[near], xi[near], s[near])]
        pooled = int(near.sum())

    live = np.arange(len(q))
    for r in range(leaves):
        limit = np.arccos(np.clip(best[live, 0], -1, 1))
        bound = np.maximum(0, key[live, turn[live, r]])
        live = live[~((factor * bound > limit + ANGLE_SLACK) & np.isfinite(best[live, 0]))]
        if not len(live):
            break
        leaf = turn[live, r]
        by = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by])) + 1
        for group in np.split(live[by], edges):
            i = int(turn[group[0], r])
            a, e = n * i >> shift, n * (i + 1) >> shift
            s = q_unit[group] @ unit[a:e].T
            at, col = np.nonzero(s >= best[group, 0][:, None] - COSINE_SLACK)
            if len(at):
                pool.append((group[at], a + col, s[at, col]))
                pooled += len(at)
                has = np.unique(at)
                best[group[has]] = np.partition(np.hstack([best[group[has]], s[has]]), s.shape[1], axis=1)[:, s.shape[1] :]
                # the least of the best stands first
                best[group[has]] = np.sort(best[group[has]], axis=1)
            if pooled > POOL * len(q):
                settle()
    settle()
    qi, xi, _ = pool[0]
    score = _exact(q, x, qi, xi)
    n_ids = np.minimum(sizes[xi], kept)
    row = np.repeat(np.arange(len(qi)), n_ids)
    vec = ids[starts[xi][row] + np.arange(len(row)) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)]
    qi, score = qi[row], score[row]
    other = vec != q_ids[qi]
    qi, vec, score = qi[other], vec[other], score[other]
    order = np.lexsort((vec, -score, qi))
    qi, vec, score = qi[order], vec[order], score[order]
    near = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return [q_ids[qi[near]], vec[near], score[near]]


def _best(rows: DataFrame, k: int, *more: str) -> DataFrame:
    order = Window.partitionBy("query_id", *more).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = 20, factor: float = FACTOR, is_query: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of the largest inner product that are found for each query; exact for ``factor`` 1.

    Candidates of a query are all rows but those of its own vec_id, of the same
    dimension.  Nearest first, ties to the smaller vec_id; score is the inner
    product of the vectors as they are.  Rows without identifier, and vectors
    that are null or zero or hold null or non-finite components, take no part.
    Rows repeated with one vec_id are candidates each; as queries the least of
    them by components counts.
    """
    is_query = is_query if is_query is not None else F.col("vec_id") % 20 == 0
    rows = _taking_part(vectors, id_col, vec_col)
    blocks, shards = layout(rows, is_query)
    trees = stored(index(vectors, id_col, vec_col, shards), "vp-trees")
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", dealt(blocks, "block"))
    asked = packed(queries.repartition(blocks, "block"), "block", QUERY_TILE, "<f8")

    def run(q_tiles: list[dict], trees: list[dict]) -> pa.Table:
        found = [_search_tree(*matrix(q, "<f8"), tree, k, factor) for q in q_tiles for tree in trees if tree["d"] == q["d"]]
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        shard = trees[0]["shard"] // MERGED if trees else 0
        return pa.table([pa.array(np.full(len(cols[0]), shard, np.int32)), *(pa.array(c) for c in cols)], ["part", "query_id", "vec_id", "score"])

    lists = met(asked, trees, blocks, shards, run, "part int, query_id long, vec_id long, score double")
    if shards > MERGED:
        lists = _best(cut(lists), k, "part").drop("rank")
    return _best(lists, k).select("query_id", "rank", "vec_id", "score")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
