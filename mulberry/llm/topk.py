"""Exact top-k search: tiled integer matrix products, partial selection per tile, tree merging of top lists.

Vectors are packed into tiles, a matrix to a row.  Queries are a stated set, in
blocks, against all rows, in shards.  Every block meets every shard in a task
of its own, so a task's work has a bound and tasks grow with the product of
both; a task keeps one running top list per query of the tile at hand, so it
passes on k rows a query and shard; those lists are merged in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.llm.common import cut, table

#: Vectors to a tile of queries and of candidates; bytes of tiles that go to Python at once.
QUERY_TILE, TILE = 1024, 4096
#: Shards of candidates at least; candidates of a shard and queries of a block, about: a task multiplies one block by one shard.
SHARDS, SHARD_ROWS, BLOCK_ROWS = 12, 65_536, 16_384
#: A score below all others that can be negated, and the id of no vector.
LOWEST, NO_ID = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).min


def floor_scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): the components times ``scale``, as doubles, rounded down; without vectors that are null or hold null or non-finite components."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(good)
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def _tiles(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Pack the rows of each task into tiles by key: (*keys, d, ids, m), matrices as little-endian bytes of 64-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def tile(key: tuple, part: list) -> pd.DataFrame:
            ids, vs = zip(*part, strict=True)
            return pd.DataFrame([(*key, np.array(ids, "<i8").tobytes(), np.concatenate(vs).astype("<i8").tobytes())], columns=[*keys, "d", "ids", "m"])

        for pdf in batches:
            for row in pdf[[*keys, "vec_id", "v"]].itertuples(index=False):
                key = (*row[:-2], len(row[-1]))
                part = held.setdefault(key, [])
                part.append((row[-2], np.asarray(row[-1], np.int64)))
                if len(part) == size:
                    yield tile(key, held.pop(key))
        for key, part in held.items():
            yield tile(key, part)

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "d int, ids binary, m binary"]))


def _exact_product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where every partial sum is an exact double."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best scores and their ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top_k(vectors: DataFrame, k: int = 5, is_query: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query; all, if there are fewer.

    Candidates of a query are all rows but those of its own vec_id, of the same
    dimension.  Ties go to the smaller vec_id.  Vectors that are null or hold
    null or non-finite components take no part; empty vectors score 0 with each
    other.  Rows repeated with one vec_id are candidates each; as queries the
    least of them by components counts.
    """
    spark = vectors.sparkSession
    rows = floor_scaled(vectors, id_col, vec_col, scale)
    is_query = is_query if is_query is not None else F.col("vec_id") % 50 == 0
    if shards is None:
        shards = max(SHARDS, vectors.count() // SHARD_ROWS)
    blocks = 1 + vectors.select(F.col(id_col).cast("long").alias("vec_id")).filter(is_query).count() // BLOCK_ROWS
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))

    def dealt(n: int, column: str) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(column)), F.lit(n)).cast("int").alias(column)

    # a task packs whole blocks, so their tiles are full
    q = _tiles(queries.select("vec_id", "v", dealt(blocks, "block")).repartition(blocks, "block"), ["block"], QUERY_TILE)
    q = q.select("block", "d", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    c = _tiles(rows.select("vec_id", "v", dealt(shards, "shard")).repartition(shards, "shard"), ["shard"], TILE)
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumnRenamed("d", "d2")
    tasks = blocks * shards
    pairs = q.repartition(tasks, "block", "shard").join(c.repartition(tasks, "block", "shard"), ["block", "shard"]).filter("d = d2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, q_ids, q, best = None, None, None, None

        def done() -> pd.DataFrame:
            s, ids = best
            real = ids != NO_ID
            n = real.sum(1)
            return pd.DataFrame({"query_id": np.repeat(q_ids, n), "vec_id": ids[real], "score": s[real]})

        for pdf in batches:
            for d, ids, m, c_ids, c_m in pdf[["d", "q_ids", "q_m", "ids", "m"]].itertuples(index=False):
                if at != ids:
                    if best is not None:
                        yield done()
                    at, q_ids, q, best = ids, np.frombuffer(ids, "<i8"), np.frombuffer(m, "<i8").reshape(-1, d), None
                    if not d:
                        q = np.zeros((len(q_ids), 0), np.int64)
                c_id = np.frombuffer(c_ids, "<i8")
                s = _exact_product(q, np.frombuffer(c_m, "<i8").reshape(len(c_id), d))
                own = q_ids[:, None] == c_id[None, :]
                s[own] = LOWEST
                # candidates below the k-th best score can't be in the list; of those at it the smaller ids are chosen
                keep = min(k + int(own.sum(1).max(initial=0)), s.shape[1])
                edge = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
                width = int((s >= edge[:, None]).sum(1).max())
                top = np.argpartition(-s, min(width, s.shape[1]) - 1, axis=1)[:, :width]
                s, i = np.take_along_axis(s, top, 1), c_id[top]
                i = np.where(s == LOWEST, NO_ID, i)
                if best is not None:
                    s, i = np.hstack([best[0], s]), np.hstack([best[1], i])
                best = _best(s, i, k)
        if best is not None:
            yield done()

    lists = pairs.select("d", "q_ids", "q_m", "ids", "m")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        partial = cut(lists.mapInPandas(run, "query_id long, vec_id long, score long"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    order = [F.desc("score"), "vec_id"]
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
