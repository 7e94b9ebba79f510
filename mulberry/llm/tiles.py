"""Vectors packed into tiles, a matrix to a row, and the meeting of blocks of queries with shards of candidates.

Every block meets every shard in a task of its own: what a task holds and
multiplies has a bound, and tasks grow with the product of both.  A block or a
shard is dealt by a hash of the identifier, so equal vectors or labels don't
gather in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors to a tile of queries and of candidates.
QUERY_TILE, TILE = 2048, 4096
#: Shards of candidates at least; numbers of a shard and of a block of queries, about.
SHARDS, SHARD_NUMBERS, BLOCK_NUMBERS = 12, 1 << 22, 1 << 20


def finite(vectors: DataFrame, id_col: str, vec_col: str, **more: Column) -> DataFrame:
    """(vec_id, v, *more) with v as doubles, of rows with an identifier and a vector without null or non-finite components."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *(c.alias(n) for n, c in more.items()))
    return rows.filter("vec_id is not null and v is not null").filter(good)


def layout(rows: DataFrame, is_query: Column) -> tuple[int, int]:
    """Numbers of blocks of queries and of shards of candidates, by the numbers that all vectors hold."""
    every, asked = rows.agg(F.sum(F.size("v") + 1), F.sum(F.when(is_query, F.size("v") + 1))).first()
    return 1 + (asked or 0) // BLOCK_NUMBERS, max(SHARDS, (every or 0) // SHARD_NUMBERS)


def dealt(n: int, column: str) -> Column:
    """Which of n blocks or shards a vec_id belongs to."""
    return F.pmod(F.xxhash64("vec_id", F.lit(column)), F.lit(n)).cast("int").alias(column)


def packed(rows: DataFrame, key: str, size: int, kind: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, d, ids, m, *more): tiles of up to ``size`` rows (key, vec_id, v, *more) of a task, by key and dimension.

    ``kind`` is numpy's name of the numbers in m; the columns of ``more`` are
    long, or arrays of long, which come as one list after another with their
    lengths in ``<name>_n``.
    """
    types = dict(rows.dtypes)
    lists = [c for c in more if types[c].startswith("array")]
    names = [key, "d", "ids", "m", *more, *(f"{c}_n" for c in lists)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def tile(at: tuple, part: list) -> pa.RecordBatch:
            cols = list(zip(*part, strict=True))
            out = [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.array(cols[0], "<i8").tobytes()]), pa.array([np.concatenate(cols[1]).astype(kind).tobytes()])]
            sizes = []
            for c, values in zip(more, cols[2:], strict=True):
                if c in lists:
                    sizes.append(pa.array([np.array([len(v) for v in values], "<i8").tobytes()]))
                    values = [x for v in values for x in v]
                out.append(pa.array([np.array(values, "<i8").tobytes()]))
            return pa.record_batch([*out, *sizes], names)

        for batch in batches:
            vectors = batch.column(2)
            sizes, flat = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
            ends = np.cumsum(sizes)
            extra = [batch.column(3 + i).to_pylist() for i in range(len(more))]
            for i, (k, vec_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                at = (k, int(sizes[i]))
                part = held.setdefault(at, [])
                part.append((vec_id, flat[ends[i] - sizes[i] : ends[i]], *(e[i] for e in extra)))
                if len(part) == size:
                    yield tile(at, held.pop(at))
        for at, part in held.items():
            yield tile(at, part)

    schema = f"{key} int, d int, ids binary, m binary" + "".join(f", {c} binary" for c in names[4:])
    return rows.select(key, "vec_id", "v", *more).mapInArrow(run, schema)


def met(queries: DataFrame, candidates: DataFrame, blocks: int, shards: int, run: Callable[[list[dict], list[dict]], pa.Table], schema: str) -> DataFrame:
    """``run`` over the tiles of every block of queries and every shard of candidates, once each; rows as dicts."""
    n = blocks * shards
    q = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(n, "block", "shard")
    c = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(n, "block", "shard")
    both = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard"))

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.to_pylist(), right.to_pylist())

    return both.applyInArrow(call, schema)


def numbers(raw: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(raw, kind)


def matrix(tile: dict, kind: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and vectors of a tile."""
    ids = numbers(tile["ids"])
    return ids, numbers(tile["m"], kind).reshape(len(ids), tile["d"])
