"""Passages that repeat across documents, by content-defined chunking with a gear rolling hash.

A chunk ends where the rolling hash of the bytes there says so, hence the same
passage is cut alike wherever it stands, and an insertion shifts no chunk but
those it touches.  Chunks are compared by digest.  The document of the least
identifier owns a chunk; runs of chunks that others own are repeats.

``passages``, which the query runs, cuts where the hash is least of SPREAD in a
row, so no chunk is longer than that and any passage of BOUND + 2 SPREAD - 1
bytes holds a whole one, with the BOUND bytes that decide each of its ends.
Chunks are deduplicated by the digest of those bytes; runs of chunks with one
owner are verified and widened over equal bytes to the passage's true ends.
``repeated_passages`` cuts where the hash is below a threshold, into longer
chunks, and takes runs of chunks as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.llm.common import apart, cut, stored, table
from mulberry.llm.setsketch import mix64

#: Bytes of a chunk at least and at most, and on average beyond the least; bytes of the rolling window.
LEAST, MOST, MEAN, WINDOW = 24, 256, 32, 16
#: Bytes of a run of repeated chunks from which it is a passage.
PASSAGE = 128
#: Bytes that decide an end of a chunk, places in a row of which one is an end, bytes that a match is widened by at most.
BOUND, SPREAD, REACH = 32, 48, 63
#: One random word for every byte value.
GEAR = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a UTF-8 text given as bytes; never within a character."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h, k = GEAR[data], 1
    while k < WINDOW:  # h[i] = sum of gear[data[i - j]] << j for j < 2 k
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint64(k)
        h, k = wider, 2 * k
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    whole = np.ones(n, bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    marks = (np.flatnonzero((h < (1 << 32) // MEAN) & whole) + 1).tolist()
    out, last = [], 0

    def forced(until: int) -> None:
        nonlocal last
        while until - last > MOST:
            at = last + MOST
            while not whole[at - 1]:
                at -= 1
            out.append(at)
            last = at

    for m in marks:
        if m - last >= LEAST:
            forced(m)
            if m - last >= LEAST:
                out.append(m)
                last = m
    forced(n)
    if last < n:
        out.append(n)
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, idx, start, stop, n_words, hi, lo): the chunks of every whole text; offsets in bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        size = 0

        def out() -> pd.DataFrame:
            nonlocal size
            d = pd.DataFrame({c: np.concatenate(p) for c, p in zip(("doc_id", "idx", "start", "stop", "n_words", "hi", "lo"), cols, strict=True)})
            for p in cols:
                p.clear()
            size = 0
            return d

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                ends = cuts(data)
                if not ends:
                    continue
                stop = np.array(ends, np.int32)
                start = np.concatenate(([0], stop[:-1])).astype(np.int32)
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), ends, strict=True)]), ">i8").reshape(-1, 2).astype(np.int64)
                space = (data == 32) | ((data >= 9) & (data <= 13))
                begins = ~space
                begins[1:] &= space[:-1]
                n_words = np.add.reduceat(begins, start).astype(np.int32)
                k = len(ends)
                for p, v in zip(cols, (np.full(k, doc, np.int64), np.arange(k, dtype=np.int32), start, stop, n_words, digest[:, 0], digest[:, 1]), strict=True):
                    p.append(v)
                size += k
                if size >= 100_000:
                    yield out()
        if size:
            yield out()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    return slim.mapInPandas(run, "doc_id long, idx int, start int, stop int, n_words int, hi long, lo long")


def repeated_passages(docs: DataFrame, least_bytes: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeat: doc_id, first_doc_id, start, stop, n_chunks, n_bytes, n_words.

    [start, stop) are bytes of the UTF-8 text of ``doc_id``, a run of chunks
    that documents of smaller identifiers hold as well, the least of which is
    first_doc_id.  What repeats within one document only is left alone, and so
    are runs of less than ``least_bytes``.  Null and empty texts and rows
    without doc_id take no part; rows repeated with one doc_id are one
    document.  Documents without repeats have no row.
    """
    found = chunks(docs, id_col, text_col)
    owners = cut(found.groupBy("hi", "lo").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("hi", "lo", "owner"))
    again = found.join(owners, ["hi", "lo"]).filter("doc_id > owner").select("doc_id", "idx", "start", "stop", "n_words", "owner")
    runs = again.dropDuplicates(["doc_id", "idx"]).withColumn("run", F.col("idx") - F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")))
    out = runs.groupBy("doc_id", "run").agg(F.min("owner").alias("first_doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"))
    out = out.withColumn("n_bytes", (F.col("stop") - F.col("start")).cast("long")).filter(F.col("n_bytes") >= least_bytes)
    return out.select("doc_id", "first_doc_id", "start", "stop", "n_chunks", "n_bytes", "n_words")


def bounds(data: np.ndarray) -> np.ndarray:
    """Places where chunks of a text given as bytes begin and end, each the first of the BOUND bytes that decide it; none in texts too short to have one."""
    if len(data) < BOUND + SPREAD - 1:
        return np.empty(0, np.int64)
    h, k = GEAR[data], 1
    while k < BOUND:
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint64(k)
        h, k = wider, 2 * k
    h = (h[BOUND - 1 :] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    least, k = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), 1
    while k < SPREAD:
        step = min(k, SPREAD - k)
        least, k = np.minimum(least[:-step], least[step:]), k + step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    v = h[at]
    if (v[1:] == v[:-1]).any():  # of equal strings in a row no more than are needed
        kept, places, values = [0], at.tolist(), v.tolist()
        for i in range(1, len(places)):
            last = kept[-1]
            if not (i + 1 < len(places) and values[last] == values[i] == values[i + 1] and places[i + 1] - places[last] <= SPREAD):
                kept.append(i)
        at = at[kept]
    return at


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, place, key, more): the chunks of every whole text, with the bytes that decide their ends, and their 64-bit digests.

    place is one number of the byte where a chunk begins (32 bits), whether the
    text has had this chunk before (1 bit), and the words that begin before it
    (31 bits); more is its bytes and, in the lowest 8 bits, its words.
    """
    names = ("doc_id", "place", "key", "more")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            size = 0
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, np.uint8)
                ends = bounds(data)
                if len(ends) < 2:
                    continue
                start, stop = ends[:-1], ends[1:] + BOUND
                space = (data == 32) | ((data >= 9) & (data <= 13))
                begins = ~space
                begins[1:] &= space[:-1]
                words = np.concatenate(([0], np.cumsum(begins)))
                key = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.uint64).view(np.int64)
                again = np.ones(len(start), np.int64)
                again[np.unique(key, return_index=True)[1]] = 0
                more = (stop - start) << 8 | words[stop] - words[start]
                for p, v in zip(cols, (np.full(len(start), doc, np.int64), start << 32 | again << 31 | words[start], key, more.astype(np.int32)), strict=True):
                    p.append(v)
                size += len(start)
                if size >= 100_000:
                    yield pd.DataFrame({c: np.concatenate(p) for c, p in zip(names, cols, strict=True)})
                    cols, size = [[], [], [], []], 0
            if size:
                yield pd.DataFrame({c: np.concatenate(p) for c, p in zip(names, cols, strict=True)})

    return docs.mapInPandas(run, "doc_id long, place long, key long, more int")


def widen(start: int, stop: int, words: int, stop_words: int, left: bytes, right: bytes, other_start: int, other_left: bytes, other_right: bytes) -> tuple[int, int, int, int]:
    """Ends of a match of the bytes from ``start`` to ``stop`` widened over equal bytes, and the words that begin before each end.

    ``left`` has up to REACH + 1 bytes before the match and four of it,
    ``right`` its last four bytes and up to REACH + 1 after it.  No end parts a
    character.
    """
    n, m, a = min(start, REACH + 1), min(other_start, REACH + 1), 0
    while a < min(n, m, REACH) and left[n - 1 - a] == other_left[m - 1 - a]:
        a += 1
    i = n - a
    while i < len(left) and left[i] & 0xC0 == 0x80:
        i += 1
    b = 0
    while b < min(len(right) - 4, len(other_right) - 4, REACH) and right[4 + b] == other_right[4 + b]:
        b += 1
    e = 4 + b
    while e < len(right) and right[e] & 0xC0 == 0x80:
        e -= 1

    def begun(raw: bytes, lo: int, hi: int) -> int:
        return sum(raw[x] not in _SPACE and (x == 0 or raw[x - 1] in _SPACE) for x in range(lo, hi))

    before, after = words - begun(left, i, n) + begun(left, n, i), stop_words + begun(right, 4, e) - begun(right, e, 4)
    return start - n + i, stop - 4 + e, before, after


_SPACE = frozenset(b" \t\n\v\f\r")


def passages(docs: DataFrame, least_bytes: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeat, with the columns of ``repeated_passages``, to its true ends.

    Every passage of ``least_bytes`` bytes or more that a document of smaller
    identifier holds as well is in a row.  A match is widened against the least
    document that holds its chunks; where that one goes on otherwise, up to
    REACH bytes at an end can be missing that a later document shares.  Matches
    that touch are one row, and only then is the length tested.  Matches are
    verified by the MD5 digest of all their bytes.  Else as there.
    """
    if least_bytes < BOUND + 2 * SPREAD - 1:
        raise ValueError(f"shorter passages than {BOUND + 2 * SPREAD - 1} bytes need not hold a whole chunk")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    found = chunk_rows(slim)
    # combined before the shuffle, so a hot chunk sends a row a task
    in_order = F.col("place").bitwiseAND(F.lit(1 << 31)) == 0
    owners = found.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min_by(F.when(in_order, F.col("place")), F.when(in_order, F.col("doc_id"))).alias("owner_place"))
    owners = stored(owners.filter("owner < last").select("key", "owner", F.shiftright("owner_place", 32).cast("int").alias("owner_at")), "chunks")
    # nothing after this join needs its partitioning, so the rows of a hot chunk can be split
    at = F.shiftright("place", 32).cast("int")
    again = found.join(owners, "key").filter("doc_id > owner").select("doc_id", "key", "owner", "owner_at", at.alias("at"), (at + F.shiftright("more", 8)).alias("to"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("words"), F.col("more").bitwiseAND(F.lit(255)).alias("inside"))
    again = stored(again, "repeats").withColumn("shift", F.col("at") - F.col("owner_at"))
    w = Window.partitionBy("doc_id").orderBy("at", "to", "key", "words")
    before, shift = F.lag("at").over(w), F.lag("shift").over(w)
    new = F.coalesce((F.lag("owner").over(w) != F.col("owner")) | (shift != F.col("shift")) | (F.col("at") > F.lag("to").over(w)), F.lit(True))
    repeated = F.coalesce((before == F.col("at")) & (shift == F.col("shift")), F.lit(False))
    again = again.withColumn("new", new.cast("int")).withColumn("once", (~repeated).cast("int")).withColumn("match", F.sum("new").over(w))
    matches = again.groupBy("doc_id", "match").agg(F.min("owner").alias("owner"), F.min("at").alias("start"), F.max("to").alias("stop"), F.min("owner_at").alias("other_start"), F.max(F.col("owner_at") + F.col("to") - F.col("at")).alias("other_stop"), F.min("words").alias("words"), F.max(F.col("words") + F.col("inside")).alias("stop_words"), F.sum("once").alias("n"))
    matches = stored(matches, "matches")
    # what is asked of a text: the ends of its own matches, and of those that others have with it
    own = matches.select("doc_id", "start", "stop", F.struct("match", "owner", "other_start", "other_stop", "words", "stop_words", "n").alias("own"))
    asked = matches.select(F.col("owner").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_stop").alias("stop")).distinct()
    wanted = own.unionByName(asked.withColumn("own", F.lit(None).cast(own.schema["own"].dataType)))
    raw, low = F.col("text").cast("binary"), F.greatest(F.col("start") - REACH - 1, F.lit(0))
    digest = F.unhex(F.md5(F.substring(raw, F.col("start") + 1, F.col("stop") - F.col("start"))))
    ends = slim.join(wanted, "doc_id").select("doc_id", "start", "stop", "own", digest.alias("digest"), F.substring(raw, low + 1, F.col("start") - low + 4).alias("left"), F.substring(raw, F.col("stop") - 3, F.lit(4 + REACH + 1)).alias("right"))
    ends = stored(ends, "ends")
    mine = ends.filter("own is not null").select("doc_id", "start", "stop", "digest", "left", "right", "own.*")
    others = ends.filter("own is null").select(*(F.col(a).alias(b) for a, b in (("doc_id", "owner"), ("start", "other_start"), ("stop", "other_stop"), ("digest", "digest"), ("left", "other_left"), ("right", "other_right"))))
    pairs = mine.join(others, ["owner", "other_start", "other_stop", "digest"])
    given = ["start", "stop", "words", "stop_words", "left", "right", "other_start", "other_left", "other_right"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [widen(*r) for r in zip(*(pdf[c].tolist() for c in given), strict=True)]
            yield pdf[["doc_id", "match", "owner", "n"]].join(pd.DataFrame(got, columns=["start", "stop", "w0", "w1"], index=pdf.index, dtype="int64"))

    spans = pairs.select("doc_id", "match", "owner", "n", *given).mapInPandas(run, "doc_id long, match long, owner long, n long, start int, stop int, w0 int, w1 int")
    # where unlike texts have one doc_id a match can have several ends: the widest count
    spans = spans.groupBy("doc_id", "match").agg(F.min("owner").alias("owner"), F.min("n").alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("w0").alias("w0"), F.max("w1").alias("w1"))
    by = Window.partitionBy("doc_id").orderBy("start", "stop", "match")
    far = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("apart", F.coalesce(F.col("start") > far, F.lit(True)).cast("int")).withColumn("run", F.sum("apart").over(by))
    out = spans.groupBy("doc_id", "run").agg(F.min("owner").alias("first_doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n_chunks"), (F.max("w1") - F.min("w0")).cast("long").alias("n_words"))
    out = out.withColumn("n_bytes", (F.col("stop") - F.col("start")).cast("long")).filter(F.col("n_bytes") >= least_bytes)
    return out.select("doc_id", "first_doc_id", "start", "stop", "n_chunks", "n_bytes", "n_words")


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the repeated passages cut out of their texts; the first of each stays."""
    name, cut_out = apart(docs) + "id", apart(docs) + "spans"
    spans = passages.groupBy(F.col("doc_id").alias(name)).agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("a"), F.col("stop").alias("b")))).alias(cut_out))
    rows = docs.join(spans, F.col(id_col) == F.col(name), "left")
    raw, s = F.col(text_col).cast("binary"), F.col(cut_out)
    gaps = F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["b"]).alias("a"), F.coalesce(F.get(s, i)["a"], F.octet_length(text_col)).alias("b")))
    kept = F.array_join(F.transform(gaps, lambda g: F.substring(raw, g["a"] + 1, g["b"] - g["a"]).cast("string")), "")
    return rows.withColumn(text_col, F.when(s.isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
