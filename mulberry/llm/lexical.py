"""Ranked lexical search over a tiered index: high-impact postings first, a bound on what is left of each term, lower tiers only for items that lack a proof.

A posting is a term in a document; its impact is the part of the score that
does not depend on the item asked.  Tier after tier holds the postings of a
term from its highest impacts on, ``FIRST`` of them and ``GROWTH`` times as
many at each further tier; every tier also holds those of the tiers above, so
one is read alone.  With each tier goes, per term, the highest impact left
below it.  A document that has no posting in a tier can't score more than the
sum of those residual bounds over the item's terms.  Where the k-th best
partial sum is above that, the item is settled in this tier: documents whose
partial sum and residual bounds reach the k-th best are scored on their whole
postings.  All other items fall through to the next tier; the last one holds
everything, so its sums are exact.

The index is held by document, so a task sums up the documents it reads
without a shuffle and passes on k rows an item.  Of the terms nobody asks for
only the number is kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.llm.common import cut, stored, table

#: Postings of a term in the first tier at most, and how many times more the next one may hold.
FIRST, GROWTH = 1024, 16
#: Width of a step of impacts (they are below 10^6): tiers end at such steps.
STEP = 4096
#: Terms of items to a chunk, about: items are asked a chunk at a time.  Items multiplied at once, documents multiplied at once.
CHUNK_TERMS, ITEM_BLOCK, DOC_BLOCK = 200_000, 256, 1024
#: Bytes of a text that are taken apart at once.
WINDOW = 1 << 20

#: Bytes of terms as they are, A-Z lower-cased, all others a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """How often each term is in a text (UTF-8); none for null."""
    counts: Counter = Counter()
    folded = (text or b"").translate(_FOLD)
    at = 0
    while at < len(folded):
        end = at + WINDOW
        if end < len(folded):
            end = folded.find(b" ", end)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term, n); of rows of one identifier the one of the least text counts."""
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("t")).filter("item is not null").groupBy("item").agg(F.min("t").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = term_counts(raw)
                yield pa.record_batch([pa.array([item] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["item", "term", "n"])

    return rows.mapInArrow(run, "item long, term binary, n long")


class Asked:
    """A chunk of items: their identifiers, the terms asked for, and which item asks for which term how often."""

    def __init__(self, rows: list) -> None:
        self.items = sorted({r["item"] for r in rows})
        self.terms = sorted({bytes(r["term"]) for r in rows})
        item_at, term_at = {x: i for i, x in enumerate(self.items)}, {x: i for i, x in enumerate(self.terms)}
        self.item_of = np.array([item_at[r["item"]] for r in rows], np.int64)
        self.term_of = np.array([term_at[bytes(r["term"])] for r in rows], np.int64)
        self.times = np.array([r["n"] for r in rows], np.int64)


def count_terms(docs: DataFrame, terms: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n, terms, tfs) of documents with a term at all: number of terms, and place and count of those asked for; row names the row."""
    sent = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, row = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = term_counts(raw.as_py())
                row += 1
                if counts:
                    found = [(place[t], c) for t, c in counts.items() if t in place]
                    rows.append((row, doc, counts.total(), [f[0] for f in found], [f[1] for f in found]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["row", "doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(run, "row long, doc_id long, n long, terms array<int>, tfs array<long>")


def impact(tf, n, docs: int, length: int):
    """Columns or arrays of integers: what a posting adds to a score, but for the term's weight."""
    m = 25 + (75 * n * docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _flat(batch: pa.RecordBatch, terms: int, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two lists side by side: the batch's row of each element, the elements."""
    sizes = batch.column(terms).value_lengths().to_numpy(zero_copy_only=False)
    flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (terms, values)]
    return np.repeat(np.arange(len(sizes)), sizes), flat[0], flat[1]


def tiers(counted: DataFrame, docs: int, length: int, first: int = FIRST, growth: int = GROWTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, df, least step of each tier, residual bound of each tier) of the terms that have postings; the last tier holds all.

    A tier of a term ends where one more step of impacts would exceed its
    number of postings, so a step that many documents share stays whole.
    """
    m = F.lit(25) + F.expr(f"(75L * n * {docs}L) div {length}L")
    posts = counted.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("m", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    posts = posts.select("term", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("c"))
    steps = posts.groupBy("term", F.expr(f"c div {STEP}").alias("step")).agg(F.count("*").alias("n"), F.max("c").alias("top"))
    down = Window.partitionBy("term").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("upto", F.sum("n").over(down))
    most = steps.agg(F.max("upto")).first()[0] or 0
    sizes = [first]
    while sizes[-1] < most:
        sizes.append(sizes[-1] * growth)
    aggs = [F.sum("n").alias("df")]
    for j, size in enumerate(sizes):
        kept = F.col("upto") <= size
        aggs += [F.min(F.when(kept, F.col("step"))).alias(f"s{j}"), F.max(F.when(~kept, F.col("top"))).alias(f"r{j}")]
    rows = steps.groupBy("term").agg(*aggs).collect()
    none = 1_000_000 // STEP + 1
    least = np.array([[none if r[f"s{j}"] is None else r[f"s{j}"] for j in range(len(sizes))] for r in rows], np.int64).reshape(-1, len(sizes))
    left = np.array([[r[f"r{j}"] or 0 for j in range(len(sizes))] for r in rows], np.int64).reshape(-1, len(sizes))
    return np.array([r["term"] for r in rows], np.int64), np.array([r["df"] for r in rows], np.int64), least, left


def _write_tiers(counted: DataFrame, docs: int, length: int, place: np.ndarray, least: np.ndarray, terms: int) -> DataFrame:
    """(tier, row, doc_id, terms, impacts): the postings of each tier but the last, those of the tiers above included, by document."""
    edge = np.full((terms, least.shape[1]), 1 << 40)
    edge[place] = least
    sent = counted.sparkSession.sparkContext.broadcast(edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = sent.value
        for batch in batches:
            at, term, tf = _flat(batch, 3, 4)
            c = impact(tf, batch.column(2).to_numpy()[at], docs, length)
            for tier in range(edge.shape[1] - 1):
                kept = c // STEP >= edge[term, tier]
                size = np.bincount(at[kept], minlength=batch.num_rows)
                has = np.flatnonzero(size)
                ends = pa.array(np.concatenate([[0], np.cumsum(size[has])]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[kept].astype(np.int32))) for x in (term, c)]
                yield pa.record_batch([pa.array(np.full(len(has), tier), pa.int32()), batch.column(0).take(pa.array(has)), batch.column(1).take(pa.array(has)), *lists], ["tier", "row", "doc_id", "terms", "impacts"])

    return stored(counted.mapInArrow(run, "tier int, row long, doc_id long, terms array<int>, impacts array<int>"), "lexical-tiers", by="tier")


class _Blocks:
    """Weights of a chunk's open items as matrices, a block of items at a time."""

    def __init__(self, asked: Asked, weight: np.ndarray, left: np.ndarray, open_items: np.ndarray) -> None:
        self.parts = []
        for b in range(0, len(open_items), ITEM_BLOCK):
            items = open_items[b : b + ITEM_BLOCK]
            mine = np.isin(asked.item_of, items)
            terms = np.unique(asked.term_of[mine])
            w = np.zeros((len(terms), len(items)), np.int64)
            np.add.at(w, (np.searchsorted(terms, asked.term_of[mine]), np.searchsorted(items, asked.item_of[mine])), asked.times[mine] * weight[asked.term_of[mine]])
            r = w * left[terms][:, None]
            exact = float(w.astype(float).sum(0).max(initial=0)) * 1e6 < 2.0**53
            self.parts.append((items, terms, w.astype(float) if exact else w, r.astype(float) if exact else r, r.sum(0)))

    def bounds(self) -> np.ndarray:
        """Of each open item the most that a document without a posting in the tier can score."""
        return np.concatenate([p[4] for p in self.parts])


def _products(batch: pa.RecordBatch, part: tuple, lists: tuple, residual: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(first row, partial sums, residual bounds) of blocks of documents with the items of a block."""
    _, terms, w, r, total = part
    at, term, c = lists
    col = np.searchsorted(terms, term)
    known = (col < len(terms)) & (terms[np.minimum(col, len(terms) - 1)] == term) if len(terms) else np.zeros(len(term), bool)
    at, col, c = at[known], col[known], c[known]
    starts = np.searchsorted(at, np.arange(0, batch.num_rows + DOC_BLOCK, DOC_BLOCK))
    for i, b in enumerate(range(0, batch.num_rows, DOC_BLOCK)):
        a, e = starts[i], starts[i + 1]
        if a == e:
            continue
        used, own = np.unique(col[a:e], return_inverse=True)
        x = np.zeros((min(DOC_BLOCK, batch.num_rows - b), len(used)), w.dtype)
        x[at[a:e] - b, own] = c[a:e]
        rest = total - (x > 0).astype(w.dtype) @ r[used] if residual else None
        yield b, (x @ w[used]).astype(np.int64), None if rest is None else rest.astype(np.int64)


def _impacts(batch: pa.RecordBatch, docs: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and impact of each posting of a batch of a tier, or of the whole counts."""
    if batch.schema.names[-1] == "impacts":
        return _flat(batch, 2, 3)
    at, term, tf = _flat(batch, 3, 4)
    return at, term, impact(tf, batch.column(2).to_numpy()[at], docs, length)


def _partial_tops(level: DataFrame, blocks: _Blocks, k: int, docs: int, length: int) -> DataFrame:
    """(item, row, doc_id, score): the k best partial sums of each open item among the documents of a task, above 0."""
    sent = level.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value.parts
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            lists, ids, rows = _impacts(batch, docs, length), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for part in parts:
                edge = np.array([best[i][-1, 2] if i in best and len(best[i]) == k else 1 for i in part[0]])
                for b, s, _ in _products(batch, part, lists):
                    at, j = np.nonzero(s >= edge)
                    order = np.lexsort((ids[at + b], -s[at, j], j))
                    at, j = at[order], j[order]
                    start = np.searchsorted(j, np.arange(len(part[0]) + 1))
                    for x in np.flatnonzero(np.diff(start)):
                        mine = at[start[x] : min(start[x] + k, start[x + 1])]
                        new = np.column_stack([rows[mine + b], ids[mine + b], s[mine, x]])
                        item = int(part[0][x])
                        if item in best:
                            new = np.concatenate([best[item], new])
                            new = new[np.lexsort((new[:, 0], new[:, 1], -new[:, 2]))][:k]
                        best[item] = new
                        if len(new) == k:
                            edge[x] = new[-1, 2]
        for item, found in best.items():
            yield pa.record_batch([pa.array(np.full(len(found), item)), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(3))], ["item", "row", "doc_id", "score"])

    return level.mapInArrow(run, "item long, row long, doc_id long, score long")


def _candidates(level: DataFrame, blocks: _Blocks, least: dict[int, int], docs: int, length: int) -> DataFrame:
    """(item, row): documents of a tier whose partial sum and residual bounds reach an item's k-th best partial sum."""
    sent = level.sparkSession.sparkContext.broadcast((blocks, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, least = sent.value
        for batch in batches:
            lists, rows = _impacts(batch, docs, length), batch.column(0).to_numpy()
            for part in blocks.parts:
                edge = np.array([least[int(i)] for i in part[0]])
                for b, s, rest in _products(batch, part, lists, True):
                    at, j = np.nonzero((s > 0) & (s + rest >= edge))
                    yield pa.record_batch([pa.array(part[0][j]), pa.array(rows[at + b])], ["item", "row"])

    return level.mapInArrow(run, "item long, row long")


def _whole_scores(found: DataFrame, asked: Asked, weight: np.ndarray, docs: int, length: int) -> DataFrame:
    """(item, row, doc_id, score) of documents (row, doc_id, n, terms, tfs) with the items of their column ``items``."""
    each: dict[int, dict[int, int]] = {}
    for i, t, n in zip(asked.item_of.tolist(), asked.term_of.tolist(), asked.times.tolist(), strict=True):
        each.setdefault(i, {})[t] = n * int(weight[t])
    sent = found.sparkSession.sparkContext.broadcast(each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc, n, terms, tfs, items in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                own = {t: impact(tf, n, docs, length) for t, tf in zip(terms, tfs, strict=True)}
                for i in items:
                    out.append((i, row, doc, sum(w * own[t] for t, w in sent.value[i].items() if t in own)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in cols], ["item", "row", "doc_id", "score"])

    return found.select("row", "doc_id", "n", "terms", "tfs", "items").mapInArrow(run, "item long, row long, doc_id long, score long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "row")))
    return ranked.filter(F.col("rank") <= k)


def _search_chunk(docs: DataFrame, asked: Asked, k: int, doc_id: str, text: str, first: int, growth: int) -> DataFrame | None:
    counted = stored(count_terms(docs, asked.terms, doc_id, text), "lexical-counts")
    n_docs, length = counted.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    place, df, least, left = tiers(counted, n_docs, length, first, growth)
    if not len(place):
        return None
    weight = np.zeros(len(asked.terms), np.int64)
    weight[place] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
    named = counted.filter("doc_id is not null")
    levels, last = None, least.shape[1] - 1
    if last:
        levels = _write_tiers(named, n_docs, length, place, least, len(asked.terms))
    results, open_items = [], np.arange(len(asked.items))
    for tier in range(last + 1):
        residual = np.zeros(len(asked.terms), np.int64)
        residual[place] = left[:, tier]
        blocks = _Blocks(asked, weight, residual, open_items)
        level = named if tier == last else levels.filter(F.col("tier") == tier).select("row", "doc_id", "terms", "impacts")
        tops = cut(_best(_partial_tops(level, blocks, k, n_docs, length), k))
        kth = {r["item"]: r["score"] for r in tops.filter(F.col("rank") == k).select("item", "score").collect()}
        bound = dict(zip(open_items.tolist(), blocks.bounds().tolist(), strict=True))
        whole = [i for i in bound if bound[i] == 0]
        proved = [i for i in bound if 0 < bound[i] < kth.get(i, 0)]
        spark = docs.sparkSession
        if whole:
            results.append(tops.join(F.broadcast(spark.createDataFrame([(i,) for i in whole], "item long")), "item").select("item", "doc_id", "score", "rank"))
        if proved:
            near = cut(_candidates(level, _Blocks(asked, weight, residual, np.array(proved)), {i: kth[i] for i in proved}, n_docs, length))
            found = named.join(near.groupBy("row").agg(F.collect_set("item").alias("items")), "row")
            results.append(_best(_whole_scores(found, asked, weight, n_docs, length), k).select("item", "doc_id", "score", "rank"))
        open_items = np.array(sorted(set(bound) - set(whole) - set(proved)), np.int64)
        if not len(open_items):
            break
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    names = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(asked.items)], "item long, item_id long")
    return out.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item, ties by ascending doc_id.

    Terms are runs of ASCII letters and digits and of all other characters
    beyond ASCII, A-Z lower-cased.  Null and empty texts have none; items
    without terms have no rows.  Of items of one item_id that of the least text
    counts, items without item_id are left out.  Documents without doc_id count
    in N, L and df but can't be returned; rows that repeat a doc_id are
    documents of their own.  All other columns are left alone.
    """
    spark = docs.sparkSession
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    terms = cut(_item_terms(items, item_id, item_text))
    chunks = 1 + terms.count() // CHUNK_TERMS
    out = none
    for c in range(chunks):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c).collect()
        found = _search_chunk(docs, Asked(rows), k, doc_id, text, first, growth) if rows else None
        if found is not None:
            out = found if out is none else out.unionByName(found)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), g AS (
  SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(ts)) AS BIGINT) AS l_all FROM d WHERE len(ts) > 0
), p AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM d) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_all + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g
), q AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_all) // l_all))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY item_id, r
), k AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
