"""Near-duplicates by SetSketch registers: band, estimate jointly by likelihood, verify on the full sets.

1.  Each document becomes the set of 64-bit hashes of its distinct word
    shingles, a digest of that set, and SetSketch registers.
2.  Documents of equal sets are one class; classes are represented by their
    least identifier.  Copies are never paired.
3.  Register values are banded.  In each bucket every class is compared with
    one leader only, so a bucket of n classes makes n - 1 pairs.  The leader is
    the class that meets most others in all its buckets: of a family of near
    copies the one in the middle, to which most others are linked.
4.  Pairs are estimated from their registers; what is clearly apart goes, the
    rest is confirmed on the full sets.
5.  Components of the links.  Buckets that still hold several components may
    hide links between those.  There each class becomes the difference of its
    set from its leader's, and a prefix filter over the differences, rarest
    elements first, finds the pairs that can be similar at all: members of a
    family of near copies differ from each other in what is rare among them.
    So a link is lost only where the two sets share no band, and a family of
    classes just below the threshold is not compared pair by pair.

40 bands of 5 of 200 registers miss a pair of similarity 0.8 with a
probability below 1e-6 and one of 0.9 below 1e-15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.llm import setsketch
from mulberry.llm.common import cut, table
from mulberry.llm.components import connected_components

#: Words whose hashes a task keeps; beyond it starts afresh.
KEPT_WORDS = 100_000
BANDS, ROWS = 40, 5
#: Identifiers of documents whose sets are wanted that are broadcast at most (8 bytes each); beyond, texts are shuffled to them.
BROADCAST_IDS = 500_000
#: Standard errors by which an estimate must miss the threshold for a pair to be dropped without verification.
SIGMAS = 5.0


class Shingler:
    """Texts to sorted arrays of the distinct 64-bit hashes of their shingles of ``width`` words."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only, as the contract asks
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        out = np.empty(len(found), np.uint64)
        for i, w in enumerate(found):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        return out

    def shingles(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        k = min(self.width, len(w))
        n = len(w) - k + 1
        h = np.full(n, np.uint64(k))
        for i in range(k):
            h = setsketch.mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
        return np.unique(h)


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, regs): regs are the registers, two bytes each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                s = shingler.shingles(text)
                d = xxhash.xxh3_128_digest(s.tobytes())
                out.append((len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), setsketch.registers(s, bands * rows).astype(">u2").tobytes()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"]}).join(pd.DataFrame(out, columns=["n_shingles", "set_hi", "set_lo", "regs"], index=pdf.index))

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "doc_id long, n_shingles long, set_hi long, set_lo long, regs binary")


def shingle_sets(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, set_hi, set): the full sets as sorted arrays, and the first half of their digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(width)
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                sets = [shingler.shingles(t) for t in part["text"]]
                digests = [int.from_bytes(xxhash.xxh3_128_digest(x.tobytes())[:8], "big", signed=True) for x in sets]
                yield pd.DataFrame({"id": part["doc_id"].to_numpy(), "set_hi": digests, "set": [x.view(np.int64) for x in sets]})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, set_hi long, set array<long>")


def _estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b with registers and sizes) whose estimate doesn't exclude the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = (np.frombuffer(b"".join(pdf[c]), ">u2").reshape(len(pdf), -1).astype(np.int32) for c in ("ra", "rb"))
            above, below = (x > y).sum(1), (x < y).sum(1)
            m = x.shape[1]
            j = setsketch.jaccard(above, below, m - above - below, pdf["na"].to_numpy(), pdf["nb"].to_numpy())
            yield pdf.loc[j >= threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) / m), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _sets_of(ids: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str, known: DataFrame | None = None) -> DataFrame:
    """The full sets (id, set) of the documents in ``ids`` (column _id), those in ``known`` from there.

    Of unlike texts under one identifier that of the greatest digest counts, as everywhere here.
    """
    ids = cut(ids.distinct())
    missing = ids if known is None else cut(ids.join(known.select(F.col("id").alias("_id")), "_id", "left_anti"))
    wanted = F.broadcast(missing) if missing.count() <= BROADCAST_IDS else missing
    made = shingle_sets(docs.join(wanted, F.col(id_col).cast("long") == F.col("_id"), "left_semi"), width, id_col, text_col)
    made = made.groupBy("id").agg(F.max_by("set", "set_hi").alias("set"))
    if known is not None:
        made = made.unionByName(known.join(ids, F.col("id") == F.col("_id"), "left_semi"))
    return cut(made)


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, per_cent: int, id_col: str, text_col: str, sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes that are similar enough, confirmed on the full sets; and the sets, if they aren't given."""
    threshold = per_cent / 100
    side = classes.select("id", F.col("n_shingles").alias("n"), "regs")
    with_a = pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
    both = with_a.join(side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    near = cut(_estimated(both.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent), threshold))
    if sets is None:
        sets = _sets_of(near.select(F.col("a").alias("_id")).union(near.select(F.col("b").alias("_id"))), docs, width, id_col, text_col)
    full = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return cut(full.filter(100 * shared >= per_cent * (F.size("sa") + F.size("sb") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v"))), sets


def _across(led: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) of one leader and different components that can be similar enough.

    ``led`` has leader, id, component, ``sets`` the sets of all those.  With d the difference of a set from the
    leader's, |x ^ y| = |dx ^ dy|, and x and y are similar enough iff
    |x ^ y| <= k * (|x| + |y|) for k = (1 - t) / (1 + t).  So dx and dy must
    share (gx + gy) / 2 elements or more, where g = |d| - k * |set|.  In any
    one order of elements, the first shared one then stands among the first
    k * |set| + 1 of the side of the smaller g and the first
    (1 - t) / t * |set| + 1 of the other, and leaves room for the rest.  Where
    gx + gy <= 0 both are linked to the leader, thus in one component.
    """
    high, low = 100 + per_cent, 100 - per_cent
    both = led.join(sets, "id").join(sets.select(F.col("id").alias("leader"), F.col("set").alias("led_by")), "leader")
    apart = cut(both.select("leader", "id", "component", F.size("set").cast("long").alias("n"), F.concat(F.array_except("set", "led_by"), F.array_except("led_by", "set")).alias("d")))
    items = apart.select("leader", "id", F.explode("d").alias("e"))
    # elements of one class only are the first of all: they are counted, not kept
    often = items.groupBy("leader", "e").agg(F.count("*").alias("f")).filter("f > 1")
    ordered = items.join(often, ["leader", "e"]).groupBy("leader", "id").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("o"))
    ordered = ordered.join(apart.select("leader", "id", "component", "n", F.size("d").cast("long").alias("nd")), ["leader", "id"])
    placed = ordered.select("leader", "id", "component", "n", "nd", F.size("o").alias("size"), F.posexplode("o").alias("i", "fe"))
    at = (F.col("nd") - F.col("size") + F.col("i")).cast("long")  # elements before this one
    placed = placed.select("leader", F.col("fe.e").alias("e"), "id", "component", "n", (high * F.col("nd") - low * F.col("n")).alias("g"), (F.col("nd") - at).alias("room"), at.alias("at"))
    placed = cut(placed.filter(F.col("at") * per_cent <= F.col("n") * low))

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select("leader", "e", *[F.col(c).alias(c + suffix) for c in ("id", "component", "n", "g", "room")])

    x, y = side(placed.filter(F.col("at") * high <= F.col("n") * low), "x"), side(placed, "y")
    first = (F.col("gx") < F.col("gy")) | ((F.col("gx") == F.col("gy")) & (F.col("idx") < F.col("idy")))
    room = 2 * high * F.least("roomx", "roomy") >= F.col("gx") + F.col("gy")
    sizes = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * per_cent
    same_key = [x["leader"] == y["leader"], x["e"] == y["e"]]
    found = x.join(y, [*same_key, first, room, sizes, F.col("componentx") != F.col("componenty")])
    return found.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when their shingle sets have a similarity of
    ``per_cent`` / 100 or more; component_id is the least doc_id reachable.
    Texts of fewer words than ``width`` have their whole sequence as one
    shingle; null and blank texts have none and are linked with nothing.  Rows
    repeated under one doc_id are one document; of unlike texts under one, that
    of the greatest digest of its set is linked, whichever order they come in.
    Rows without a doc_id can't be named: they come out with a null component
    and are kept.  Other columns are not read.
    """
    docs, id_col, text_col = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text"
    every = cut(sketches(docs, width, id_col, text_col, bands, rows))
    own = every.filter("doc_id is not null")
    unlike = cut(own.groupBy("doc_id").agg(F.min("set_hi").alias("_lo"), F.max("set_hi").alias("_hi")).filter("_lo < _hi").select("doc_id", "_hi"))
    one = own if unlike.isEmpty() else own.join(unlike, "doc_id", "left").filter("_hi is null or set_hi = _hi").drop("_hi")
    classes = cut(one.filter("n_shingles > 0").groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("regs").alias("regs")))
    size = 2 * rows
    band = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + i * size, size)) for i in range(bands)])).alias("band")
    banded = classes.select("id", band)
    shared = cut(banded.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).filter("least < most"))
    members = cut(banded.join(shared.select("band", "n"), "band"))
    central = members.groupBy("id").agg(F.sum("n").alias("c"))
    members = cut(members.join(central, "id").select("band", "id", "c"))
    leaders = cut(members.groupBy("band").agg(F.max(F.struct("c", (-F.col("id")).alias("minus"))).alias("top")).select("band", (-F.col("top.minus")).alias("leader")))
    members = cut(members.select("band", "id").join(leaders, "band"))
    pairs = members.filter("id <> leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()
    links, sets = _links(pairs, classes, docs, width, per_cent, id_col, text_col)
    comps = cut(connected_components(links))
    # buckets that hold several components: compare across those
    placed = cut(members.join(comps, F.col("id") == F.col("vertex"), "left").select("band", "id", "leader", F.coalesce("component", "id").alias("component")))
    split = cut(placed.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n")).filter("c0 < c1 and n > 2").select("band"))
    led = cut(placed.join(split, "band").filter("id <> leader").select("leader", "id", "component").distinct())
    sets = _sets_of(led.select(F.col("id").alias("_id")).union(led.select(F.col("leader").alias("_id"))), docs, width, id_col, text_col, sets)
    more, _ = _links(_across(led, sets, per_cent), classes, docs, width, per_cent, id_col, text_col, sets)
    # the components so far stand for their links
    stars = comps.select(F.col("vertex").alias("u"), F.col("component").alias("v"))
    comps = cut(connected_components(stars.unionByName(more)))
    ids = one.select("doc_id", "set_hi", "set_lo").distinct() if not unlike.isEmpty() else one
    named = ids.join(classes.select("set_hi", "set_lo", "id"), ["set_hi", "set_lo"], "left").join(comps, F.col("id") == F.col("vertex"), "left")
    component = F.coalesce("component", "id", "doc_id")
    named = named.select("doc_id", *(["n_shingles"] if unlike.isEmpty() else []), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    if not unlike.isEmpty():  # the rows of one identifier share its component
        named = own.select("doc_id", "n_shingles").join(named, "doc_id")
    nameless = every.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return named.select("doc_id", "n_shingles", "component_id", "kept").unionByName(nameless)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's case: shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
