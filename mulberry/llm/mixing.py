"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is counted in blocks of equal numbers of words.  The blocks go to the
sources by highest quotients (target / (2k - 1)); each source's blocks go the
same way to its shards, which gives every shard an integer quota; in each shard
a seeded run of blocks is selected from its documents in seeded order.

Only DataFrame functions run here: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mulberry.llm.common import WORD, apart, cut, table, word_count
from mulberry.operators.reports import ranked

#: Hash cells a source is cut into, so shards of a source are never more; rows of a shard that are aimed at.
#: A source of 10^9 rows has shards of about 244,000 rows, which are the most that one task sorts.
CELLS, SHARD_ROWS = 4096, 64


def sainte_lague(df: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Add ``quota``: the seats of each row, by highest quotients within its group.

    ``seats`` is the same in all rows of a group.  Ties go to the row that
    comes first by ``order``, which must tell the rows of a group apart.
    Rounding at a divisor that can't give too many seats leaves at most two
    seats a row open, so only those are ranked.
    """
    w = Window.partitionBy(*group)
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    d = df.withColumn("_all", F.sum(v).over(w)).withColumn("_n", F.count("*").over(w))
    share = F.when(F.col("_all") > 0, v / F.col("_all")).otherwise(0.0)
    low = F.greatest(F.floor(share * (s - F.col("_n") / 2) + 0.5) - 1, F.lit(0))
    d = d.withColumn("_low", F.when(share > 0, low).otherwise(0).cast("long")).withColumn("_high", F.when((share > 0) & (s > 0), F.floor(share * (s + F.col("_n") / 2) + 0.5) + 1).otherwise(0).cast("long"))
    d = d.withColumn("_open", F.col(seats) - F.sum("_low").over(w))
    keys = [*group, *order]
    ranked = d.filter("_high > _low").select(*keys, "_open", v.alias("_v"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col("_v") / (2 * F.col("_k") - 1)), *order, "_k"))
    won = ranked.withColumn("_rank", best).filter("_rank <= _open").groupBy(*keys).agg(F.count("*").alias("_won"))
    return d.join(won, keys, "left").withColumn("quota", F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).drop("_all", "_n", "_low", "_high", "_open", "_won")


def sainte_lague_over_all(df: DataFrame, votes: str, seats: int, order: list[str]) -> DataFrame:
    """Add ``quota`` as :func:`sainte_lague` does with all rows as one group, however many: no task sees them all."""
    v = F.col(votes).cast("double")
    # decimals add up alike in any order
    n, votes_of_all = df.agg(F.count("*"), F.sum(v.cast("decimal(38,6)")).cast("double")).first()
    if not n or not votes_of_all or not seats:
        return df.withColumn("quota", F.lit(0).cast("long"))
    share = v / votes_of_all
    low = F.when(v > 0, F.greatest(F.floor(share * (seats - n / 2) + 0.5) - 1, F.lit(0))).otherwise(0).cast("long")
    high = F.when(v > 0, F.floor(share * (seats + n / 2) + 0.5) + 1).otherwise(0).cast("long")
    d = cut(df.withColumn("_low", low).withColumn("_high", high))
    left = seats - d.agg(F.sum("_low")).first()[0]
    asked = d.filter("_high > _low").select(*order, v.alias("_v"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    places = ranked(asked, [F.desc(F.col("_v") / (2 * F.col("_k") - 1)), *map(F.col, order), F.col("_k")], "_rank")
    won = places.filter(F.col("_rank") <= left).groupBy(*order).agg(F.count("*").alias("_won"))
    return d.join(won, order, "left").withColumn("quota", F.col("_low") + F.coalesce(F.col("_won"), F.lit(0))).drop("_low", "_high", "_won")


def targets(sources: DataFrame, weights: list[int], share: float, most: float) -> tuple[DataFrame, float]:
    """Add ``source_no`` and ``target`` to (source, source_size); and the words of the whole mix.

    The targets share ``share`` times all sizes by weight, and stop at ``most``
    times the own size; the excess is shared anew by weight until none is
    above.  A round is one sum over all sources, and rounds end when no more
    sources are full; no task sees all sources.
    """
    s = ranked(sources, [F.asc_nulls_last("source")], "source_no")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = cut(s.withColumn("cap", most * F.col("source_size").cast("double")))
    n, size, weight, caps = s.agg(F.count("*"), F.sum("source_size"), F.sum("weight"), F.sum("cap")).first()
    # caps may round, shares may not: the mix is what can be taken at all
    total = min(share * float(size or 0), float(caps or 0))
    full, full_caps, full_weight, level = -1, 0.0, 0.0, 0.0
    while n:
        level = (total - full_caps) / (weight - full_weight) if weight > full_weight else float("inf")
        now, caps, heavy = s.filter(F.col("cap") <= F.col("weight") * level).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if now <= full or not now:
            break
        full, full_caps, full_weight = now, caps, heavy
    return s.withColumn("target", F.least("cap", F.col("weight") * level)).select(*sources.columns, "source_no", "target"), total


def mix(docs: DataFrame, weights: list[int] | None = None, share: float = 1.5, most: float = 2.0, block: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digest: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, and how ``taken`` comes about.

    taken = copies * size + the words [from1, to1) and [from2, to2) of the
    document.  Null texts have size 0 and null sources are a source of their
    own, the last.  Repeated rows are documents of their own.  The selection
    depends on seed, identifiers and sizes only, so reruns agree.  A mix of no
    words takes none.  With ``digest`` the plan has that of each text as well,
    which tells documents of one identifier, source and size apart.
    """
    weights = weights or [5, 2, 1]
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit("place"))
    more = ["digest"] if digest else []
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *(F.md5(F.col(text_col).cast("binary")).alias(c) for c in more)).withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(CELLS)).cast("int"))
    slim = cut(slim)
    cells = slim.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"), F.count("*").alias("cell_rows"))
    cells = cut(cells)
    sources, total = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"), F.sum("cell_rows").alias("source_rows")), weights, share, most)
    sources = sources.withColumn("shards", F.least(F.lit(CELLS), F.ceil(F.col("source_rows") / SHARD_ROWS)).cast("int"))
    sources = cut(sainte_lague_over_all(sources, "target", round(total / block), ["source_no"]).withColumnRenamed("quota", "source_blocks"))
    sources = sources.withColumnRenamed("source", "_source")
    cells = cells.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.pmod(F.col("cell"), F.col("shards")))
    shards = cells.groupBy("source_no", "shard", "source_blocks").agg(F.sum("cell_size").alias("shard_size"))
    shards = sainte_lague(shards, ["source_no"], "shard_size", "source_blocks", ["shard"]).select("source_no", "shard", "shard_size", "quota")
    plan = cut(cells.join(shards, ["source_no", "shard"]).select(F.col("source").alias("_source"), F.col("cell").alias("_cell"), "source_no", "source_size", "target", "shard", "shard_size", "quota"))
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell"))).drop("_source", "_cell")
    end = F.sum("size").over(Window.partitionBy("source_no", "shard").orderBy(key, "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    words = F.least(F.col("quota") * block, F.floor(most * F.col("shard_size")))
    rows = rows.withColumn("copies", F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("run", (words - F.col("copies") * F.col("shard_size")).cast("long"))
    rows = rows.withColumn("first", F.when(F.col("shard_size") > 0, F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), F.ceil(F.col("shard_size") / block)) * block).otherwise(0).cast("long"))

    def within(at: Column) -> Column:
        return F.greatest(F.lit(0), F.least(at - F.col("start"), F.col("size"))).cast("long")

    first, last = F.col("first"), F.col("first") + F.col("run")
    rows = rows.withColumns({"from1": within(first), "to1": within(last), "from2": within(first - F.col("shard_size")), "to2": within(last - F.col("shard_size"))})
    taken = F.col("copies") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    return rows.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), "copies", "from1", "to1", "from2", "to2", *more)


def mixed_rows(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows with the columns of ``docs``: whole copies, and the words taken of a document besides them with the white space before each.

    The identifiers, sources and sizes in ``docs`` are those ``plan`` was made
    of; of rows repeated with the same three, each gets its share once.  Where
    their texts can differ, the plan must have their digests.
    """
    cols, own = docs.columns, apart(docs)
    digest = F.md5(F.col(text_col).cast("binary")) if "digest" in plan.columns else F.lit("")
    keys = {own + k: c for k, c in (("id", F.col(id_col)), ("source", F.col(source_col)), ("size", word_count(F.col(text_col))), ("digest", digest))}
    asked = plan.withColumn("digest", F.col("digest") if "digest" in plan.columns else F.lit(""))
    # spans that repeat are one with their number: a row repeated often has few different ones
    spans = asked.groupBy("doc_id", "source", "size", "digest", "from1", "to1", "from2", "to2").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    planned = spans.groupBy(*(F.col(c).alias(own + "p" + c) for c in ("doc_id", "source", "size", "digest"))).agg(F.sum("copies").alias(own + "c"), F.sum("n").alias(own + "m"), F.collect_list(F.struct("from1", "to1", "from2", "to2", "n")).alias(own + "p"))
    parts = F.flatten(F.transform(own + "p", lambda p: F.flatten(F.array_repeat(F.array(F.struct(p["from1"].alias("a"), p["to1"].alias("b")), F.struct(p["from2"].alias("a"), p["to2"].alias("b"))), p["n"].cast("int")))))
    planned = planned.withColumn(own + "p", F.filter(parts, lambda p: p["b"] > p["a"])).filter((F.col(own + "c") > 0) | (F.size(own + "p") > 0))
    same = [F.col(k).eqNullSafe(F.col(own + "p" + c)) for k, c in zip(keys, ("doc_id", "source", "size", "digest"), strict=True)]
    rows = docs.withColumns(keys).join(planned, same[0] & same[1] & (F.col(own + "size") == F.col(own + "psize")) & same[3])
    rows = rows.filter(F.col(own + "m") == 1).unionByName(rows.filter(F.col(own + "m") > 1).dropDuplicates(list(keys)))
    whole = F.struct(F.lit(0).cast("long").alias("a"), F.col(own + "size").alias("b"))
    rows = rows.withColumn(own + "p", F.explode(F.concat(F.array_repeat(whole, F.col(own + "c").cast("int")), F.col(own + "p"))))
    tokens = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    a, b = F.col(own + "p")["a"], F.col(own + "p")["b"]
    piece = F.array_join(F.slice(tokens, (a + 1).cast("int"), (b - a).cast("int")), "")
    rows = rows.withColumn(text_col, F.when(b - a == F.col(own + "size"), F.col(text_col)).otherwise(piece))
    if "n_chars" in cols and text_col != "n_chars":
        rows = rows.withColumn("n_chars", F.length(text_col).cast(T.LongType()))
    return rows.select(*cols)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
