"""Exact deduplication by a stateful stream over disk-backed keyed state.

Arrivals (digest, byte length, stable identifier, content locator) stream
through a keyed aggregation whose state lives in RocksDB and never expires.
With a state folder of one's own a later run goes on from its checkpoint, so a
digest seen once is known for good; without one the state lives for the run.
The state holds no text: of each digest it keeps the identifier of the row
that stays, the file where that row's content is, and the number of rows.
Whenever a digest is hit more than once, the full bytes of its rows are
compared: those of this run, and of earlier ones what the locators name; rows
whose digests agree but whose bytes don't are told apart.

Only DataFrame functions run here: no Python on the executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mulberry.llm.common import apart, scratch, table

#: Largest number of repeated digests that is broadcast (40 bytes each), and of rows that go (80 bytes each); more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Rows from which a digest is hot: where repeated digests are joined by a shuffle, hot ones are still broadcast, as long as they are that few.
HOT_GROUP = 10_000
_ARRIVAL = "digest string, n_bytes long, id long, locator string, sha string"
_UPDATE = "digest string, n_bytes long, keep_id long, group_size long, locator string"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # stores are many and may be small: no space is set aside for their logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor share one bound of memory, however many partitions it has
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # a store takes an eighth of its buffer at the first row, 1 MB of the default
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    # stores of a run that is over are closed by the next maintenance
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


def known_state(spark: SparkSession, base: str) -> DataFrame:
    """The state of every digest that arrived so far: (digest, n_bytes, keep_id, group_size, locator).

    Identifiers and counts only grow, so the last state of a key is the maximum
    of its updates.
    """
    found = spark.read.schema(_UPDATE).parquet(f"{base}/updates")
    return found.groupBy("digest", "n_bytes").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max_by("locator", "group_size").alias("locator"))


def stream_state(spark: SparkSession, base: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Drain what has newly arrived below ``base``/arrivals in micro-batches into the state; the query, which is over then.

    Each micro-batch adds the changed keys to a table of updates, one folder a
    batch that a repeated batch overwrites.
    """
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/updates/batch={number}")

    try:
        query = (
            spark.readStream.schema(_ARRIVAL)
            .option("maxFilesPerTrigger", files_per_batch)
            .option("recursiveFileLookup", "true")
            .parquet(f"{base}/arrivals")
            .groupBy("digest", "n_bytes")
            .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.max_by("locator", "id").alias("locator"))
            .writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return query
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1000, digest_bits: int = 256, state_dir: str | None = None, run_id: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as the empty text.  Of
    equal texts the largest identifier stays.  Rows repeated with the same
    identifier and text are both reported, and both kept; a null identifier
    never stays while its group has another, and is kept only if its group has
    none.  Empty tables give empty results.  Other columns are not read.

    With ``state_dir``, a folder that all executors see, what arrived in
    earlier runs counts too: keep_id and group_size are of all arrivals so far.
    Earlier rows must then have come from Parquet files that still hold
    ``text_col``; only the files that hits name are read again.  A run that
    died and is started again with the same ``run_id`` and rows goes on where
    it stopped and counts no row twice; without one, every call is a run of its
    own.  Runs with one folder must follow each other.

    ``digest_bits`` below 256 shortens the digest used as key; collisions are
    then frequent and found by the comparison of bytes (for tests).
    """
    spark = docs.sparkSession
    base = state_dir or scratch(spark, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def digested(df: DataFrame) -> DataFrame:
        return df.withColumn("sha", F.sha2("text", 256)).withColumn("digest", F.substring("sha", 1, digest_bits // 4)).withColumn("n_bytes", F.octet_length("text").cast("long") if digest_bits == 256 else F.lit(0).cast("long"))

    read = digested(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")))
    # an update of no keys, so the table is there before the first batch; a frame of Python rows would start workers on the executors
    spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in _UPDATE.split(", "))]).write.mode("overwrite").parquet(f"{base}/updates/batch=-1")
    run = run_id or uuid.uuid4().hex
    before = _once(known_state(spark, base), f"{base}/before/{run}") if state_dir else None
    rows = _once(read.select("digest", "n_bytes", "id", _locator(read).alias("locator"), "sha"), f"{base}/arrivals/{run}", f"{base}/incoming/{run}")
    stream_state(spark, base, files_per_batch)
    state = known_state(spark, base)
    if state_dir:
        state = state.join(rows.select("digest", "n_bytes"), ["digest", "n_bytes"], "left_semi")
    repeated = _written(state.filter("group_size > 1").drop("locator"), "digests")
    n = repeated.count()
    earlier = _located(repeated, before, digested, text_col) if before is not None else None
    apart = _told_apart(read, repeated, n, earlier) if n else None
    # a row of a digest that came once stays; only repeated digests are looked up
    if n <= BROADCAST_DIGESTS:
        out = rows.join(F.broadcast(repeated), ["digest", "n_bytes"], "left")
    else:
        hot = repeated.filter(F.col("group_size") > HOT_GROUP)
        hot = F.broadcast(hot) if hot.count() <= BROADCAST_DIGESTS else hot
        many = rows.join(hot, ["digest", "n_bytes"])
        others = rows.join(hot.select("digest", "n_bytes"), ["digest", "n_bytes"], "left_anti")
        out = others.join(repeated.filter(F.col("group_size") <= HOT_GROUP), ["digest", "n_bytes"], "left").unionByName(many)
    out = out.select("digest", "id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha")
    if apart is not None:
        out = out.join(apart.select("digest").distinct(), "digest", "left_anti").drop("digest").unionByName(apart.select("id", "keep_id", "group_size", "sha"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _locator(df: DataFrame) -> Column:
    """The file that a row comes from; empty for rows of joins and unions, which come from no one file."""
    try:
        df.select(F.input_file_name())
    except AnalysisException as e:
        if e.getCondition() != "MULTI_SOURCES_UNSUPPORTED_FOR_EXPRESSION":
            raise
        return F.lit("")
    return F.input_file_name()


def _once(df: DataFrame, path: str, staged: str | None = None) -> DataFrame:
    """The rows as written to ``path``, by an earlier call if there was one; the folder appears when all rows are in it."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    target, staging = jvm.Path(path), jvm.Path(staged or f"{path}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        df.write.mode("overwrite").parquet(staging.toString())
        fs.mkdirs(target.getParent())
        if not fs.rename(staging, target):
            raise OSError(f"{staging.toString()} can't become {path}")
    return spark.read.schema(df.schema).parquet(path)


def _written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _located(repeated: DataFrame, before: DataFrame, digested: Callable[[DataFrame], DataFrame], text_col: str) -> DataFrame | None:
    """The texts of earlier rows that stay, of the digests that this run hit: read from the files that their locators name; None if there are none."""
    spark = before.sparkSession
    hits = before.join(repeated.select("digest", "n_bytes"), ["digest", "n_bytes"], "left_semi").select("digest", "n_bytes", F.col("keep_id").alias("id"), "group_size", F.col("locator").alias("file"))
    # names of files, not of rows
    files = [r["file"] for r in hits.filter("file <> ''").select("file").distinct().collect()]
    if not files:
        return None
    # a row is found in its file by its digest
    texts = digested(spark.read.parquet(*files).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.input_file_name().alias("file")))
    found = texts.join(hits, ["digest", "n_bytes", "file"]).select("digest", "n_bytes", "id", "group_size", "text", "sha")
    return _written(found.groupBy("digest", "n_bytes", "sha").agg(F.max("id").alias("id"), F.max("group_size").alias("group_size"), F.first("text").alias("text")), "earlier")


def _told_apart(read: DataFrame, repeated: DataFrame, n: int, earlier: DataFrame | None) -> DataFrame | None:
    """The comparison of full bytes on hits: rows of digests that hold unlike texts, grouped anew by text; None if there are none.

    The smallest and the largest text of a digest are equal only if all its
    texts are, and both are combined on the map side, so a hot digest sends one
    text per task.  ``earlier`` has the texts of rows of other runs.
    """
    hits = repeated.select("digest", "n_bytes")
    texts = read.join(F.broadcast(hits) if n <= BROADCAST_DIGESTS else hits, ["digest", "n_bytes"], "left_semi").select("digest", "text")
    if earlier is not None:
        texts = texts.unionByName(earlier.select("digest", "text"))
    unlike = _written(texts.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most").select("digest"), "collisions")
    if unlike.isEmpty():
        return None
    own = read.join(unlike, "digest").select("digest", "id", "text", "sha")
    each = own.select("digest", "text", "id", F.lit(1).cast("long").alias("n"))
    if earlier is not None:
        # of earlier rows with this text, as many as the state says hold that digest
        each = each.unionByName(earlier.join(unlike, "digest").select("digest", "text", "id", F.col("group_size").alias("n")))
    groups = each.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    return own.join(groups, ["digest", "text"])


def kept_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one of each group of equal texts.

    ``decisions`` is the result of :func:`exact_dedup` over the same rows.  Rows
    that repeat both identifier and text are told from each other by nothing
    that matters; one of them stays.  Only rows that go or repeat are looked
    up, so while those are BROADCAST_DIGESTS at most no text is shuffled or
    sorted, but of rows that repeat.
    """
    sha, own = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), apart(docs)
    name, digest, copies, mine = (own + c for c in ("id", "sha", "n", "sha2"))
    pairs = decisions.groupBy(F.col("doc_id").alias(name), F.col("text_sha256").alias(digest)).agg(F.sum(F.col("kept").cast("long")).alias(copies))
    odd = _written(pairs.filter(F.col(copies) != 1), "odd")
    n = {r["often"]: r["count"] for r in odd.groupBy((F.col(copies) > 1).alias("often")).count().collect()}
    on = F.col(id_col).eqNullSafe(F.col(name)) & (F.col(mine) == F.col(digest))
    rows = docs.withColumn(mine, sha)
    once = rows.join(F.broadcast(odd) if sum(n.values()) <= BROADCAST_DIGESTS else odd, on, "left_anti").select(*docs.columns)
    if not n.get(True):
        return once
    often = odd.filter(F.col(copies) > 1)
    often = rows.join(F.broadcast(often) if n[True] <= BROADCAST_DIGESTS else often, on).dropDuplicates([digest, name])
    return once.unionByName(often.select(*docs.columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
