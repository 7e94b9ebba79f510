"""A corpus pipeline: five stages, each written as Parquet and read again by the next.

toxicity -> exact dedup -> near dedup -> mix -> encode.  All but the last
return the columns of ``documents``; a stage sees all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.llm.bpe import encode_decode, tokenizer_path
from mulberry.llm.common import apart, cut, scratch, stored, table
from mulberry.llm.exact_dedup import exact_dedup, kept_rows
from mulberry.llm.mixing import mix, mixed_rows
from mulberry.llm.near_dedup import BROADCAST_IDS, near_duplicates
from mulberry.llm.toxicity import without_toxic

#: Words of a shingle and similarity (per cent) from which two documents are near-duplicates.
SHINGLE, SIMILAR = 5, 80
#: Rows of texts that an executor and its workers hand each other at once, at most.
BATCH_ROWS = 500
#: Half the words whose tokens an encoding task keeps: fewer than by itself, as workers and executor hold what earlier stages left them.
KEPT_WORDS = 25_000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers and back in batches of BATCH_ROWS at most; the setting stays, as stages run when their rows are written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(spark.conf.get(name))
    if most <= 0 or most > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is scored toxic go, each row by its own text."""
    small_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, that of the largest doc_id stays."""
    return kept_rows(docs, exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id.

    Rows that no doc_id names for itself (it is null, or other texts have it
    too) are compared under a hash of their text, above all other identifiers.
    """
    small_batches(spark)
    columns, helper = docs.columns, apart(docs)
    name, also, row, gone_id = (helper + c for c in ("id", "also", "row", "gone"))
    shared = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias(name)))
    own = F.col("doc_id").cast("long")
    if not shared.isEmpty():
        docs = docs.join(shared.withColumn(also, F.lit(True)), F.col("doc_id").eqNullSafe(F.col(name)), "left").drop(name)
        own = F.when(F.col(also), F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 62)) + (1 << 62)).otherwise(own)
    rows = docs.withColumn(row, own)
    gone = stored(near_duplicates(rows, SHINGLE, SIMILAR, id_col=row).filter("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), "near-copies")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, F.col(row) == F.col(gone_id), "left_anti").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as much of them as the mix of sources takes."""
    return mixed_rows(docs, mix(docs, digest=True))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text of each row."""
    small_batches(spark)
    return encode_decode(docs, tokenizer_path(), kept_words=KEPT_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL can't express the first, third and last stages; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
