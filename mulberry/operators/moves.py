"""Plans of moves carried out on files, so that a run that was killed can be run again: no file is lost or doubled.

A step asks for one file to get another path.  What it finds tells what is left
to do: only the old path there, it is moved; only the new one, it was moved by
a run or a task before; both, it is blocked; neither, it is missing.  A task
that Spark repeats therefore does no harm.  Every run adds what it did to a log
of Parquet files, from which moves can be undone.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.operators.lineage import cut
from mulberry.sources.storage import file_system

#: Steps to a task, about.
STEPS_A_TASK = 500
_LOG = "run_id string, seq long, old_path string, new_path string, status string, error string"


def _move(old: str, new: str) -> tuple[str, str | None]:
    """What a step comes to: moved, done before, blocked, missing or failed."""
    try:
        system, source = file_system(old)
        other, target = file_system(new)
        if system != other:
            return "failed", "the paths are of different file systems"
        here, there = (i.type != fs.FileType.NotFound for i in system.get_file_info([source, target]))
        if here and there:
            return "blocked", "the new path is taken"
        if not here:
            return ("done before", None) if there else ("missing", "neither path is there")
        system.create_dir(posixpath.dirname(target), recursive=True)
        system.move(source, target)
        return "moved", None
    except (OSError, ValueError) as e:
        return "failed", str(e)


def carry_out(plan: DataFrame, log: str, run_id: str) -> DataFrame:
    """(run_id, seq, old_path, new_path, status, error) of every step of ``plan`` (seq, old_path, new_path), carried out and added to the log.

    Of steps to one path that of the least seq is carried out, others are
    blocked.  Steps from a path to itself and those with null paths are
    skipped.  A step whose new path another one is to leave is blocked while
    that one is there; a later run of the same plan carries it out.  A run
    repeated under its ``run_id`` replaces its part of the log.
    """
    spark = plan.sparkSession
    steps = plan.select(F.col("seq").cast("long").alias("seq"), "old_path", "new_path")
    first = steps.filter("new_path is not null").groupBy("new_path").agg(F.min("seq").alias("first"))
    steps = cut(steps.join(first, "new_path", "left").select("seq", "old_path", "new_path", (F.col("seq") == F.col("first")).alias("own")))
    tasks = max(1, steps.count() // STEPS_A_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, old, new, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if old is None or new is None or old == new:
                    out.append((run_id, seq, old, new, "skipped", None))
                elif not own:
                    out.append((run_id, seq, old, new, "blocked", "an earlier step has this new path"))
                else:
                    out.append((run_id, seq, old, new, *_move(old, new)))
            kinds = [pa.string(), pa.int64(), *[pa.string()] * 4]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["run_id", "seq", "old_path", "new_path", "status", "error"])

    part = f"{log}/run={run_id}"
    steps.repartition(tasks).mapInArrow(run, _LOG).write.mode("overwrite").parquet(part)
    return spark.read.schema(_LOG).parquet(part)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All that runs have added to a log."""
    return spark.read.schema(_LOG).option("recursiveFileLookup", True).parquet(log)


def undo_plan(done: DataFrame) -> DataFrame:
    """(seq, old_path, new_path): the plan that takes back the moves of a log; a file moved by several runs goes back by each of them, the last first."""
    moved = done.filter("status in ('moved', 'done before')").groupBy("old_path", "new_path").agg(F.min("seq").alias("seq"))
    return moved.select((-F.col("seq")).alias("seq"), F.col("new_path").alias("old_path"), F.col("old_path").alias("new_path"))
