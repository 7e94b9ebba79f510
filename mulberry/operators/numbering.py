"""Running sums and places within groups of any size: a group that holds a third of all rows is spread over tasks like any other rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.operators.lineage import cut


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column | None = None, name: str = "place") -> DataFrame:
    """Add ``name``: the sum of ``value`` (null: 0; without one, the number of rows) over a row's group from its first row to this one.

    Rows are dealt by ranges of keys and order, so a large group lies in several
    ranges; sums run within a range and get the sums of the group's ranges
    before it.  Only groups in several ranges need those, and at most one group
    goes on from each range to the next: what is broadcast has no more rows
    than there are ranges.  Rows that neither keys nor order tell apart are in
    one range.  Null keys are a group.  The dealt rows are written once, as the
    bounds of the ranges are sampled anew whenever they are computed.
    """
    own = "_"
    while any(c.startswith(own) for c in df.columns):
        own += "_"
    part, amount, before = own + "part", own + "value", own + "before"
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = F.lit(1).cast("long") if value is None else F.coalesce(value, F.lit(0)).cast("long")
    d = cut(df.withColumn(amount, one).repartitionByRange(ranges, *keys, *order).withColumn(part, F.spark_partition_id()))
    sums = d.groupBy(part, *keys).agg(F.sum(amount).alias(before))
    earlier = F.sum(before).over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    of_range = own + "range"
    sums = sums.select(F.col(part).alias(of_range), *(F.col(k).alias(f"{own}key{i}") for i, k in enumerate(keys)), earlier.alias(before)).filter(F.col(before).isNotNull())
    within = F.sum(amount).over(Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col(part) == F.col(of_range)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{own}key{i}"))
    out = d.withColumn(name, within).join(F.broadcast(sums), same, "left")
    return out.withColumn(name, F.col(name) + F.coalesce(before, F.lit(0))).select(*df.columns, name)
