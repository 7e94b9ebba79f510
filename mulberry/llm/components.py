"""Connected components of a graph given by its links, by alternating large and small stars.

Every round is two grouped minima and two joins; the links of a round are
written to the shared folder, so a lost executor costs one round at most.
Nothing of the graph comes to the driver but one count and one sum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mulberry.llm.common import cut

#: Links to a task, and tasks at least: a small graph writes few files a round, a large one keeps all its partitions.
LINKS_A_TASK, LEAST_TASKS = 20_000, 8


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """``links`` are distinct and go from the larger vertex.  Of each vertex, link its larger (else: smaller) neighbours to the least vertex among it and its neighbours."""
    if large:
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        both = links.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
    out = both.join(least, "x")
    if large:
        out = out.filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).filter("u <> v")
    return cut(out.coalesce(tasks).distinct().coalesce(tasks))


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``links`` (columns u and v); the component is its least vertex.

    Links to oneself and repeated links count once; links with a null end are
    left out.  No links give no rows.
    """
    links = cut(links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    before = None
    while before != (now := state(links)):
        before = now
        if not now[0]:
            break
        tasks = max(LEAST_TASKS, now[0] // LINKS_A_TASK)
        links = _star(_star(links.coalesce(tasks), True, tasks), False, tasks)
    pairs = links.select(F.greatest("u", "v").alias("vertex"), F.least("u", "v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("vertex"), "component").distinct())
