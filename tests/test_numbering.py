"""Running sums in groups of any size against plain Python, and how a hot group is spread."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from mulberry.operators import naming
from mulberry.operators.numbering import running


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice(["x", None]), i, rng.choice([None, 0, 1, 5])) for i in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "k string, l string, i int, v int").withColumns({c: F.lit("clash") for c in ("_part", "__value", "_key0")})
    sums, places, want = defaultdict(int), defaultdict(int), []
    for k, label, i, v in sorted(rows, key=lambda r: r[2]):
        sums[k, label] += v or 0
        places[k, label] += 1
        want.append((i, sums[k, label], places[k, label]))
    out = running(running(df, ["k", "l"], [F.col("i").asc()], F.col("v"), "s"), ["k", "l"], [F.col("i").asc()])
    assert sorted(map(tuple, out.select("i", "s", "place").collect())) == sorted(want)
    assert running(df.limit(0), ["k"], [F.col("i").asc()]).collect() == []


MANY = 300_000


def test_many_newcomers_of_one_name(spark):
    """They are spread over the tasks, and numbered past the names that are there."""
    new = spark.range(MANY).select((F.col("id") * 7919 % 1_000_003).alias("pos"), F.lit("f").alias("folder"), F.lit("a.txt").alias("name"))
    have = spark.range(2000).select(F.lit("f").alias("folder"), F.concat(F.lit("a ("), (F.col("id") * 3 + 1).cast("string"), F.lit(").txt")).alias("name"))
    out = naming.free_names(new, have)
    number = F.when(F.col("free_name") == "a.txt", 0).otherwise(F.regexp_extract("free_name", r"\((\d+)\)", 1).cast("long"))
    got = out.select(number.alias("n")).agg(F.count("*"), F.countDistinct("n"), F.max("n"), F.count_if((F.col("n") % 3 == 1) & (F.col("n") < 6000))).first()
    assert tuple(got) == (MANY, MANY, MANY + 1_999, 0)
    d = running(new, ["name"], [F.col("pos").asc()])
    assert d.agg(F.max("place")).first()[0] == MANY
    sizes = [r["count"] for r in new.repartitionByRange(4, "name", "pos").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < MANY * 0.4
