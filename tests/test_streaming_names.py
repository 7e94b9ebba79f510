"""Names numbered across batches and restarts of a stream, as one batch over all of them has it."""

from mulberry.operators.naming import free_names
from mulberry.streaming.inbox import numbered_names

KIND = "pos long, folder string, name string"


def test_numbers_go_on_after_a_restart(spark, tmp_path):
    arrivals = [[(i, "f", "a.txt" if i % 3 else "b") for i in range(7)], [(i, "f", "a.txt") for i in range(7, 12)], [(12, "g", "a.txt"), (13, None, "b"), (14, None, "b"), (15, "f", "b")]]

    def drain():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = numbered_names(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    for i, rows in enumerate(arrivals):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i:  # the first two arrive before the stream starts, the third after it has stopped
            drain()
    got = spark.read.parquet(f"{tmp_path}/out")
    every = spark.createDataFrame([r for rows in arrivals for r in rows], KIND)
    want = free_names(every, spark.createDataFrame([], "folder string, name string"))
    assert sorted(map(str, got.select("folder", "free_name").collect())) == sorted(map(str, want.select("folder", "free_name").collect()))
    assert got.count() == 16 and got.select("pos").distinct().count() == 16
