import zipfile

from pyspark.sql import functions as F

from mulberry.operators import genres, naming, reports
from mulberry.plans.catalogue import curate, mapping, summary
from mulberry.sources import dictionaries, files
from mulberry.streaming import inbox


def test_scan_to_mapping(spark, tmp_path):
    for p in ("[무협] 하나 1-10 (완).txt", "sub/둘 1-20 完.epub", "Temp/no.txt", "sub/Temp/yes.TXT", "x.jpg"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    found = files.scan_files(spark, str(tmp_path))
    assert sorted(r.name for r in found.collect()) == sorted(["[무협] 하나 1-10 (완).txt", "둘 1-20 完.epub", "yes.TXT"])
    tasks = files.tasks_of(found)
    cache = spark.createDataFrame([("둘", "선협", "high", "cache")], "key string, genre string, confidence string, source string")
    none = spark.createDataFrame([], "task_id long, genre string, source string")
    out = curate(tasks, cache, none, none)
    names = {r.raw_name: (r.normalized_name, r.genre, r.confidence) for r in out.collect()}
    assert names["[무협] 하나 1-10 (완)"] == ("[무협] 하나 1-10 (완).txt", "무협", "high")
    assert names["둘 1-20 完"] == ("[선협] 둘 1-20 (완).epub", "선협", "high")
    assert names["yes"] == ("yes.TXT", "미분류", "low")
    assert summary(out).first().processed == 3
    m = mapping(out)
    assert m.columns == ["original_path", "normalized_path", "genre", "confidence", "status", "error_message"]
    files.write_csv(m, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 3
    again = files.task_from_json(F.to_json(F.struct(*tasks.columns)))
    assert tasks.select(again.alias("t")).select("t.*").exceptAll(tasks).count() == 0


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "12345")
    (tmp_path / "bad.zip").write_text("no zip")
    (tmp_path / "c.rar").write_text("x")
    got = {r.archive.rsplit("/", 1)[1]: r for r in files.archive_members(spark, str(tmp_path)).collect()}
    assert (got["a.zip"].name, got["a.zip"].size) == ("d/x.txt", 5)
    assert got["bad.zip"].error and got["c.rar"].error == "unsupported"
    listing = "Path = d\nFolder = +\n\nPath = d/a.txt\nSize = 12\nFolder = -\n\n"
    rows = files.parse_listing(spark.createDataFrame([("z", listing)], "archive string, listing string")).collect()
    assert [(r.name, r.size, r.is_dir) for r in rows] == [("d", 0, True), ("d/a.txt", 12, False)]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"keywords": {"무협": {"강호": 3}, "SF": {"우주": 2}}, "compounds": {"SF": [["우주", "함대", "9"]]}}')
    d = dictionaries.read_keywords(spark, str(tmp_path / "k.json"))
    assert sorted(map(tuple, d["keywords"].collect())) == [(0, "무협", 0, "강호", 3), (1, "SF", 0, "우주", 2)]
    assert d["compounds"].first().score == 9 and d["specials"].count() == 0
    assert dictionaries.genre_map(spark).count() == 50


def test_overrides(spark):
    tasks = spark.createDataFrame([(i, "무협", c, "x", "pending") for i, c in enumerate(["medium", "medium", "medium", "high"])], "task_id long, genre string, confidence string, source string, status string")
    answers = spark.createDataFrame([(0, "선협"), (1, None), (3, "SF")], "task_id long, selected_genre string")
    got = {r.task_id: (r.genre, r.confidence, r.status) for r in genres.apply_overrides(tasks, answers).collect()}
    assert got == {0: ("선협", "high", "pending"), 1: ("무협", "medium", "skipped"), 2: ("무협", "medium", "pending"), 3: ("무협", "high", "pending")}
    assert {r.task_id: r.genre for r in genres.apply_overrides(tasks, answers, every=True).collect()}[3] == "SF"


def test_ranks_over_partitions(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = {r.id: r.rank for r in reports.ranked(df, [F.col("k").desc(), F.col("id").asc()]).collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert got == {i: n + 1 for n, i in enumerate(want)}


def test_ranks_of_a_million_rows_with_a_payload(spark):
    df = spark.range(1_000_000, numPartitions=8).withColumn("k", F.xxhash64("id") % 1000).withColumn("payload", F.sha2(F.col("id").cast("string"), 256))
    got = reports.ranked(df, [F.col("k").desc(), F.col("id").asc()])
    want = sorted((-r.k, r.id) for r in df.select("id", "k").collect())
    place = {i: n + 1 for n, (_, i) in enumerate(want)}
    rows = got.select("id", "rank", "payload").collect()
    assert len(rows) == 1_000_000 and all(place[r.id] == r["rank"] for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "original string, name string, pos long, folder string, status string")
    assert naming.number_duplicates(none, "original", "name", "pos").count() == 0
    assert naming.free_names(none, none.select("folder", "name")).count() == 0
    assert reports.run_summary(none).first().success_rate is None


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("[무협] 하나 1-10 (완)\n\n둘 1-20 完\n")
    q = inbox.names_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("names").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.title for r in spark.table("names").collect()) == ["둘", "하나"]
    entries = "title string, genre string, confidence string, source string, cached_at string"
    spark.createDataFrame([("A", "무협", "high", "x", "1"), ("a ", "SF", "high", "x", "2")], entries).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(entries).parquet(str(tmp_path / "e"))
    inbox.cache_versions(stream, str(tmp_path / "c"), str(tmp_path / "k")).awaitTermination()
    assert [tuple(r) for r in inbox.current_cache(spark.read.parquet(str(tmp_path / "c"))).select("key", "genre").collect()] == [("a", "SF")]
    times = spark.readStream.schema("t timestamp, g string").parquet(_times(spark, tmp_path))
    q = inbox.counts_per_window(times, "t", "g").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 3


def _times(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "a"), ("2024-01-01 00:05:00", "a"), ("2024-01-01 00:11:00", "b")], "t string, g string")
    rows.select(F.to_timestamp("t").alias("t"), "g").write.parquet(str(tmp_path / "t"))
    return str(tmp_path / "t")
