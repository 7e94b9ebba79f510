from pyspark.sql import functions as F

from mulberry.operators import genres, hybrid, review
from mulberry.sources import dictionaries, files


def test_filters_and_signs(spark):
    df = spark.createDataFrame([("a", "a", "무협", True), ("a", "b", "미분류", None), (None, "b", None, False)], "o string, n string, genre string, checked boolean")
    assert review.previewed(df).count() == 2 and review.checked_only(df).count() == 1
    assert [r[0] for r in df.select(review.needs_change(F.col("o"), F.col("n"))).collect()] == [False, True, True]
    names = {"매니저181 (완).txt": True, "매니저 1-181 (완)": False, "매니저 (완)": False}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", review.needs_user(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in got} == names
    states = {"제목 미완": True, "제목 完, 외전 연재중": False, "제목 [외전1-20화미완]": False, "제목 연재중": True, "제목": False}
    got = spark.createDataFrame([(n,) for n in states], "n string").select("n", review.is_unfinished(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in got} == states
    raw = {"제목 1-10 (완)": False, "제목 1-10 完": True, "1부 1-10 (완) 2부 1-20 (완) 完": False, "제목 1-10화": True, "[홍길동] 제목": True, "제목 1-10 (완) + 외전": False}
    got = spark.createDataFrame([(n,) for n in raw], "n string").select("n", review.needs_normalising(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in got} == raw


def test_leading_tags(spark):
    want = {"[판타지] 제목": ("[판타지]", "제목"), "(무협)제목": ("[무협]", "제목"), "[골든아공간] 제목": (None, "제목"), "[현대 판타지 Aㅣ번역] 제목": ("[현판]", "제목"), "제목 [무협]": (None, "제목 [무협]"), "[판타지.없음] x": ("[판타지]", "x")}
    got = spark.createDataFrame([(n,) for n in want], "n string").select("n", review.leading_tag(F.col("n")).alias("x")).select("n", "x.*").collect()
    assert {r.n: (r.category, r.rest) for r in got} == want


def test_files_of_runs(spark, tmp_path):
    names = spark.createDataFrame([("a", "A", 1), ("a", "B", 2), ("b", "C", 3)], "original_name string, standard_name string, pos long")
    assert sorted(map(tuple, review.legacy_mapping(names).collect())) == [("a", "B"), ("b", "C")]
    tasks = spark.createDataFrame([("r", "n", "g", "s", "c", "x")], "raw_name string, normalized_name string, genre string, status string, confidence string, source string")
    assert review.table_rows(tasks).columns == ["Original", "Normalized", "Genre", "Status", "Confidence", "Source"]
    path = str(tmp_path / "csv")
    files.write_csv(names.select("original_name", "standard_name"), path)
    review.rewrite(files.read_csv(spark, path).withColumn("standard_name", F.upper("original_name")), path)
    assert sorted(map(tuple, files.read_csv(spark, path).collect())) == [("a", "A"), ("a", "A"), ("b", "B")]


def test_several_hits_of_a_task_are_one_row(spark):
    tasks = spark.createDataFrame([(1, "x", "x", "")], "task_id long, raw_name string, title string, genre string")
    cache = spark.createDataFrame([("y", "g", "high", "c"), ("y", "h", "high", "c")], "key string, genre string, confidence string, source string")
    search = spark.createDataFrame([(1, "", "a"), (1, "무협", "b"), (1, "현판", "c")], "task_id long, genre string, source string")
    words = spark.createDataFrame([(1, "무협"), (1, "SF")], "task_id long, genre string")
    assert [tuple(r)[-3:] for r in genres.classify(tasks, cache, search, words).collect()] == [("무협", "high", "b")]


def test_names_of_files_are_classified(spark):
    kind = "file string, search_genre string, search_confidence double, search_source string, keyword_genre string, keyword_confidence double, n_keywords int, author_genre string, title_genre string, title_confidence double"
    rows = [("검의 노래 1-10 (완).txt", "현판", 0.9, "kakao_tag", "스포츠", 0.8, 3, None, None, None), ("", None, None, None, "미분류", 0.0, 0, "무협", None, None), ("특별 1-3.txt", None, None, None, "무협", 0.9, 3, None, None, None), ("무엇.txt", None, None, None, "미분류", 0.1, 0, "선협", None, None), ("무엇 둘.txt", None, None, None, "무협", 0.3, 1, None, None, None)]
    got = hybrid.classify_files(spark.createDataFrame(rows, kind), "file", [("특별", "SF")], [], {}).select("title", "genre", "confidence", "method").collect()
    assert [tuple(r) for r in got] == [("검의 노래", "스포츠", 0.9, "kakaotag_sports_refined"), ("", "미분류", 0.0, "no_title"), ("특별", "SF", 0.95, "special_case"), ("무엇", "선협", 0.85, "author_genre_db"), ("무엇 둘", "미분류", 0.3, "keyword_only_low_confidence")]


def test_dictionaries_are_read_from_the_first_place(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"mapping": {"무협 소설": "무협"}, "entries": {"a": {"genre": "SF", "confidence": "high", "source": "x", "cached_at": "2024"}}}', encoding="utf-8")
    paths = [str(tmp_path / "a.json"), str(tmp_path / "b.json")]
    assert [tuple(r) for r in dictionaries.read_mapping(spark, paths).collect()] == [("무협 소설", "무협")]
    assert [tuple(r) for r in dictionaries.read_cache(spark, paths).collect()] == [("a", "SF", "high", "x", "2024")]
    assert dictionaries.read_mapping(spark, paths[:1]).count() == 0
