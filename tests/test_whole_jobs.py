"""Queries that look at all rows of their tables."""

from mulberry.plans import decision_queries as d


def test_fusion_takes_every_line_and_the_order_s_title(spark, tmp_path):
    """Two results of one platform for one line, the first without a genre; the title moves the second."""
    rows = [(7, 2, 3, 0.05, "N"), (7, 2, 8, 0.05, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in d.platform_fusion(spark, str(tmp_path)).collect()] == [(7, "노벨피아", "스포츠", 0.85)]


def test_fuzzy_matches_count_every_link(spark, tmp_path):
    """Each asked title is linked with both titles a letter apart, and the one that has no like with none."""
    rows = [(1, "Brand#1", "small red ring one"), (2, "Brand#1", "small red ring ona"), (3, "zq", "wvy")]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: (r.match_id, r.n_links) for r in d.fuzzy_matches(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (None, 0)} and "fuzzy_matches" in d.ORACLES


def test_pages_and_texts_come_out_in_slices(spark):
    """A worker makes the fields of some pages at a time, not of a whole batch; none is left out."""
    import pandas as pd

    from mulberry.functions.platforms import page_fields
    from mulberry.functions.slices import SLICE_CHARS, slices

    pages = pd.Series(["<title>t</title><p>" + "가" * 10_000, None, ""] * 200)
    some = list(page_fields.func(iter([pages])))
    assert len(some) > 2 and sum(map(len, some)) == 600 and max(f["text"].str.len().sum() for f in some) <= SLICE_CHARS + 20_000
    assert [len(s) for s in slices(pd.Series(["x" * 5, "y" * 900, None, "z"]), 500)] == [2, 2] and not list(slices(pd.Series([], dtype=object)))


def test_titles_are_cleaned_once(spark):
    """The plan holds each substitution of a title once a title, not once a test."""
    from pyspark.sql import functions as F

    from mulberry.functions import matching

    df = spark.range(1).select(F.col("id").cast("string").alias("a"), F.concat("id", F.lit("b")).alias("b"))
    plan = df.select(matching.same_title(F.col("a"), F.col("b"), F.lit(""), F.lit("")).alias("same"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") + plan.count("RegExpReplace") <= 2 * (len(matching.PLATFORM_TITLE) + 3)


def test_dictionary_walks_come_out_in_slices(spark, monkeypatch):
    """Rows of matches leave a worker some texts at a time, in the order of the texts; nulls stay null."""
    from pyspark.sql import functions as F

    from mulberry.functions.slices import SLICE_CHARS
    from mulberry.operators import dictionary

    words = spark.createDataFrame([("stone",), ("river",)], "word string")
    texts = spark.range(40).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.repeat(F.lit("x"), SLICE_CHARS // 3), F.when(F.col("id") % 2 == 0, "river").otherwise("stone"))).alias("t")).coalesce(1)
    walk = dictionary.walked(words, "array<struct<at:int,word:string>>", lambda a, _, t: [(len(t), w) for _, w in a.iter(t)])[0]
    got = {r.id: r.m and [x.word for x in r.m] for r in texts.select("id", walk(F.col("t")).alias("m")).collect()}
    assert got == {i: None if i % 7 == 0 else ["river" if i % 2 == 0 else "stone"] for i in range(40)}
