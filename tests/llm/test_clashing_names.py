"""Columns named like an operator's helpers neither stop it nor change what it returns."""

import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from mulberry.llm import exact_dedup, mixing, near_dedup, substring_dedup, toxicity

HOSTILE = "_id _n _sha _sha2 _m _k1 _p _c _digest _also _row _gone __id _hi _lo _spans _source _size __row _i _s _z _d id set band regs digest key".split()


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, text + " more", "en", "b", 1), (4, "other words " * 30, "en", None, 1), (4, "other words " * 30, "en", None, 1), (5, None, None, "b", 0), (None, "nobody " * 8, "en", "a", 1), (6, "", "en", "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def hostile(docs):
    return docs.withColumns({c: F.lit(f"clash {c}") for c in HOSTILE})


FUNCTIONS = {
    "kept_rows": lambda d: exact_dedup.kept_rows(d, exact_dedup.exact_dedup(d)),
    "mixed_rows": lambda d: mixing.mixed_rows(d, mixing.mix(d, digest=True)),
    "near_duplicates": near_dedup.near_duplicates,
    "without_repeats": lambda d: substring_dedup.without_repeats(d, substring_dedup.passages(d)),
}


@pytest.mark.parametrize("name", list(FUNCTIONS))
def test_functions(docs, name):
    plain, got = FUNCTIONS[name](docs), FUNCTIONS[name](hostile(docs))
    assert rows(got, *plain.columns) == rows(plain, *plain.columns)
    if name != "near_duplicates":
        assert set(got.columns) == {*docs.columns, *HOSTILE}


def test_without_toxic(spark, docs):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    plain, got = toxicity.without_toxic(docs, labels), toxicity.without_toxic(hostile(docs), labels)
    assert rows(got, *docs.columns) == rows(plain, *docs.columns) and set(got.columns) == {*docs.columns, *HOSTILE}


@pytest.mark.parametrize("at", range(1, len(pipeline.STAGES)))
def test_stages(spark, docs, at):
    """Each stage but the first, which reads labels: null texts, repeated rows and clashing names."""
    stage = pipeline.STAGES[at][1]
    plain, got = stage(spark, docs, ""), stage(spark, hostile(docs), "")
    assert rows(got, *plain.columns) == rows(plain, *plain.columns)


def test_names_of_helpers(docs):
    from mulberry.llm.common import apart

    for n in range(1, 5):
        df = docs.withColumns({"_" * k + "x": F.lit(1) for k in range(1, n)})
        assert not any(c.startswith(apart(df)) for c in df.columns)
    assert len(set(itertools.chain([apart(docs)]))) == 1
