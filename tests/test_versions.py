"""Dimensions as of a time, against plain Python."""

import random

from mulberry.operators import versions as v

KIND = "author string, genre string, valid_from int, gone boolean"



def test_two_runs_at_two_times_see_two_dictionaries(spark, tmp_path):
    folder = f"{tmp_path}/authors"
    v.add_versions(spark.createDataFrame([("a", "무협", 10, None), ("b", "SF", 10, None)], KIND), folder, "one")
    for _ in range(2):  # a run that is repeated adds nothing twice
        v.add_versions(spark.createDataFrame([("a", "현판", 20, None), ("b", None, 20, True), ("c", "역사", 20, None)], KIND), folder, "two")
    versions = v.read_versions(spark, folder)
    assert versions.count() == 5

    def seen(t):
        return sorted((r.author, r.genre) for r in v.as_of(versions, ["author"], t).collect())

    assert (seen(5), seen(10), seen(19), seen(20)) == ([], [("a", "무협"), ("b", "SF")], [("a", "무협"), ("b", "SF")], [("a", "현판"), ("c", "역사")])


def test_join(spark):
    rng = random.Random(1)
    rows = [(rng.choice("hhhhab"), rng.choice(["x", "y", "z"]), rng.choice([None, *range(40)]), rng.random() < 0.2 or None) for _ in range(300)]
    rows = [(a, None if gone else g, f, gone) for a, g, f, gone in rows]
    facts = [(i, rng.choice(["h", "a", "b", "none", None]), rng.choice([None, *range(-1, 45)])) for i in range(400)]
    df = spark.createDataFrame(facts, "id int, author string, at int")
    # of one key and time a row that ends the key sorts after the others of no genre, before those of one
    got = {r.id: r.genre for r in v.as_of_join(df, spark.createDataFrame(rows, KIND), "author", "at", ["genre"]).collect()}

    def want(key, t):
        if key is None or t is None:
            return None
        found = [(f if f is not None else -1, (g is not None, g or ""), bool(gone), g) for a, g, f, gone in rows if a == key and (f is None or f <= t)]
        best = max(found, default=None)
        return None if best is None or best[2] else best[3]

    assert got == {i: want(a, t) for i, a, t in facts}


def test_nothing(spark):
    none = spark.createDataFrame([], KIND)
    assert v.as_of(none, ["author"], 1).collect() == []
    assert [tuple(r) for r in v.as_of_join(spark.createDataFrame([("a", 1)], "author string, at int"), none, "author", "at", ["genre"]).collect()] == [("a", 1, None)]
