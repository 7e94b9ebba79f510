import json
import random

from mulberry.llm import chat as c


def depths(spark, after, cid="c1"):
    calls = spark.createDataFrame([(cid, k, v) for k, v in after.items()], "cid string, key string, after array<string>")
    return {r.key: r.depth for r in c._depths(calls).collect()}


def plain(after):
    """The longest chain before each call, by settling what can be settled."""
    needs = {k: {x for x in v or [] if x in after} for k, v in after.items()}
    out = {}
    while ready := [k for k in needs if k not in out and all(x in out for x in needs[k])]:
        for k in ready:
            out[k] = max((out[x] + 1 for x in needs[k]), default=0)
    return {k: out.get(k, -1) for k in after}


def test_long_chains_are_no_cycles(spark):
    made = [{"id": f"c{i}", "name": "f", "after": [f"c{i - 1}"] if i else None} for i in range(500)]
    rows = [(None, 0, "assistant", json.dumps({"tool_calls": made[::-1]}))]
    got = c.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.call_id: (r.place, list(r.problems)) for r in got} == {f"c{i}": (2 * i + 1, []) for i in range(500)}


def test_cycles_and_chains_after_them(spark):
    after = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "zz"], "x": ["y", "a"], "y": ["x"], "z": ["x"], "s": ["s"], "t": ["s"], "u": ["v"], "v": ["w"], "w": ["u"]}
    want = {"a": 0, "b": 1, "c": 2, "d": 3, "x": -1, "y": -1, "z": -1, "s": -1, "t": -1, "u": -1, "v": -1, "w": -1}
    assert plain(after) == want == depths(spark, after)


def test_random_graphs_against_a_plain_computation(spark):
    for seed in range(3):
        rng = random.Random(seed)
        after = {f"k{i}": [f"k{rng.randrange(max(0, i - 6), i + (rng.random() < 0.02))}" for _ in range(rng.choice([1, 1, 1, 2]))] if i else [] for i in range(40)}
        assert depths(spark, after) == plain(after), seed
