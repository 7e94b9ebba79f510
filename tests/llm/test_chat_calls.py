import json

from mulberry.llm import chat as c

KIND = "conv_id long, turn long, role string, text string"


def events(spark, rows):
    got = c.format_chat(spark.createDataFrame(rows, KIND)).orderBy("conv_id", "turn", "place", "part", "kind")
    return [(r.kind, r.call_id, r.linked, list(r.problems), r.place) for r in got.collect()]


def test_json_over_lines_and_calls_without_id(spark):
    made = {"tool_calls": [{"id": "a", "name": "f", "arguments": {}}, {"name": "g", "arguments": {"q": 1}, "after": ["a"]}]}
    rows = [(1, 0, "assistant", json.dumps(made, indent=2)), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "x\ny"}, indent=2)), (2, 0, "assistant", '{"tool_calls": [{"name": "g"}]}')]
    assert events(spark, rows) == [("call", "a", True, [], 1), ("result", "a", True, [], 2), ("call", None, False, ["no id"], 3), ("call", None, False, ["no id"], 1)]
