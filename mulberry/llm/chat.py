"""Chat formatting with linked tool calls.

A turn's text may be a JSON object with ``tool_calls`` (an array of id, name,
arguments and, optionally, ``after``: ids of calls whose results it needs) or,
for a tool's turn, with ``tool_call_id`` and ``content``.  Calls and results are
joined by conversation and identifier; every event gets a place in a
topological order (a result after its call, a call after the results it
needs); arguments are checked against the tools' schemas; every event is
serialised as canonical JSON: keys in order, no spaces, no nulls.

An event is a row, so no conversation is ever gathered in one place: sorted by
(turn, place, part) the rows of a conversation are its text.

The table of the query holds plain turns.  ``turns_as_calls`` reads them as an
exchange with a tool: what a user says is a call, the turn after is its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.llm.common import cut, table, word_count

CALL = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
TURN = f"struct<content:string,tool_calls:{CALL},tool_call_id:string>"
#: JSON schema types by the variant types that they admit.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}
#: The tools of the query.
TOOLS = {
    "ask": {"required": ["text", "words"], "properties": {"text": {"type": "string"}, "words": {"type": "integer"}, "size": {"enum": ["short", "medium", "long"]}}, "additionalProperties": False},
    "tell": {"required": ["text", "lines"], "properties": {"text": {"type": "string"}, "lines": {"type": "integer"}, "words": {"type": "integer"}, "size": {"enum": ["short", "medium"]}}},
}


def canonical(text: Column) -> Column:
    """A JSON text with its keys in order and without spaces; null if it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def violations(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What the arguments of a call break of its tool's schema: an array of short texts.

    Of JSON schema these count: ``properties`` with ``type`` (one or several)
    and ``enum``, ``required``, ``additionalProperties: false``.
    """
    args = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        props = schema.get("properties", {})
        found = []
        for key in schema.get("required", []):
            found.append(F.when(F.try_variant_get(args, f'$["{key}"]', "variant").isNull(), F.lit(f"missing {key}")))
        for key, rule in props.items():
            value = F.try_variant_get(args, f'$["{key}"]', "variant")
            kinds = rule.get("type", [])
            kinds = [kinds] if isinstance(kinds, str) else kinds
            if kinds:
                pattern = "^(" + "|".join(TYPES[k] for k in kinds) + ")$"
                found.append(F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(pattern), F.lit(f"type of {key}")))
            if "enum" in rule:
                found.append(F.when(value.isNotNull() & ~F.to_json(value).isin([_compact(v) for v in rule["enum"]]), F.lit(f"value of {key}")))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.coalesce(F.json_object_keys(arguments), none), F.array(*[F.lit(k) for k in props]).cast("array<string>"))
            found.append(F.when(F.size(extra) > 0, F.lit("more keys")))
        own = F.array_compact(F.array(*found)) if found else none
        own = F.when(F.schema_of_variant(args).startswith("OBJECT"), own).otherwise(F.array(F.lit("no object")))
        out = F.when(name == tool, own).otherwise(out)
    return F.coalesce(out, F.array(F.lit("unknown tool")))


def _compact(value: object) -> str:
    import json

    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _depths(calls: DataFrame) -> DataFrame:
    """(cid, key, depth): the longest chain of calls before each; -1 on a cycle or after one.

    ``calls`` has cid, key and after, one row a call.  Calls of one need are
    jumped over by pointer doubling: their pointers reach the next call of no
    or of several needs in as many rounds as the logarithm of the chain's
    length, and what has not got there by then runs in a circle.  What is left
    is a graph of the calls of several needs, which are settled when all they
    need is, a round a level.
    """
    needs = calls.select("cid", "key", F.explode("after").alias("need")).filter("need is not null").distinct()
    known = calls.select("cid", F.col("key").alias("need"))
    needs = cut(needs.join(known, ["cid", "need"]))  # what isn't called is waited for by none
    count = needs.groupBy("cid", "key").agg(F.count("*").alias("n"), F.min("need").alias("ptr"))
    jumps = cut(count.filter("n = 1").select("cid", "key", "ptr", F.lit(1).cast("long").alias("w")))
    rounds = jumps.count().bit_length()
    for _ in range(rounds):
        on = jumps.select("cid", F.col("key").alias("ptr"), F.col("ptr").alias("to"), F.col("w").alias("more"))
        both = cut(jumps.join(on, ["cid", "ptr"], "left"))
        jumps = both.select("cid", "key", F.coalesce("to", "ptr").alias("ptr"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        if both.filter("to is not null").isEmpty():
            break
    several = needs.join(count.filter("n > 1").select("cid", "key"), ["cid", "key"], "left_semi")
    skip = jumps.select("cid", F.col("key").alias("need"), "ptr", "w")
    edges = several.join(skip, ["cid", "need"], "left").select("cid", "key", F.coalesce("ptr", "need").alias("need"), (F.coalesce("w", F.lit(0)) + 1).alias("w"))
    edges = cut(edges.groupBy("cid", "key", "need").agg(F.max("w").alias("w")))
    front = cut(calls.select("cid", "key").join(count.select("cid", "key"), ["cid", "key"], "left_anti").withColumn("depth", F.lit(0).cast("long")))
    settled = front
    while not edges.isEmpty() and not front.isEmpty():
        met = front.select("cid", F.col("key").alias("need"), "depth")
        # the depth that an edge gives stays with it, so a call is settled by its own edges alone
        state = cut(edges.join(met, ["cid", "need"], "left").select("cid", "key", F.when(F.col("depth").isNull(), F.col("need")).alias("need"), (F.col("w") + F.coalesce("depth", F.lit(0))).alias("w")))
        done = state.groupBy("cid", "key").agg(F.max("w").alias("depth"), F.count("need").alias("open")).filter("open = 0").select("cid", "key", "depth")
        front = cut(done)
        edges = cut(state.join(front.select("cid", "key"), ["cid", "key"], "left_anti").groupBy("cid", "key", "need").agg(F.max("w").alias("w")))
        settled = settled.unionByName(front)
    settled = cut(settled)
    ends = settled.select("cid", F.col("key").alias("ptr"), F.col("depth").alias("d"))
    jumped = jumps.join(ends, ["cid", "ptr"]).select("cid", "key", (F.col("d") + F.col("w")).alias("depth"))
    return calls.select("cid", "key").join(settled.unionByName(jumped), ["cid", "key"], "left").withColumn("depth", F.coalesce("depth", F.lit(-1)))


def format_chat(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per event: conv_id, turn, place, part, kind, call_id, linked, problems, json.

    ``turns`` has conv_id, turn, role, text.  kind is message, call or result.
    place is 0 for messages and 2 * depth + 1 for calls, 2 * depth + 2 for
    their results, which stand at the turn of their call; part tells the calls
    of a turn apart.  linked says whether a call has a result or a result a
    call; a result without call stays at its own turn.  Of several results or
    calls with one identifier in a conversation the earliest counts (of one
    turn, that of the least digest), others are unlinked and name it in
    problems.  Turns without conv_id are a conversation of their own.  Null
    texts are empty contents, null roles "user".  Texts that are no such JSON
    are plain content.  Calls without id are unlinked and say so in problems.
    Repeated rows give repeated events; other columns are not read.  Without
    ``schemas`` arguments are only checked to be JSON.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # only texts that can be objects are parsed; keys may be escaped or on any line
    parsed = F.when(text.rlike(r"^\s*\{"), F.from_json(text, TURN))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"), parsed.alias("p"))
    # no identifier is one like any other
    rows = rows.withColumn("cid", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    calls_in = F.coalesce(F.size(F.filter("p.tool_calls", lambda c: c.isNotNull())), F.lit(0))
    kind = F.when((F.col("role") == "tool") & F.col("p.tool_call_id").isNotNull(), "result").when(calls_in > 0, "calls").otherwise("message")
    rows = rows.withColumn("kind", kind)
    none = F.array().cast("array<string>")
    plain = rows.filter((F.col("kind") == "message") | ((F.col("kind") == "calls") & (F.coalesce("p.content", F.lit("")) != "")))
    content = F.when(F.col("kind") == "calls", F.col("p.content")).otherwise(F.col("text"))
    zero = F.lit(0).cast("long")
    messages = plain.select("conv_id", "turn", zero.alias("place"), F.lit(0).alias("part"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("boolean").alias("linked"), none.alias("problems"), F.to_json(F.struct(content.alias("content"), F.col("role"))).alias("json"))
    made = rows.filter("kind = 'calls'").select("cid", "conv_id", "turn", F.posexplode("p.tool_calls").alias("part", "c")).filter("c is not null")
    # a key of its own for every call: its identifier or, without one, its place
    key = F.coalesce(F.concat(F.lit("i"), F.col("c.id")), F.concat_ws(":", F.lit("n"), "turn", "part"))
    needs = F.transform(F.coalesce("c.after", none), lambda x: F.concat(F.lit("i"), x))
    made = made.select("cid", "conv_id", "turn", "part", F.col("c.id").alias("call_id"), key.alias("key"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"), needs.alias("after"))
    args = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    line = F.concat(F.lit('{"arguments":'), args, F.lit(","), F.expr("substring(to_json(struct(call_id AS id, coalesce(name, '') AS name, 'assistant' AS role)), 2)"))
    made = cut(made.withColumn("line", line).withColumn("mark", F.md5(F.col("line").cast("binary"))))
    given = rows.filter("kind = 'result'").select("cid", "conv_id", "turn", F.col("p.tool_call_id").alias("call_id"), F.concat(F.lit("i"), "p.tool_call_id").alias("key"), F.coalesce("p.content", F.lit("")).alias("content"))
    given = cut(given.withColumn("mark", F.md5(F.col("content").cast("binary"))))
    first_call = cut(made.groupBy("cid", "key").agg(F.min(F.struct("turn", "part", "mark", "after")).alias("at")))
    first_result = given.groupBy("cid", "key").agg(F.min(F.struct("turn", "mark")).alias("got"))
    depth = _depths(first_call.select("cid", "key", F.col("at.after").alias("after")))
    links = cut(first_call.select("cid", "key", F.struct("at.turn", "at.part", "at.mark").alias("at")).join(first_result, ["cid", "key"], "full").join(depth, ["cid", "key"], "left"))

    def same(struct: str, *names: str) -> Column:
        out = F.col(struct).isNotNull()
        for name in names:
            out = out & F.col(name).eqNullSafe(F.col(f"{struct}.{name}"))
        return out

    c = made.join(links, ["cid", "key"])
    first, identified = same("at", "turn", "part", "mark"), F.col("call_id").isNotNull()
    problems = violations(F.col("name"), F.col("arguments"), schemas) if schemas else none
    problems = F.concat(problems, F.when(~identified, F.array(F.lit("no id"))).otherwise(none), F.when(~first & identified, F.array(F.lit("repeated id"))).otherwise(none), F.when(F.col("depth") < 0, F.array(F.lit("cycle"))).otherwise(none), F.when(canonical(F.col("arguments")).isNull(), F.array(F.lit("no JSON"))).otherwise(none))
    place = 2 * F.greatest("depth", zero)
    calls = c.select("conv_id", "turn", (place + 1).alias("place"), "part", F.lit("call").alias("kind"), "call_id", (first & identified & F.col("got").isNotNull()).alias("linked"), problems.alias("problems"), F.col("line").alias("json"))
    r = given.join(links, ["cid", "key"])
    called, earliest = F.col("at").isNotNull(), same("got", "turn", "mark")
    ok = called & earliest
    why = F.concat(F.when(~called, F.array(F.lit("no call"))).otherwise(none), F.when(~earliest, F.array(F.lit("repeated id"))).otherwise(none))
    results = r.select("conv_id", F.when(ok, F.col("at.turn")).otherwise(F.col("turn")).alias("turn"), F.when(ok, place + 2).otherwise(zero).alias("place"), F.when(ok, F.col("at.part")).otherwise(F.lit(0)).alias("part"), F.lit("result").alias("kind"), "call_id", ok.alias("linked"), why.alias("problems"), F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("json"))
    return messages.unionByName(calls).unionByName(results)


def turns_as_calls(turns: DataFrame) -> DataFrame:
    """Plain turns as an exchange with a tool: (conv_id, turn, role, text).

    What a user says at turn t is the call ``q<t>``, to ``ask`` if it is one
    line, to ``tell`` if it is several, and to ``shout``, which has no schema,
    if it has capitals and no small letters.  Its arguments are the whole text,
    its number of words (left out if there are none), that of lines if several,
    and its size.  It needs the result of what was said two turns before.  An
    assistant's turn t is the result of ``q<t - 1>``.  Other turns stay as they
    are, null roles count as users' and null texts as empty.
    """
    text, words = F.coalesce("text", F.lit("")), word_count(F.col("text"))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    name = F.when((text == F.upper(text)) & (text != F.lower(text)), "shout").when(lines > 1, "tell").otherwise("ask")
    size = F.when(words < 20, "short").when(words < 100, "medium").when(words < 500, "long").otherwise("huge")
    arguments = F.struct(F.when(lines > 1, lines).alias("lines"), size.alias("size"), text.alias("text"), F.when(words > 0, words).alias("words"))

    def q(turn: Column) -> Column:
        return F.concat(F.lit("q"), turn.cast("string"))

    call = F.to_json(F.struct(F.array(F.struct(q(F.col("turn")).alias("id"), name.alias("name"), arguments.alias("arguments"), F.array(q(F.col("turn") - 2)).alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(text.alias("content"), q(F.col("turn") - 1).alias("tool_call_id")))
    role = F.coalesce("role", F.lit("user"))
    return turns.select("conv_id", "turn", F.when(role == "assistant", "tool").otherwise(role).alias("role"), F.when(role == "user", call).when(role == "assistant", result).otherwise(text).alias("text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as calls and results, checked against ``TOOLS``; problems are parted by commas."""
    events = format_chat(turns_as_calls(table(spark, sf_dir, "conversations")), TOOLS)
    return events.withColumn("problems", F.array_join("problems", ", "))


OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines
  FROM conversations
), c AS (
  SELECT conv_id, turn, 'q' || turn AS call_id, text, words, lines,
         CASE WHEN text = upper(text) AND text <> lower(text) THEN 'shout' WHEN lines > 1 THEN 'tell' ELSE 'ask' END AS name,
         CASE WHEN words < 20 THEN 'short' WHEN words < 100 THEN 'medium' WHEN words < 500 THEN 'long' ELSE 'huge' END AS size
  FROM t WHERE role = 'user'
), l AS (
  SELECT *, '{"arguments":{' || CASE WHEN lines > 1 THEN '"lines":' || lines || ',' ELSE '' END || '"size":"' || size || '","text":' || CAST(to_json(text) AS VARCHAR)
         || CASE WHEN words > 0 THEN ',"words":' || words ELSE '' END || '},"id":"' || call_id || '","name":"' || name || '","role":"assistant"}' AS line
  FROM c
), d AS (
  SELECT DISTINCT conv_id, turn, 0 AS depth FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.turn = c.turn - 2)
  UNION
  SELECT c.conv_id, c.turn, d.depth + 1 FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.turn = d.turn + 2
), r AS (
  SELECT conv_id, turn, text, 'q' || (turn - 1) AS call_id, 'q' || (turn - 1) IN (SELECT c.call_id FROM c WHERE c.conv_id IS NOT DISTINCT FROM t.conv_id) AS called,
         md5(text) = min(md5(text)) OVER (PARTITION BY conv_id, turn) AS earliest
  FROM t WHERE role = 'assistant'
), m AS (
  SELECT l.*, d.depth, md5(line) = min(md5(line)) OVER (PARTITION BY l.conv_id, l.turn) AS earliest,
         EXISTS (SELECT 1 FROM r WHERE r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.call_id = l.call_id) AS answered
  FROM l JOIN d ON d.conv_id IS NOT DISTINCT FROM l.conv_id AND d.turn = l.turn
)
SELECT conv_id, turn, CAST(0 AS BIGINT) AS place, 0 AS part, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BOOLEAN) AS linked, '' AS problems,
       '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json
FROM t WHERE role NOT IN ('user', 'assistant')
UNION ALL
SELECT conv_id, turn, CAST(2 * depth + 1 AS BIGINT), 0, 'call', call_id, earliest AND answered,
       concat_ws(', ', CASE WHEN name = 'shout' THEN 'unknown tool' END, CASE WHEN name = 'ask' AND words = 0 THEN 'missing words' END,
                 CASE WHEN name = 'ask' AND size = 'huge' OR name = 'tell' AND size IN ('huge', 'long') THEN 'value of size' END, CASE WHEN NOT earliest THEN 'repeated id' END),
       line
FROM m
UNION ALL
SELECT r.conv_id, CASE WHEN called AND earliest THEN r.turn - 1 ELSE r.turn END, CASE WHEN called AND earliest THEN CAST(2 * d.depth + 2 AS BIGINT) ELSE 0 END, 0, 'result', call_id, called AND earliest,
       concat_ws(', ', CASE WHEN NOT called THEN 'no call' END, CASE WHEN NOT earliest THEN 'repeated id' END),
       '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"tool","tool_call_id":"' || call_id || '"}'
FROM r LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.turn = r.turn - 1
"""
