"""The first of ordered rules that fits a text, where rules are rows: the plan doesn't grow with them.

Rules are given by their terms, (rule, grp, word, pattern): a rule fits a text
that has a term of each of its groups 1, 2, ... and none of group 0, which
forbids.  ``word`` is contained in the text as it is, or, where ``pattern`` is
true, found in it as a regular expression.  The fitting rule of the least
number wins.  A rule of no group but 0 fits no text; null and empty words are
in no text; rows without a rule or a group are left out, null ``pattern`` is
false.

Rules up to ``MASK_TERMS`` terms become bit sets beside every text: a bit is a
rule, a plane a group, a word the bits that it sets.  Nothing is shuffled.
More rules are joined by their words instead.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.functions.normalize import let
from mulberry.operators.dictionary import contained, walked

#: Terms, and longs of all planes, up to which rules are bit sets.  Words up to which they are looked for one by one; more are an automaton.
MASK_TERMS, MASK_LONGS, WORDS_IN_ARRAY = 20_000, 4_096, 64
#: Rules in a long; its sign and its lowest bit's predecessor stay free of overflow.
_BITS = 62

Term = tuple[int, int, str | None, bool | None]


def _constant(value: object, kind: str) -> Column:
    """One literal, whatever it holds."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}").getField("v")


def _setter(longs: int) -> Callable:
    """What an automaton's walk makes of a text: the longs with the bits that its words set."""

    def each(a: object, effects: dict[str, list[tuple[int, int]]], text: str) -> list[int]:
        out = [0] * longs
        for word in {w for _, w in a.iter(text)}:
            for at, bits in effects[word]:
                out[at] |= bits
        return out

    return each


def _masks(spark: SparkSession, terms: list[Term]) -> Callable[[Column], Column] | None:
    """A function from a text to the number of its first rule, or None where the planes would be too many."""
    groups: dict[int, list[int]] = {}
    for rule, grp, *_ in sorted({t[:2] for t in terms}):
        if grp > 0:
            groups.setdefault(rule, []).append(grp)
    order = sorted(groups)
    if not order:
        return lambda text: F.lit(None).cast("long")
    bit, planes, longs = {r: i for i, r in enumerate(order)}, max(map(len, groups.values())), -(-len(order) // _BITS)
    if longs * (planes + 1) > MASK_LONGS:
        return None

    start = [0] * (longs * (planes + 1))  # the groups that a rule doesn't have are met
    for r in order:
        for plane in range(len(groups[r]), planes):
            start[plane * longs + bit[r] // _BITS] |= 1 << bit[r] % _BITS
    sets: dict[tuple[bool, str], dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for rule, grp, word, pattern in terms:
        if word and rule in bit:
            plane = groups[rule].index(grp) if grp > 0 else planes
            sets[bool(pattern), word][plane * longs + bit[rule] // _BITS] |= 1 << bit[rule] % _BITS
    effects = "array<struct<at:int,bits:bigint>>"
    of = {k: [{"at": a, "bits": b} for a, b in sorted(v.items())] for k, v in sorted(sets.items())}
    words, patterns = [w for p, w in of if not p], [w for p, w in of if p]
    walks = []
    if len(words) > WORDS_IN_ARRAY:
        rows = [(w, (e["at"], e["bits"])) for w in words for e in of[False, w]]
        walks = walked(spark.createDataFrame(rows, "word string, genre struct<at:int,bits:bigint>"), "array<bigint>", _setter(len(start)))

    def first(text: Column) -> Column:
        found, set_ = F.array().cast(effects), _constant(start, "array<bigint>")
        if not walks:
            table = _constant([{"w": w, "e": of[False, w]} for w in words], f"array<struct<w:string,e:{effects}>>")
            found = F.flatten(F.filter(table, lambda k: F.contains(text, k["w"]))["e"])
        for p in patterns:
            found = F.concat(found, F.when(text.rlike(p), _constant(of[True, p], effects)).otherwise(F.array().cast(effects)))
        for walk in walks:
            set_ = F.zip_with(set_, walk(text), lambda x, y: x.bitwiseOR(y))
        set_ = F.aggregate(found, set_, lambda acc, e: F.transform(acc, lambda x, i: F.when(i == e["at"], x.bitwiseOR(e["bits"])).otherwise(x)))

        def least(all_: Column) -> Column:
            def fits(i: Column) -> Column:
                x = F.bitwise_not(F.get(all_, i + planes * longs))
                for plane in range(planes):
                    x = x.bitwiseAND(F.get(all_, i + plane * longs))
                return x

            at = F.transform(F.sequence(F.lit(0), F.lit(longs - 1)), lambda i: let(fits(i), lambda x: F.when(x != 0, i * _BITS + F.bit_count(F.bitwise_not(x).bitwiseAND(x - 1)))))
            return F.get(_constant(order, "array<bigint>"), F.get(F.filter(at, lambda n: n.isNotNull()), 0))

        return let(set_, least)

    return first


def fixed_rule(spark: SparkSession, terms: list[Term]) -> Callable[[Column], Column]:
    """A function from a text to the number of the first rule of ``terms`` that fits; null if none does, or the text is null."""
    found = _masks(spark, terms) if len(terms) <= MASK_TERMS else None
    if not found:
        raise ValueError("so many rules are a table: use first_rule")
    return found


def first_rule(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule): the first rule that fits each text; texts without one, and null texts, have no row.

    ``key`` tells the texts apart.  ``terms`` may have further columns, as may ``texts``.
    """
    spark = texts.sparkSession
    used = terms.select(F.col("rule").cast("long").alias("rule"), F.col("grp").cast("int").alias("grp"), "word", F.coalesce("pattern", F.lit(False)).alias("pattern")).filter("rule is not null and grp is not null").distinct()
    slim = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
    few = [tuple(r) for r in used.limit(MASK_TERMS + 1).collect()]
    masks = _masks(spark, few) if len(few) <= MASK_TERMS else None
    if masks:
        # a filter on what a generator makes isn't pushed below it, where the rules would be tried twice
        return slim.select(F.col("k").alias(key), F.explode_outer(F.array(masks(F.col("t")))).alias("rule")).filter("rule is not null")
    return _joined(slim, used).withColumnRenamed("k", key)


def _joined(slim: DataFrame, used: DataFrame) -> DataFrame:
    """(k, rule) by joins: the words in a text with the terms that ask for them, a row for each rule that a text meets."""
    hits = contained(slim, used.filter("not pattern").select("word").distinct(), "k", "t").distinct().withColumn("pattern", F.lit(False))
    patterns = [r[0] for r in used.filter("pattern and word <> ''").select("word").distinct().collect()]
    if patterns:
        met = F.array_compact(F.array(*[F.when(F.col("t").rlike(p), F.lit(p)) for p in patterns]))
        hits = hits.unionByName(slim.select("k", F.explode(met).alias("word"), F.lit(True).alias("pattern")))
    asked = hits.join(used, ["word", "pattern"]).groupBy("k", "rule").agg(F.count_distinct(F.when(F.col("grp") > 0, F.col("grp"))).alias("met"), F.min("grp").alias("least"))
    needs = used.filter("grp > 0").groupBy("rule").agg(F.count_distinct("grp").alias("needs"))
    return asked.filter("least > 0").join(needs, "rule").filter("met = needs").groupBy("k").agg(F.min("rule").alias("rule"))
