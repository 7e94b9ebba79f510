"""Ordered rules on names as data: every rule is a row, and all rows of a table become one expression that Catalyst runs.

A rule looks at the text that the rules before it left.  Kinds of rules:

* ``rewrite``: the pattern is replaced wherever it is.
* ``label``: where the pattern is, labels are noted, and it is replaced.
* ``numbers``: for each place of the pattern a label with the group's numbers is noted.
* ``range``: unless a range is known, the first place of the pattern gives one, of two groups or from 1 to one; it alone is replaced.
* ``part``: from here on rules for names with parts apply if the pattern is there, else those for others.
* ``end``: no rule after this one applies, if what it asks for holds.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from mulberry.functions.normalize import collapse, let


class Rule(NamedTuple):
    kind: str
    pattern: str
    by: str = ""
    what: tuple[str, ...] = ()
    only: str = ""  # "part": names with parts; "whole": names without; "ranged": where a range is known


# Symbols of names of files made standard, in order.
SYMBOLS = [
    Rule("rewrite", r"(\d+-\d+),(\d+부)", "$1§§COMMA§§$2"),
    Rule("rewrite", r"(\d+)부_(\d+부)", "$1-$2"),
    Rule("rewrite", r"(\d+)_(\d+부)", "$1-$2"),
    Rule("rewrite", r"(\d+)_(\d+)", "$1-$2"),
    Rule("rewrite", r"(\d+)(회|화|편|권)~(\d+)(회|화|편|권)", "$1$2-$3$4"),
    Rule("rewrite", r"\(\s+", "("),
    Rule("rewrite", r"\s+\)", ")"),
    # a plus within (19N) or (18+) stays
    Rule("rewrite", r"(?<!\(\d{1,18}[A-Z+]{0,18})\+|\+(?![A-Z+]*\))", " "),
    Rule("rewrite", "_", " "),
    Rule("rewrite", r"\(~(\d+)\)", "1-$1"),
    Rule("rewrite", r"~([^~]+)~", "- $1"),
    Rule("rewrite", "~", "-"),
    Rule("rewrite", r"(\d+)-\.(\d+)", "$1-$2"),
    Rule("rewrite", r"(\d+)(?:\s*,\s*\d+)+\s*,\s*(\d+)\s*부", "$1-$2부"),
    Rule("rewrite", r"(?<!-\d{1,4})(\d+)\s*,\s*(\d+부)", "$1-$2"),
    Rule("rewrite", r"(\d+)\s*-\s+(\d+부)", "$1-$2"),
    Rule("rewrite", r"(\d+)\s*-\s*(\d+)", "$1-$2"),
    Rule("rewrite", r"([가-힣a-zA-Z])(\d+부)", "$1 $2"),
    Rule("rewrite", r"([가-힣a-zA-Z])(\d+\s*-\s*\d+)", "$1 $2"),
    Rule("rewrite", r"(\d+)\(완\)", "$1 (완)"),
    Rule("rewrite", r"([가-힣a-zA-Z])\(완\)", "$1 (완)"),
    Rule("rewrite", r"\b外\b", "외전"),
]

_NUMBERS, _UNITS = r"(\d{1,4}(?:-\d{1,4})?)", r"\b(화|권|편|회)\b"
# Ranges and side stories in names of files, in order.
RANGES = [
    Rule("rewrite", "§§COMMA§§", ","),
    Rule("label", r"(?i)\[에필로그후기\]", "", ("에필", "후기")),
    Rule("label", r"(?i)\[외전후기\]", "", ("외전", "후기")),
    Rule("numbers", r"(?i)\[외전(\d{1,4}-\d{1,4})화?미완?\]", " ", ("외전",)),
    Rule("label", r"\[외전\]", "", ("외전",)),
    Rule("label", r"\[(에필로그|에필)\]", "", ("에필",)),
    Rule("label", r"\[후기\]", "", ("후기",)),
    Rule("label", r"\b(에필로그후기|에필후기)\b", "", ("에필", "후기")),
    Rule("label", r"\b외전후기\b", "", ("외전", "후기")),
    Rule("numbers", r"(?:에필로그|에필)\s*" + _NUMBERS, " ", ("에필",)),
    Rule("range", r"(\d{1,4})-(\d{2,})(\d)\s*,\s*(\d)부", " $3-$4부 ", ("1", "2")),
    Rule("range", r"(\d{1,4})\s*-\s*(\d{1,4})\s*(?:화|권|편|회)\s+(\d{1,4}부)", " $3 ", ("1", "2")),
    Rule("rewrite", r"(\d{1,4})부\s+(\d{1,4})부", "$1-$2부"),
    Rule("range", r"(\d{1,4})\s*-\s*(\d{1,4})\s+(\d{1,4})\s*-\s*(\d{1,4})부", " $3-$4부 ", ("1", "2")),
    Rule("part", r"\d{1,4}(?:-\d{1,4})?\s*부\b"),
    # names with parts: the parts stay in the name
    Rule("range", r"(?<!시즌\s{0,9})(\d{1,4})\s*-\s*(\d{1,4})(?!\s*부)", " ", ("1", "2"), "part"),
    Rule("range", r"-(\d{1,4})\b(?!부)", " ", ("1",), "part"),
    Rule("range", r"(?<![\w-])(?!0\d{0,2}\b)(\d{1,4})(?:\s*(?:화|권|편|회))?\b(?!\s*부\b)(?!\s*-\s*\d+\s*부\b)", "", ("1",), "part"),
    Rule("rewrite", _UNITS, "", (), "part ranged"),
    Rule("numbers", r"(?:^|(?<=[^가-힣]))외전\s*" + _NUMBERS + r"(?!\s*부)", " ", ("외전",), "part"),
    Rule("numbers", _NUMBERS + r"\s*외전(?![가-힣])", " ", ("외전",), "part"),
    Rule("label", r"외전포함|\b외전\b", "", ("외전",), "part"),
    Rule("label", r"\b후기\b", "", ("후기",), "part"),
    Rule("label", r"\b(에필로그|에필)\b", "", ("에필",), "part"),
    Rule("label", r"\b특외\b", "", ("특외",), "part"),
    Rule("label", r"\b특별편\b", "", ("특별편",), "part"),
    Rule("end", "", only="part"),
    # names without
    Rule("range", r"\[(\d{1,4})\s*-\s*(\d{1,4})\]", "", ("1", "2")),
    Rule("range", r"\((\d{1,4})(?:회|화|편|권)-(\d{1,4})(?:회|화|편|권)\)", "", ("1", "2")),
    Rule("range", r"\((\d{1,4})-(\d{1,4})\)", "", ("1", "2")),
    Rule("label", r"\d{1,4}\s*-\s*외전\b", " ", ("외전",)),
    Rule("range", r"(\d{1,4})권\s*-\s*(\d{1,4})권", " ", ("1", "2")),
    Rule("range", r"(?<=[가-힣a-zA-Z].{0,200})\s+-(\d{1,4})\b(?!레벨|살|세|년|대|층|급|단|차|기)", " ", ("1",)),
    Rule("range", r"(\d{1,4})(?:회|화|편|권)\s*-\s*(\d{1,4})(?:회|화|편|권)", "", ("1", "2")),
    Rule("range", r"(?<!시즌\s{0,9})(\d{1,4})\s*-\s*(\d{1,4})(?:\s*(?:화|권|편|회))?(?![가-힣\d])", " ", ("1", "2")),
    # a single number, unless it starts with zeros, is a year, is parted by commas or leads up to the name
    Rule("range", r"(?<![\w,])(?!0\d{0,2}\b)(?!(?:1[89]\d\d|20\d\d)\b)(?<=[가-힣a-zA-Z].{0,200}|(?=\d{1,4}\s*(?:화|권|편|회)?\s*(?![가-힣\s])))(\d{1,4})(?:\s*(?:화|권|편|회))?\b(?!,\d)", "", ("1",)),
    Rule("rewrite", _UNITS, "", (), "ranged"),
    Rule("rewrite", r"(?i)\b미완\b", ""),
    Rule("numbers", r"외전\s*" + _NUMBERS + r"(?:\s*(?:화|장))?(?!\s*부)", " ", ("외전",)),
    Rule("numbers", _NUMBERS + r"\s*(?:화|장)?\s*외전(?=\s|,|$)", " ", ("외전",)),
    Rule("numbers", r"특외(\d{1,4})화?", " ", ("특외",)),
    Rule("label", r"\b특외\b", "", ("특외",)),
    Rule("label", r"\b특별편\b", "", ("특별편",)),
    Rule("numbers", r"(?<!귀환)후일담\s*" + _NUMBERS, " ", ("후일담",)),
    Rule("label", r",\s*후일담\b|\b후일담\s*,|\b후일담\b", "", ("후일담",)),
    Rule("label", r"\b번외\b", "", ("번외",)),
    Rule("label", "인랑전", "", ("인랑전",)),
    Rule("label", "귀환후일담", "", ("귀환후일담",)),
    Rule("label", "추가외전", "", ("외전", "추가외전")),
    Rule("label", r"외전포함|,\s*외전\b(?!\s*\d)|\b외전\s*,|\b외전\b(?!\s*\d)", "", ("외전",)),
    Rule("label", r",\s*후기\b|\b후기\s*,|\b후기\b", "", ("후기",)),
    Rule("label", r",\s*(?:에필로그|에필)\b|\b(?:에필로그|에필)\s*,|\b(?:에필로그|에필)\b", "", ("에필",)),
]


def _number(c: Column) -> Column:
    return F.regexp_replace(c, r"^0+(?=\d)", "")


def _applied(s: Column, rule: Rule) -> Column:
    """The state after a rule: struct(text, range_info, extras, part, ended)."""
    pattern = f"(?U){rule.pattern}"
    active = ~s["ended"]
    for condition in rule.only.split():
        active = active & {"part": s["part"], "ranged": s["range_info"].isNotNull()}[condition]

    def state(**new: Column) -> Column:
        return F.struct(*[new.get(n, s[n]).alias(n) for n in ("text", "range_info", "extras", "part", "ended")])

    if rule.kind == "end":
        return F.when(active, state(ended=F.lit(True))).otherwise(s)
    if rule.kind == "part":
        return state(part=s["text"].rlike(pattern))
    replaced = F.regexp_replace(s["text"], pattern, rule.by)
    if rule.kind == "rewrite":
        return F.when(active, state(text=replaced)).otherwise(s)
    active = active & s["text"].rlike(pattern)
    if rule.kind == "label":
        return F.when(active, state(text=replaced, extras=F.array_union(s["extras"], F.array(*map(F.lit, rule.what))))).otherwise(s)
    if rule.kind == "numbers":
        found = F.transform(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(1)), lambda n: F.concat(F.lit(f"{rule.what[0]} "), F.array_join(F.transform(F.split(n, "-"), _number), "-")))
        return F.when(active, state(text=replaced, extras=F.array_union(s["extras"], found))).otherwise(s)
    ends = [_number(F.regexp_extract(s["text"], pattern, int(g))) for g in rule.what]
    told = F.concat(ends[0] if len(ends) > 1 else F.lit("1"), F.lit("-"), ends[-1])
    parts = F.split(s["text"], pattern, 2)  # around the first place alone
    by = [F.regexp_extract(s["text"], pattern, int(x)) if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\$(\d)", rule.by))]
    first = F.concat(F.get(parts, F.lit(0)), *by, F.get(parts, F.lit(1)))
    return F.when(active & s["range_info"].isNull(), state(text=first, range_info=told)).otherwise(s)


def applied(text: Column, rules: list[Rule]) -> Column:
    """struct(text, range_info, extras, part, ended) after all rules, in order; all null for null."""
    start = F.struct(text.alias("text"), F.lit(None).cast("string").alias("range_info"), F.array().cast("array<string>").alias("extras"), F.lit(False).alias("part"), F.lit(False).alias("ended"))
    state = F.when(text.isNotNull(), start)
    for rule in rules:
        state = let(state, lambda s, rule=rule: _applied(s, rule))
    return state


def standard_symbols(name: Column) -> Column:
    """A file's name with its symbols made standard: ranges with hyphens, parts and ranges apart from words."""
    for rule in SYMBOLS:
        name = F.regexp_replace(name, f"(?U){rule.pattern}", rule.by)
    return collapse(name)


def range_and_extras(name: Column, rules: list[Rule] = RANGES) -> Column:
    """struct(title, range_info, extras) of a name whose symbols are standard: its range of chapters, its side stories, and what is left."""
    return let(applied(name, rules), lambda s: F.struct(collapse(s["text"]).alias("title"), s["range_info"].alias("range_info"), s["extras"].alias("extras")))
