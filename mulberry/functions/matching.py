"""Whether two titles are the same book's: normal forms of platforms' titles, particles, parts of titles."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mulberry.functions.normalize import author_variants, collapse, fuzzy_title, length_gap, let

# Notes beside titles, and the same in parentheses.
_NOTES = "단행본|완결|연재중|개정판|합본|개정|특별판|19N|19n|19금|15금"
_NOTES_IN_PARENTHESES = "완결|연재중|개정판|합본|개정|특별판|완|19금|19|15금|15|19N|19n"
# Substitutions of a platform's title, in order (pattern, replacement).
PLATFORM_TITLE = [
    (r"(?i)^소설\s+", ""),
    (r"\s+[-/|]\s+[가-힣]{2,5}(?:,[가-힣]{2,5})*\s*$", ""),
    (r"\s+제?\d+권\s*$", ""), (r"\s+\d+\s*$", ""), (r"\s+[상중하]\s*$", ""), (r"\s+\(?\s*[상중하]\s*\)?\s*$", ""),
    (r"\s+\[?\s*\d+\s*\]?\s*$", ""), (r"\s+\(?\s*\d+\s*\)?\s*$", ""), (r"\s+[상중하]/[상중하]\s*$", ""),
    (r"([가-힣])제?\d+권$", "$1"), (r"([가-힣])\d+$", "$1"), (r"([가-힣])[상중하]$", "$1"), (r"([가-힣])\(?\s*[상중하]\s*\)?$", "$1"),
    (r"([가-힣])\[?\s*\d+\s*\]?$", "$1"), (r"([가-힣])\(?\s*\d+\s*\)?$", "$1"),
    (r"\s*[-:]\s*조아라\s*[:：].*$", ""), (r"\s*[-:]\s*네이버\s*시리즈.*$", ""),
    (r"\s*[-:]\s*네이버.*$", ""), (r"\s*[-:]\s*문피아.*$", ""), (r"\s*[-:]\s*노벨피아.*$", ""), (r"\s*[-:]\s*카카오페이지.*$", ""), (r"\s*[-:]\s*리디북스.*$", ""),
    (rf"(?i)^\s*\[({_NOTES})\]\s*", ""), (rf"(?i)^\s*\(({_NOTES})\)\s*", ""), (rf"(?i)\s*\[({_NOTES})\]\s*$", ""), (rf"(?i)\s*\(({_NOTES_IN_PARENTHESES})\)\s*$", ""),
    (r"\s*[(\[]?\s*(외전|증보판|개정판|합본|특별판|완전판|무삭제판|리마스터판)\s*[)\]]?\s*", " "),
    (r"(?i)\s*[-]\s*(BL|GL)\s*(소설|웹소설|e북|전자책)?\s*", " "), (r"(?i)\s*(BL|GL)\s*(소설|웹소설|e북|전자책)\s*", " "), (r"(?i)\s*(e북|웹소설|전자책)\s*", " "),
    (r"^\s*\[[^\]]+\]\s*", ""), (r"[(\[{【]([^)\]}】]+)[)\]}】]", ""), (r"\s*\([^)]+\)\s*$", ""),
    (r"(?i)(Ver|V)\s+(\d+(?:\.\d+)?)", "$1$2"),
    (r"([가-힣])\s+(?!Ver|ver|V|v\d)[a-zA-Z]+(?:\s+[a-zA-Z]+)*(?:\s|[-:;,.]|$)", "$1 "),
    (r"[^\w\s가-힣]", ""), (r"\s+", ""),
]
# Particles, longest first.
PARTICLES = ["으로", "에서", "에게", "한테", "부터", "까지", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "로", "도", "만"]
# What follows a dash without being an author, and what stands in parentheses without being a subtitle.
_NO_AUTHORS = ["외전", "전기", "서", "편", "기", "록", "상권", "하권", "중권"]
_NO_SUBTITLES = ["완결", "완", "단행본", "연재중", "개정판", "합본", "특별판", "19금", "15금", "19N", "19n"]


def platform_title(title: Column) -> Column:
    """The normal form in which titles of different platforms compare."""
    t = F.translate(title, "？！～（）【】ː˙‧：；", "?!~()[]:.·:;")
    for pattern, by in PLATFORM_TITLE:
        t = F.regexp_replace(t, f"(?U){pattern}", by)
    return F.lower(t)


def _without_suffixes(title: Column) -> Column:
    for words in ("판타지|로맨스|무협|BL|GL", "웹소설|e북|전자책|소설", "리디|조아라|문피아|노벨피아|카카오페이지|네이버"):
        title = F.regexp_replace(title, rf"(?iU)\s*[-:]\s*({words}).*$", "")
    return F.replace(F.trim(title), F.lit(" "), F.lit(""))


def particle_only(a: Column, b: Column) -> Column:
    """True if the titles differ by one particle inside Hangul; of the same length, if they are equal without spaces."""

    def differ(longer: Column, shorter: Column) -> Column:
        tests = []
        for p in PARTICLES:
            at = F.instr(longer, p)  # the first one only
            rest = F.concat(F.substring(longer, F.lit(1), at - 1), F.substring(longer, at + len(p), F.length(longer)))
            before, after = F.substring(longer, at - 1, F.lit(1)), F.substring(longer, at + len(p), F.lit(1))
            tests.append((at > 1) & (rest == shorter) & before.rlike("[가-힣]") & ((after == "") | after.rlike("[가-힣]")))
        gap = F.length(longer) - F.length(shorter)
        return F.when(gap == 0, longer == shorter).when(gap > 2, False).otherwise(F.array_contains(F.array(*tests), True))

    # titles are cleaned once, however often the tests look at them
    both = F.struct(_without_suffixes(a).alias("x"), _without_suffixes(b).alias("y"))
    by_length = let(both, lambda t: F.when(F.length(t["x"]) > F.length(t["y"]), F.struct(t["x"].alias("longer"), t["y"].alias("shorter"))).otherwise(F.struct(t["y"].alias("longer"), t["x"].alias("shorter"))))
    return let(by_length, lambda t: differ(t["longer"], t["shorter"]))


def same_title(search: Column, page: Column, text: Column, author: Column, strict: bool = True) -> Column:
    """Whether a page's title is the searched one: but for a particle, equal, or contained with little besides; short titles need the author on the page."""

    def compared(s: Column, p: Column) -> Column:
        inside = p.contains(s) | s.contains(p)
        by = F.exists(author_variants(author), lambda v: text.contains(v))
        short = (F.length(s) <= 6) & F.lit(strict)
        return F.when(s == p, True).when((s == "") | (p == ""), False).when(short, inside & F.coalesce(by, F.lit(False))).otherwise(inside & (length_gap(s, p) <= 0.3))

    # each title is brought to its normal form once
    both = F.struct(platform_title(search).alias("s"), platform_title(page).alias("p"))
    return F.when(particle_only(search, page), True).otherwise(let(both, lambda t: compared(t["s"], t["p"])))


# Authors after a dash, several and one; a part with its name; names in parentheses, joined and apart; what a main title loses.
_SEVERAL, _SINGLE = r"\s+[-/]\s+([가-힣]{2,5}(?:\s*[,&]\s*[가-힣]{2,5})+)\s*(?:\(완\))?$", r"\s+[-/]\s+([가-힣]{2,5})\s*(?:\(완\))?$"
_PART, _JOINED, _APART = r"^(.+?)\s+(\d+부)\s+(.+)$", r"([가-힣a-zA-Z0-9]+)\(([가-힣a-zA-Z0-9\s]+)\)\s*$", r"\s+\(([가-힣a-zA-Z0-9\s]+)\)\s*$"
_LOST = [(r"\s+\d+[-~]\d+\s*화", ""), (r"\s+\d+[-~]\d+\s*\(완\)", ""), (r"\s+\d+화(?=\s|$)", ""), (r"\s*[\[(](19[Nn]|완결|완|단행본|연재중|개정판|합본|특별판|19금|15금)[\])]\s*", " ")]


def title_parts(title: Column) -> Column:
    """struct(main_title, subtitle, author) of a title: an author after a dash, a part with its name, a name in brackets."""
    t = title
    several, single, part, joined, apart = _SEVERAL, _SINGLE, _PART, _JOINED, _APART
    lone = F.regexp_extract(t, single, 1)
    author = F.when(t.rlike(several), F.trim(F.regexp_replace(F.regexp_extract(t, several, 1), r"\s*([,&])\s*", "$1 "))).when(t.rlike(single) & ~lone.isin(_NO_AUTHORS), lone)
    bare = F.when(t.rlike(several), F.regexp_replace(t, several, "")).when(author.isNotNull(), F.regexp_replace(t, single, "")).otherwise(t)
    inner = F.trim(F.regexp_extract(bare, joined, 2))
    sub = F.when(bare.rlike(part), F.concat(F.regexp_extract(bare, part, 2), F.lit(" "), F.trim(F.regexp_extract(bare, part, 3)))).when(bare.rlike(joined) & ~inner.isin(_NO_SUBTITLES), inner)
    main = F.when(bare.rlike(part), F.trim(F.regexp_extract(bare, part, 1))).when(bare.rlike(joined) & ~inner.isin(_NO_SUBTITLES), F.regexp_replace(bare, joined, "$1")).when(bare.rlike(joined), bare).otherwise(F.regexp_replace(bare, apart, ""))
    for pattern, by in _LOST:
        main = F.regexp_replace(main, pattern, by)
    return F.struct(collapse(main).alias("main_title"), sub.alias("subtitle"), author.alias("author"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """Matching blocks' share of both titles' letters; equal titles don't go to Python's helper."""
    x, y = fuzzy_title(a), fuzzy_title(b)
    return F.when(x == y, 1.0).otherwise(_ratio(F.when(x != y, x), F.when(x != y, y)))


def is_fuzzy_match(a: Column, b: Column, bar: float = 0.85) -> Column:
    return fuzzy_ratio(a, b) >= bar
