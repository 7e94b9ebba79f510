"""Titles and what goes with them, parsed out of messy file names: DataFrame -> DataFrame, by regular expressions in the JVM.

Order matters throughout; every step sees what the one before left over.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mulberry.functions import vocab as V
from mulberry.functions.normalize import collapse, split_suffix, strip_zeros, tag_genre

_COMPLETED = "|".join(V.COMPLETION)
_SIDE = "|".join(V.SIDE_WORDS)
_UNIT = "[화권부편회장]"
_DONE = r"(?:완|完|\(완\)|\(完\))"
#: The places where a title may end; the earliest wins, and of those at one place the first.
_ENDS = [
    rf"\s+\d+\s*{_UNIT}(?:\s|$)",
    r"\s+\d+\s*[-~]\s*\d+",
    rf"\s+\d+(?=\s*(?:完|완|\(완\)|\(完\)|\s*{_UNIT}(?:\s|$|完|완|\(완\)|\(完\))|\s*\d+\s*{_UNIT}(?:\s|$|完|완|\(완\)|\(完\))|\s*$))",
    r"\.?\s*[\(\[]\s*완(?:결)?\s*[\)\]]\.?\s*$",
    rf"(?i:{_COMPLETED})",
]


def _has(c: Column, p: str, flags: str = "U") -> Column:
    return c.rlike(f"(?{flags}){p}")


def _first(c: Column, p: str, flags: str = "U", group: int = 0) -> Column:
    return F.regexp_extract(c, f"(?{flags}){p}", group)


def _all_gone(c: Column, p: str, by: str = "", flags: str = "U") -> Column:
    return F.regexp_replace(c, f"(?{flags}){p}", by)


def _first_gone(c: Column, p: str, by: str = "", flags: str = "U") -> Column:
    return F.regexp_replace(c, f"(?s{flags})^(.*?)(?:{p})", f"$1{by}")


def _before(c: Column, p: str, flags: str = "U") -> Column:
    """What stands before the first match; null without one."""
    return F.when(_has(c, p, flags), F.regexp_extract(c, f"(?s{flags})^(.*?)(?:{p})", 1))


def _tags(words: list[str]) -> str:
    inner = "|".join(words)
    return rf"\[(?:{inner})\]|\((?:{inner})\)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _compose(text: str) -> str:
    """Letters that stand for jamo beside Hangul, then jamo, to syllables until nothing changes."""

    def hangul(c: str) -> bool:
        return "ㄱ" <= c <= "ㆎ" or "가" <= c <= "힣"

    def latin(c: str) -> bool:
        return c.isascii() and c.isalpha()

    s = list(text)
    for i, c in enumerate(s):
        around = [*s[max(i - 1, 0) : i], *s[i + 1 : i + 2]]
        if c in V.LOOKALIKE_JAMO and not any(map(latin, around)) and any(map(hangul, around)):
            s[i] = V.LOOKALIKE_JAMO[c]

    def joined(i: int) -> str | None:
        a, b = s[i], s[i + 1]
        if a in V.INITIALS and b in V.MEDIALS:
            return chr(0xAC00 + 588 * V.INITIALS.index(a) + 28 * V.MEDIALS.index(b))
        code = ord(a) - 0xAC00
        if not 0 <= code < 11172 or code % 28:
            return None
        if b in V.FINALS:  # before a vowel it begins the next syllable
            return None if i + 2 < len(s) and s[i + 2] in V.MEDIALS else chr(ord(a) + V.FINALS.index(b) + 1)
        vowel = V.VOWEL_PAIRS.get(V.MEDIALS[code // 28 % 21] + b)
        return vowel and chr(ord(a) + 28 * (V.MEDIALS.index(vowel) - code // 28 % 21))

    while found := next(((i, c) for i in range(len(s) - 1) if (c := joined(i))), None):
        s[found[0] : found[0] + 2] = [found[1]]
    return "".join(s)


@F.pandas_udf(StringType())
def _compose_udf(names: pd.Series) -> pd.Series:
    return names.map(_compose, na_action="ignore")


def repair_jamo(name: Column) -> Column:
    """Visual jamo made syllables again; names that can't hold any don't go to Python's helper."""
    letters = "".join(V.LOOKALIKE_JAMO)
    may = name.rlike(f"[ㄱ-ㆎ]|[가-힣][{letters}]|[{letters}][가-힣]")
    return F.coalesce(_compose_udf(F.when(may, name)), name)


def side_label(c: Column) -> Column:
    """One word for each kind of side story."""
    c = _all_gone(c, r"^\s*\+\s*")
    for word in ("番外", "번외편", "번외", "외포", "外"):
        c = F.replace(c, F.lit(word), F.lit("외전"))
    return _strip(F.replace(c, F.lit("에필로그"), F.lit("에필")))


def _tagged(df: DataFrame, name: str) -> DataFrame:
    """Noise, genre and edition tags: adds original_genre and edition_info, leaves the rest in ``name``."""
    n = F.col(name)
    df = df.withColumn(name, _all_gone(n, "|".join(V.NOISE), flags="iU"))
    translated = r"\[([가-힣\s]+?)\s*(?:[Aa][Iㅣl]?번역|AI번역|기계번역|손번역|번역)\]"
    df = df.withColumn("original_genre", F.when(_has(n, translated, "iU"), tag_genre(_first(n, translated, "iU", 1))).otherwise(""))
    df = df.withColumn(name, _first_gone(n, translated, flags="iU"))
    tags = _tags(V.TAG_WORDS)
    plain = (F.col("original_genre") == "") & _has(n, tags, "iU")
    df = df.withColumn("_plain", plain)
    df = df.withColumn("original_genre", F.when(F.col("_plain"), F.regexp_replace(_first(n, tags, "iU"), r"[\[\]()]", "")).otherwise(F.col("original_genre")))
    df = df.withColumn(name, F.when(F.col("_plain"), _all_gone(n, tags, flags="iU")).otherwise(n))
    editions = _tags(V.EDITION_WORDS)
    df = df.withColumn("edition_info", _first(n, editions, "iU"))
    df = df.withColumn(name, F.regexp_replace(n, rf"(?siU)^(.*?)\s*(?:{editions})\s*", "$1 "))
    adult = "|".join(rf"\(\s*{w}\s*\)|\[\s*{w}\s*\]" for w in V.ADULT_WORDS)
    df = df.withColumn(name, collapse(_all_gone(_all_gone(n, adult, flags="iU"), "|".join(V.PLATFORM_TAGS), flags="iU")))
    return df.drop("_plain")


def _anchored(df: DataFrame, name: str) -> DataFrame:
    """Where the title ends: adds title and _rest."""
    n = F.col(name)
    chinese = ~_has(n, r"\+\s*(?:외전|에필|번외|특별편)") & ~_has(n, "|".join(V.CHINESE_EXCEPTIONS)) & _has(n, rf"^[가-힣]+(?:{'|'.join(V.CHINESE_ENDINGS)})(?:\s+\d|\s*$)")
    forms = [rf"([가-힣\s]+{e})(\s+.*)$" for e in V.CHINESE_ENDINGS]
    t, r = F, F
    for f in forms:
        t, r = t.when(_has(n, f), _strip(_first(n, f, group=1))), r.when(_has(n, f), _strip(_first(n, f, group=2)))
    df = df.withColumn("_ct", F.when(chinese, t.otherwise(None))).withColumn("_cr", F.when(chinese, r.otherwise(None)))
    plus = r"\s+\+\s+(?:외전|에필|번외|특별편|番外)[\s\d\-~,]*"
    df = df.withColumn("_main", F.coalesce(_strip(_before(n, plus)), n))
    df = df.withColumn("_side", F.when(_has(n, plus), _strip(F.substring(n, F.length(_before(n, plus)) + 1, F.length(n)))).otherwise(""))
    m = F.col("_main")
    places = F.array(*[F.when(_has(m, p), F.struct(F.length(_before(m, p)).alias("at"), F.lit(i).alias("kind"))) for i, p in enumerate(_ENDS)])
    df = df.withColumn("_end", F.array_min(F.array_compact(places)))
    head = _strip(F.substring(m, F.lit(1), F.col("_end.at")))
    head = F.when(F.col("_end.kind") == 3, F.regexp_replace(head, r"\.+$", "")).otherwise(head)
    rest = _strip(F.substring(m, F.col("_end.at") + 1, F.length(m)))
    general, left = F.coalesce(head, _strip(m)), _strip(F.concat_ws(" ", F.coalesce(rest, F.lit("")), "_side"))
    df = df.withColumn("title", F.coalesce("_ct", general)).withColumn("_rest", F.when(F.col("_ct").isNotNull(), F.col("_cr")).otherwise(left))
    return df.drop("_ct", "_cr", "_main", "_side", "_end")


def _sides(df: DataFrame, pattern: str) -> DataFrame:
    """Take side stories out of _rest, from left to right, until none is left; new labels join _sides."""
    text, p = F.col("_rest"), pattern

    def step(acc: Column, _: Column) -> Column:
        hit = acc["r"].rlike(f"(?iU){p}")
        label = side_label(F.regexp_extract(acc["r"], f"(?iU){p}", 0))
        new = F.when(hit & (label != "") & ~F.array_contains(acc["s"], label), F.array_append(acc["s"], label)).otherwise(acc["s"])
        return F.struct(F.regexp_replace(acc["r"], f"(?siU)^(.*?)(?:{p})", "$1 ").alias("r"), new.alias("s"))

    # every round takes one of the words
    rounds = F.sequence(F.lit(0), F.regexp_count(text, F.lit(f"(?i){_SIDE}")))
    df = df.withColumn("_acc", F.aggregate(rounds, F.struct(text.alias("r"), F.col("_sides").alias("s")), step))
    return df.withColumn("_rest", F.col("_acc.r")).withColumn("_sides", F.col("_acc.s")).drop("_acc")


def _residual(df: DataFrame) -> DataFrame:
    """Adds author, volume_info, range_info, is_completed, side_story from what follows the title."""
    r = F.col("_rest")
    none = F.array().cast("array<string>")
    author = r"\s+[-–—]\s+([^-–—]+)$"
    df = df.withColumn("_who", _strip(_first(r, author, group=1)))
    named = _has(r, author) & (F.length("_who") < 20) & ~_has(F.col("_who"), r"\d{2,}")
    df = df.withColumn("_named", named).withColumn("author", F.when(F.col("_named"), F.col("_who")).otherwise(""))
    df = df.withColumn("_rest", F.when(F.col("_named"), _strip(F.coalesce(_before(r, author), r))).otherwise(r))
    parts = r"^(\d+\s*[-~]\s*\d+)\s*(?:完|완|완결)\s*(\d+\s*부)\s*(\d+(?:\s*[-~]\s*\d+)?)"
    df = df.withColumn("_two", _has(r, parts))

    def piece(k: int) -> Column:
        return F.replace(_first(r, parts, group=k), F.lit(" "), F.lit(""))

    second = F.when(piece(3).rlike("[-~]"), piece(3)).otherwise(F.concat(F.lit("1-"), piece(3)))
    df = df.withColumn("_both", F.concat_ws(" ", piece(1), F.lit("(완)"), piece(2), second))
    df = df.withColumn("_rest", _all_gone(F.when(F.col("_two"), _strip(_all_gone(r, parts))).otherwise(r), r"(\d+)(본편)", "$1 $2"))
    both_done, done_side, both = r"본편\s*및\s*외전\s*完", r"(?:完|완)\s*\+?\s*(?:外|외)", r"본편\s*및\s*외전"
    df = df.withColumn("_how", F.when(_has(r, both_done), 1).when(_has(r, done_side), 2).when(_has(r, both), 3).otherwise(0))
    gone = F
    for k, p in ((1, both_done), (2, done_side), (3, both)):
        gone = gone.when(F.col("_how") == k, _all_gone(r, p + r"[,\s]*"))
    df = df.withColumn("_rest", gone.otherwise(r)).withColumn("_sides", F.when(F.col("_how") > 0, F.array(F.lit("외전"))).otherwise(none))
    df = df.withColumn("is_completed", (F.col("_how") > 0) | _has(r, _COMPLETED, "iU")).withColumn("_rest", _all_gone(r, _COMPLETED, flags="iU"))
    with_notes, notes = r"후기\s*포함", r"\s+후기(?:\s|$)"
    df = df.withColumn("_notes", F.when(_has(r, with_notes), 1).when(_has(r, notes), 2).otherwise(0))
    df = df.withColumn("_sides", F.when(F.col("_notes") > 0, F.array_append("_sides", F.lit("후기"))).otherwise(F.col("_sides")))
    df = df.withColumn("_rest", F.when(F.col("_notes") == 1, _all_gone(r, r"[,\s]*후기\s*포함")).when(F.col("_notes") == 2, _all_gone(r, notes, " ")).otherwise(r))
    df = df.withColumn("_rest", _all_gone(_all_gone(r, r"(?:\s|^)및(?:\s|$)", " "), r"(?:포함|comp|only)(?:\s|$)", " ", "iU"))
    df = _sides(df, rf"\s+({_SIDE})(?:\s*\d*[-~]?\d*)?(?:\s|$)")
    df = _sides(df, rf"\s*\+\s*(?:{_SIDE})[\s\d\-~,]*")
    volume = r"(\d+)\s*[-~]\s*(\d+)\s*부|(\d+)\s*부"
    from_to = F.concat(_first(r, volume, group=1), F.lit("-"), _first(r, volume, group=2), F.lit("부"))
    one = F.concat(_first(r, volume, group=3), F.lit("부"))
    found = ~F.col("_two") & _has(r, volume)
    df = df.withColumn("_vol", found).withColumn("volume_info", F.when(F.col("_vol"), F.when(_first(r, volume, group=3) != "", one).otherwise(from_to)).otherwise(""))
    df = df.withColumn("_rest", F.when(F.col("_vol"), _first_gone(r, volume)).otherwise(r))
    span, number = r"(\d+)\s*[-~]\s*(\d+)\s*[화권부편회장]?", r"(\d+)"
    ends = F.concat(strip_zeros(_first(r, span, group=1)), F.lit("-"), strip_zeros(_first(r, span, group=2)))
    lone = F.when(F.length(_first(r, number, group=1)) >= 2, F.concat(F.lit("1-"), _first(r, number, group=1))).otherwise("")
    df = df.withColumn("range_info", F.when(F.col("_two"), F.col("_both")).when(_has(r, span), ends).otherwise(lone))
    df = df.withColumn("side_story", F.array_join("_sides", ", "))
    return df.drop("_rest", "_who", "_named", "_two", "_both", "_how", "_sides", "_notes", "_vol")


PARSED = ["title", "author", "volume_info", "range_info", "is_completed", "side_story", "extension", "original_genre", "edition_info"]


def parse_titles(df: DataFrame, name: str = "raw_name") -> DataFrame:
    """Add what a file name says: title, author, volume_info, range_info, is_completed, side_story, extension, original_genre, edition_info.

    Empty strings stand for what isn't there; null names count as empty.
    Columns of those names are replaced.
    """
    df = df.drop(*[c for c in PARSED if c != name])
    stem, suffix = split_suffix(F.coalesce(F.col(name), F.lit("")))
    df = df.withColumn("_n", stem).withColumn("extension", suffix)
    df = _tagged(df.withColumn("_n", repair_jamo(F.col("_n"))), "_n")
    df = _residual(_anchored(df, "_n"))
    return df.drop("_n").select(*[c for c in df.columns if c not in PARSED and c != "_n"], *PARSED)


def standard_name(genre: Column, title: Column, edition: Column, volume: Column, span: Column, completed: Column, side: Column, suppress: str | None = V.UNCLASSIFIED) -> Column:
    """``[genre] title edition volume range (완) + side``; empty parts are left out, and so is the genre ``suppress``."""

    def some(c: Column) -> Column:
        return F.when(c != "", c)

    tag = F.when((genre != "") & (genre != suppress if suppress else F.lit(True)), F.concat(F.lit("["), genre, F.lit("]")))
    return F.concat_ws(" ", tag, some(title), some(edition), some(volume), some(span), F.when(completed, "(완)"), F.when(side != "", F.concat(F.lit("+ "), side)))


def valid_genre(genre: Column) -> Column:
    """A genre that names may carry, or else unclassified."""
    return F.when(genre.isin(V.NAME_GENRES), genre).otherwise(V.UNCLASSIFIED)
