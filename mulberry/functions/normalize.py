"""String normalisation and similarity as Column -> Column functions. Each call site keeps its own normaliser."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mulberry.functions import vocab as V

WIDE = "(?U)"


def first_key(text: Column, table: dict[str, str], default: Column) -> Column:
    """Value of the first key contained in the text, in the table's order."""
    out = None
    for k, v in table.items():
        out = F.when(text.contains(k), v) if out is None else out.when(text.contains(k), v)
    return out.otherwise(default)


def collapse(c: Column) -> Column:
    """White space of any kind, also U+3000, to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cache_key(title: Column) -> Column:
    """Key of the genre cache: trimmed, lower case."""
    return F.lower(F.regexp_replace(title, r"(?U)^\s+|\s+$", ""))


def similarity_title(title: Column) -> Column:
    """Lower case, letters, digits and spaces only, single spaces."""
    return collapse(F.regexp_replace(F.lower(title), r"(?U)[^\w\s가-힣]", ""))


def fuzzy_title(title: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}_]", ""))


def search_title(title: Column) -> Column:
    """Title for a search: without bracketed notes, with middle dots and tildes as spaces."""
    t = F.regexp_replace(title, r"(?U)\s*[(\[](RM|완결?|단행본|연재중|개정판|합본|특별판|19[금Nn]|15금)[)\]]\s*", " ")
    return collapse(F.translate(t, "ㆍ·~", "   "))


def spaced_title(title: Column) -> Column:
    """Spaces at the borders of Hangul with Latin letters and digits, in titles of 5 characters or more without any."""
    t = title
    for pattern in (r"([가-힣])([A-Za-z])", r"([A-Za-z])([가-힣])", r"(\d)([가-힣])", r"([가-힣])(\d)"):
        t = F.regexp_replace(t, pattern, "$1 $2")
    return F.when(title.contains(" ") | (F.length(title) < 5), title).otherwise(t)


def is_short_title(title: Column) -> Column:
    """One word, or 6 characters at most."""
    return (F.size(F.split(collapse(title), " ")) == 1) | (F.length(F.replace(title, F.lit(" "), F.lit(""))) <= 6)


def split_suffix(name: Column) -> tuple[Column, Column]:
    """(stem, suffix): what follows the last dot, if it is 1 to 10 letters or digits of any script; a lone leading dot has no stem."""
    lone = name.startswith(".") & ~F.substring(name, 2, 1 << 30).contains(".")
    pattern = r"(?sU)^(.*[^.].*|)(\.[\p{L}\p{N}]{1,10})$"
    has = name.rlike(r"(?sU)[^.].*\.[\p{L}\p{N}]{1,10}$")
    stem = F.when(lone, "").when(has, F.regexp_extract(name, pattern, 1)).otherwise(name)
    return stem, F.when(lone, name).when(has, F.regexp_extract(name, pattern, 2)).otherwise("")


def split_known_suffix(name: Column) -> tuple[Column, Column]:
    """(stem, suffix) for the known kinds of files only, without spaces before the dot."""
    pattern = r"(?i)^(.*?)\s*(\.(?:txt|epub|zip|zipx|7z|rar))$"
    has = name.rlike(pattern)
    return F.when(has, F.regexp_extract(name, pattern, 1)).otherwise(name), F.when(has, F.regexp_extract(name, pattern, 2)).otherwise("")


def plain_title(file_name: Column) -> Column:
    """Title of a file name by plain substitutions: suffix, ranges, notes, what follows a plus, unit numbers, underscores."""
    t = F.regexp_replace(file_name, r"(?s)(?<=[^.])\.[^./]*$", "")
    for pattern, by in (
        (r"(?U)\s+\d+[-~]\d+[화권부편]?\s*(?:\(완\))?", " "),
        (r"(?iU)\s*\[(단행본|완결|연재중|개정판|합본|개정|특별판|장르|작가|판타지|무협|로맨스|BL)\]\s*", ""),
        (r"(?iU)\s*\((완결|연재중|개정판|합본|개정|특별판|완|19금|19N|19n|19|15금|15|N|n)\)\s*", ""),
        (r"(?U)\s*\+.*$", ""),
        (r"(?U)[\s_\-]+\d+[화권부편](?=\s|$)", ""),
        (r"(?U)[_\-]+\d+$", ""),
        ("_+", " "),
    ):
        t = F.regexp_replace(t, pattern, by)
    return collapse(t)


def strip_zeros(number: Column) -> Column:
    """A number's digits without leading zeros."""
    return F.regexp_replace(number, r"^0+(?=\d)", "")


def bare_url(url: Column) -> Column:
    """The address without its query."""
    return F.split_part(url, F.lit("?"), F.lit(1))


def desktop_url(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?://)m\.munpia\.com", "$1novel.munpia.com")


def author_variants(authors: Column, stop: list[str] | None = None) -> Column:
    """Of a comma-separated list: the names, and their last three and last two characters."""
    names = F.filter(F.transform(F.split(authors, ","), lambda a: F.trim(a)), lambda a: a != "")
    found = F.flatten(F.transform(names, lambda a: F.filter(F.array(a, F.when(F.length(a) > 3, F.right(a, F.lit(3))), F.when(F.length(a) > 2, F.right(a, F.lit(2)))), lambda x: x.isNotNull())))
    return F.array_distinct(F.array_except(found, F.array(*map(F.lit, stop)).cast("array<string>")) if stop else found)


def tag_genre(token: Column) -> Column:
    """Standard genre of a tag's genre name, spaces ignored; unknown names stay."""
    t = F.trim(token)
    bare = F.replace(t, F.lit(" "), F.lit(""))
    out = F
    for genre, names in V.TAG_GENRES.items():
        out = out.when(bare.isin(sorted({n.replace(" ", "") for n in names})), genre)
    return out.otherwise(t)


def source_label(source: Column) -> Column:
    """Name shown for a provenance label; "-" if there is none."""
    head = F.split_part(source, F.lit("_"), F.lit(1))
    capital = F.concat(F.upper(F.substring(head, 1, 1)), F.lower(F.substring(head, 2, 1 << 30)))
    other = F.when(source.contains("_"), capital).otherwise(source)
    return F.when(F.coalesce(source, F.lit("")) == "", "-").otherwise(first_key(F.concat(F.lower(source), source), V.SOURCE_NAMES, other))


def rename_by(template: str, genre: Column, title: Column) -> Column:
    """A file's new name by one of three templates."""
    forms = {"[장르] 제목": F.concat(F.lit("["), genre, F.lit("] "), title), "제목 [장르]": F.concat(title, F.lit(" ["), genre, F.lit("]")), "장르_제목": F.concat(genre, F.lit("_"), title)}
    return forms[template]


def edit_genre(name: Column, old: Column, new: Column) -> Column:
    """Replace the first tag of the old genre, or else put the new one in front."""
    tag = F.concat(F.lit("["), old, F.lit("]"))
    at = F.instr(name, tag)
    head, tail = F.substring(name, F.lit(1), at - 1), F.substring(name, at + F.length(tag), F.length(name))
    return F.when((old != "") & (at > 0), F.concat(head, F.lit("["), new, F.lit("]"), tail)).otherwise(F.concat(F.lit("["), new, F.lit("] "), name))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, on similarity titles; 1 for two empty ones, 0 for one."""
    x, y = similarity_title(a), similarity_title(b)
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, 1.0).when(F.least(F.length(x), F.length(y)) == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / most)


def is_similar(a: Column, b: Column, author_match: Column | None = None) -> Column:
    """At least 0.85 alike, or 0.75 if the author is the same."""
    bar = F.when(author_match, 0.75).otherwise(0.85) if author_match is not None else F.lit(0.85)
    return similarity(a, b) >= bar


def length_gap(a: Column, b: Column) -> Column:
    """Difference of lengths as a share of the longer."""
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b))


def complexity(name: Column) -> Column:
    """Length, and two for every character that is neither letter, digit nor space."""
    return F.length(name) + 2 * F.length(F.regexp_replace(name, r"(?U)[\w\s]", ""))


def looks_garbled(names: Column) -> Column:
    """Whether any of the names has box-drawing characters."""
    return F.exists(names, lambda n: n.rlike("[" + re.escape(V.BOX_DRAWING) + "]"))


def json_genres(text: Column) -> Column:
    """The genres of a JSON text's ``genre``, a string or a list; none if it is no JSON."""
    v = F.try_variant_get(F.try_parse_json(text), "$.genre", "variant")
    many = F.try_variant_get(v, "$", "array<string>")
    return F.coalesce(many, F.array(F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def literal_table(pairs: dict[str, str]) -> Column:
    """Keys and values in order as one constant, array of struct(k, g)."""
    return F.from_json(F.lit(json.dumps([{"k": k, "g": g} for k, g in pairs.items()], ensure_ascii=False)), "array<struct<k:string,g:string>>")


def literal_words(words: list[str]) -> Column:
    """Words in order as one constant."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")
