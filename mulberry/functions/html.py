"""What platforms' pages say of a book's genre. Pages are read with regular expressions in the JVM; no page is parsed in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mulberry.functions.normalize import collapse, json_genres, let
from mulberry.operators.genres import map_genre

# What a page leaves open goes on to its end, as it does for a browser: no pattern looks through the rest of a page more than once.
_APART = r"(?is)<(script|style|header|footer|nav)\b(?:.*?</\1\s*>|.*)"
_TAG = r"<[^>]*(?:>|\z)"
_HREF = r"""(?is)\bhref\s*=\s*["']([^"']*)["']"""


def unescape(c: Column) -> Column:
    """The named references that markup needs, and numeric ones stay as they are."""
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(ch))
    return c


def page_title(page: Column) -> Column:
    return collapse(unescape(F.regexp_extract(page, r"(?is)<title[^>]*(?:>(.*?)(?:</title>|\z)|\z)", 1)))


def meta(page: Column, name: str) -> Column:
    """Content of the first meta element of a name or property."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<meta\s[^>]*(?:>|\z)"), F.lit(0))
    told = rf"""(?is)\s(?:name|property)\s*=\s*["']{name}["']"""
    tag = F.coalesce(F.get(F.filter(tags, lambda t: t.rlike(told)), F.lit(0)), F.lit(""))
    return unescape(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["'](.*?)["']""", 1))


def heading(page: Column, level: int = 1) -> Column:
    return collapse(unescape(F.regexp_replace(F.regexp_extract(page, rf"(?is)<h{level}\b[^>]*(?:>(.*?)(?:</h{level}>|\z)|\z)", 1), _TAG, "")))


def links(page: Column) -> Column:
    """Addresses of all links, in page order."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<a\s[^>]*(?:>|\z)"), F.lit(0))
    return F.transform(F.filter(tags, lambda t: t.rlike(_HREF)), lambda t: F.regexp_extract(t, _HREF, 1))


def link_texts(page: Column) -> Column:
    """array of struct(href, text) of all links."""
    whole = F.regexp_extract_all(page, F.lit(r"(?is)<a\s[^>]*(?:>.*?(?:</a>|\z)|\z)"), F.lit(0))
    return F.transform(whole, lambda a: F.struct(F.regexp_extract(a, _HREF, 1).alias("href"), collapse(unescape(F.regexp_replace(a, _TAG, ""))).alias("text")))


def by_class(page: Column, tag: str, css_class: str) -> Column:
    """Text of the first element of a tag and class, which holds no element of that tag."""
    return collapse(unescape(F.regexp_replace(F.regexp_extract(page, rf"""(?is)<{tag}\s[^<>]*?class\s*=\s*["'][^"'<>]*\b{css_class}\b[^"'<>]*["'][^>]*>(.*?)(?:</{tag}>|\z)""", 1), _TAG, "")))


def visible_text(page: Column, most: int | None = None) -> Column:
    """Text without scripts, styles, headers, footers and menus; whole, or its first ``most`` characters (the reference looks for evidence in 3000)."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, r"(?s)<!--(?:.*?-->|.*)", " "), _APART, " "), _TAG, " ")
    text = collapse(unescape(bare))
    return text if most is None else F.substring(text, 1, most)


def jsonld(page: Column) -> Column:
    """Texts of the JSON-LD scripts."""
    scripts = F.regexp_extract_all(page, F.lit(r"(?is)<script[^>]*(?:>.*?(?:</script>|\z)|\z)"), F.lit(0))
    told = F.filter(scripts, lambda x: F.regexp_extract(x, r"(?is)\A<script[^>]*", 0).rlike(r"(?i)application/ld\+json"))
    return F.transform(told, lambda x: F.regexp_extract(x, r"(?is)\A<script[^>]*>(.*?)(?:</script>|\z)", 1))


def jsonld_genres(page: Column) -> Column:
    return F.flatten(F.transform(jsonld(page), json_genres))


def first_mapped(names: Column) -> Column:
    """The first of some names that has a standard genre, as it is."""
    return F.get(F.filter(names, lambda n: map_genre(n) != "미분류"), F.lit(0))


def genre_of_page(page: Column) -> Column:
    """struct(genre, source, confidence): JSON-LD, then keywords, then link texts, then the text itself."""
    words = F.transform(F.split(meta(page, "keywords"), ","), lambda w: F.trim(w))
    texts = F.transform(link_texts(page), lambda x: x["text"])
    body = map_genre(F.lower(visible_text(page)))

    def hit(genre: Column, source: str, confidence: float) -> Column:
        return let(genre, lambda g: F.when(g.isNotNull() & (g != "미분류"), F.struct(g.alias("genre"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))))

    return F.coalesce(hit(first_mapped(jsonld_genres(page)), "jsonld", 0.95), hit(first_mapped(words), "meta", 0.95), hit(first_mapped(texts), "link", 0.95), hit(body, "body", 0.90))


def is_adult_page(title: Column) -> Column:
    return title.rlike("성인|19세|연령\\s*확인")
