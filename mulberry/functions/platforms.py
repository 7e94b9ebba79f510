"""What each platform's pages say of a book's genre.

A page is read once, by a small HTML reader in an Arrow UDF, into a struct of
what the platforms' rules look at; all rules are columns over that struct, so
Catalyst evaluates only those of a page's own platform.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mulberry.functions import vocab as V
from mulberry.functions.normalize import collapse, json_genres, let, literal_table, literal_words
from mulberry.functions.pages import Page, read
from mulberry.functions.slices import slices
from mulberry.operators.genres import map_genre

#: Parts of class names by which elements are of use to some platform, and the tags of such elements and of those within them.
MARKS = ["breadcrumb", "category", "tag", "hash", "genre", "badge", "meta-path", "items", "break-all", "title", "sc-geveer", "sc-jlzhew", "brirua", "sc-cwhptr", "gkqamv"]
MARKED, INNER = ["nav", "ol", "ul", "li", "div", "span", "p", "a", "h2"], ["a", "span", "strong", "b", "div"]
#: Kinds of elements whose text is looked through: tags and parts of the class.  What the outermost of a kind doesn't say, those within it don't.
KINDS = {
    "crumbs": (["nav", "ol", "ul", "div"], ["breadcrumb", "category"]),
    "genre": (["div", "span", "a"], ["genre", "category"]),
    "hashtags": (["div", "span", "p"], ["tag", "hash"]),
    "badges": (["span", "div", "a", "li"], ["genre", "tag", "badge"]),
    "category": (["div", "ul", "nav"], ["category", "breadcrumb"]),
}
_TEXT = T.StringType()
_INT = T.IntegerType()


def _rows(*names: str, **more: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([*(T.StructField(n, _TEXT) for n in names), *(T.StructField(n, k) for n, k in more.items())]))


_FIELDS = {
    "title": _TEXT,
    "og_title": _TEXT,
    "metas": _rows("name", "property", "content"),
    "links": _rows("href", "text"),
    "jsonld": T.ArrayType(_TEXT),
    "headings": T.ArrayType(T.StructType([T.StructField("begin", _INT), T.StructField("end", _INT)])),
    "elements": _rows("tag", "css", begin=_INT, end=_INT, at=_INT, size=_INT, last_link=_INT, letters=_INT, outermost=_INT, marked=T.BooleanType()),
    "pieces": T.ArrayType(_TEXT),
    "body": _TEXT,
    "text": _TEXT,
}
FIELDS = T.StructType([T.StructField(n, k) for n, k in _FIELDS.items()])
FOUND = "struct<genre:string,raw_genre:string,source:string,confidence:double,needs_sports_check:boolean,needs_history_check:boolean,needs_fantasy_refinement:boolean>"


def _elements(page: Page) -> list[dict]:
    """Elements of telling classes and those of use within them, in page order.

    ``size`` counts those of the list within one, ``last_link`` is the place of
    the last link among them (-1: none), ``letters`` the characters of its text
    but for white space, ``outermost`` has a bit for each kind of which it is one
    and lies within no other.
    """
    letters = [0]
    for piece in page.pieces:
        letters.append(letters[-1] + sum(map(len, piece.split())))
    out: list[dict] = []
    open_: list[tuple[dict, int]] = []  # those of the list that go on, and where they end
    until, within, links = -1, [-1] * len(KINDS), []

    def close(at: int) -> None:
        while open_ and open_[-1][1] <= at:
            e = open_.pop()[0]
            e["size"] = len(out) - 1 - e["at"]
            e["last_link"] = links[-1] if links and links[-1] > e["at"] else -1

    for i, e in enumerate(page.elements):
        css = e.attrs.get("class", "")
        marked = css != "" and e.tag in MARKED and any(m in css.lower() for m in MARKS)
        if not marked and not (i < until and e.tag in INNER):
            continue
        close(i)
        bits = 0
        if marked:
            until = max(until, e.last)
            for k, (tags, parts) in enumerate(KINDS.values()):
                if i >= within[k] and e.tag in tags and any(part in css.lower() for part in parts):
                    bits, within[k] = bits | 1 << k, e.last
        own = {"tag": e.tag, "css": css, "begin": e.begin, "end": e.end, "at": len(out), "letters": letters[e.end] - letters[e.begin], "outermost": bits, "marked": marked}
        out.append(own)
        open_.append((own, e.last))
        if e.tag == "a":
            links.append(own["at"])
    close(len(page.elements))
    return out


def _fields(html: str | None) -> dict | None:
    if html is None:
        return None
    page = read(html)
    nodes = page.elements
    first = {tag: next((e for e in nodes if e.tag == tag), None) for tag in ("title", "body")}
    metas = [{k: e.attrs.get(k, "") for k in ("name", "property", "content")} for e in nodes if e.tag == "meta"]
    return {
        "title": first["title"] and page.text(first["title"]),
        "og_title": next((m["content"].strip() for m in metas if m["property"] == "og:title"), ""),
        "metas": metas,
        "links": [{"href": e.attrs["href"], "text": page.text(e).strip()} for e in nodes if e.tag == "a" and "href" in e.attrs],
        "jsonld": [page.raw.get(i, "") for i, e in enumerate(nodes) if e.tag == "script" and e.attrs.get("type") == "application/ld+json"],
        "headings": [{"begin": e.begin, "end": e.end} for e in nodes if e.tag in ("h1", "h2", "h3")],
        "elements": _elements(page),
        "pieces": page.pieces,
        "body": first["body"] and page.text(first["body"]),
        "text": "".join(page.pieces),
    }


@F.pandas_udf(FIELDS)
def page_fields(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Title, metas, links, JSON-LD, headings, elements of telling classes, pieces of text and texts of a page; all null for no page."""
    for batch in pages:
        for some in slices(batch):
            yield pd.DataFrame([_fields(p) or dict.fromkeys(_FIELDS) for p in some], columns=list(_FIELDS), index=some.index)


def text_of(p: Column, e: Column) -> Column:
    """Text of an element or a heading."""
    return let(e, lambda x: F.array_join(F.slice(p["pieces"], x["begin"] + 1, x["end"] - x["begin"]), ""))


def _inner(p: Column, e: Column) -> Column:
    """Elements within an element."""
    return let(e, lambda x: F.slice(p["elements"], x["at"] + 2, x["size"]))


#: Characters of the longest name that can be a text as a whole.
LONGEST_NAME = max(map(len, V.PAGE_GENRES))


def _keys() -> Column:
    return literal_table(V.PAGE_GENRES)


def _longest() -> Column:
    return literal_table({k: V.PAGE_GENRES[k] for k in sorted(V.PAGE_GENRES, key=len, reverse=True)})


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def exact(name: Column, table: Column | None = None) -> Column:
    """struct(k, g) of a name that is a key."""
    return _first(F.filter(_keys() if table is None else table, lambda k: k["k"] == name))


def longest(text: Column) -> Column:
    """struct(k, g) of the longest key that a text contains."""
    return _first(F.filter(_longest(), lambda k: F.contains(text, k["k"])))


def first_of(texts: Column, look_up: Callable[[Column], Column]) -> Column:
    """What is found for the first text for which something is."""
    return _first(F.filter(F.transform(texts, lambda t: look_up(t)), lambda x: x.isNotNull()))


def _hit(pair: Column, source: str, confidence: float | Column, flags: str = "") -> Column:
    """The result of a rule that found struct(k, g), or null; of general genres flags may ask for another look."""
    sure = F.lit(confidence) if isinstance(confidence, float) else confidence
    value = f"""x -> CASE WHEN x.p IS NOT NULL THEN named_struct(
        'genre', x.p.g, 'raw_genre', x.p.k, 'source', '{source}', 'confidence', x.c,
        'needs_sports_check', {"s" in flags} AND x.p.g = '현판', 'needs_history_check', {"h" in flags} AND x.p.g = '현판', 'needs_fantasy_refinement', {"s" in flags} AND x.p.g = '판타지') END"""
    # one expression of text in place of some hundred calls that build it
    return F.get(F.call_function("transform", F.array(F.struct(pair.alias("p"), sure.alias("c"))), F.expr(value)), F.lit(0))


def _has_class(m: Column, tags: list[str], parts: list[str]) -> Column:
    """Of some tags, with a class that contains one of some parts, regardless of case."""
    return m["tag"].isin(tags) & F.exists(literal_words(parts), lambda x: F.contains(F.lower(m["css"]), x))


def _marks(p: Column, tags: list[str], *parts: str) -> Column:
    return F.filter(p["elements"], lambda m: m["marked"] & _has_class(m, tags, list(parts)))


def _outermost(p: Column, kind: str) -> Column:
    bit = 1 << list(KINDS).index(kind)
    return F.filter(p["elements"], lambda m: m["outermost"].bitwiseAND(F.lit(bit)) != 0)


def _texts(p: Column, marks: Column, strip: bool = True) -> Column:
    return F.transform(marks, lambda m: F.trim(text_of(p, m)) if strip else text_of(p, m))


def _mapped(name: Column) -> Column:
    """struct(k, g) of a name by the general mapping; null if unclassified."""
    return let(map_genre(name), lambda g: F.when(g != V.UNCLASSIFIED, F.struct(name.alias("k"), g.alias("g"))))


def ridibooks(p: Column, url: Column) -> Column:
    """JSON-LD, last link of a breadcrumb, meta keywords, links, then the text."""
    crumbs = F.array_distinct(F.transform(F.filter(_marks(p, *KINDS["crumbs"][:1], *KINDS["crumbs"][1]), lambda m: m["last_link"] >= 0), lambda m: m["last_link"]))
    last = F.transform(crumbs, lambda i: F.trim(text_of(p, F.get(p["elements"], i))))
    last = F.transform(last, lambda t: F.trim(F.regexp_replace(t, " 소설| 웹소설| 장르", "")))
    keywords = F.transform(F.filter(p["metas"], lambda m: (m["name"] == "keywords") | (m["property"] == "keywords")), lambda m: m["content"])
    linked = F.filter(literal_words(V.RIDI_LINKS), lambda k: F.exists(p["links"], lambda a: a["text"] == k))
    told = F.filter(literal_words(V.RIDI_TEXT), lambda k: F.contains(p["text"], k))
    steps = [(F.flatten(F.transform(p["jsonld"], json_genres)), "jsonld", 0.95), (last, "breadcrumb", 0.95), (keywords, "meta", 0.95), (linked, "link", 0.95), (told, "page", 0.90)]
    # all that the steps look at in their order, with what a find there is worth
    def worth(texts: Column, name: str, sure: float) -> Column:
        return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.struct(t.alias("t"), F.lit(f"리디북스_{name}").alias("source"), F.lit(sure).alias("sure")))

    said = F.flatten(F.array(*[worth(*step) for step in steps]))
    found = _first(F.filter(F.transform(said, lambda x: F.struct(_mapped(x["t"]).alias("p"), x["source"].alias("source"), x["sure"].alias("sure"))), lambda x: x["p"].isNotNull()))
    return let(found, lambda x: let(_hit(x["p"], "", x["sure"]), lambda h: F.when(h.isNotNull(), h.withField("source", x["source"]))))


def munpia(p: Column, url: Column) -> Column:
    """The last part of the path, of several genres there the telling one; then the text."""
    path = _first(_marks(p, ["p"], "meta-path"))
    parts = F.split(F.trim(text_of(p, path)), ">")
    strong = text_of(p, _first(F.filter(_inner(p, path), lambda x: x["tag"] == "strong")))
    named = F.transform(F.split(F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(strong), ","), lambda g: F.trim(g))
    genres = let(named, lambda some: let(F.filter(some, lambda g: exact(g).isNotNull()), lambda known: F.when(F.size(known) > 0, known).otherwise(some)))

    def main(some: Column) -> Column:
        def first_in(words: list[str]) -> Column:
            return _first(F.filter(literal_words(words), lambda w: F.array_contains(some, w)))

        pairs = [F.when(F.array_contains(some, a) & F.array_contains(some, b), F.lit(g)) for a, b, g in V.MUNPIA_PAIRS]
        longest_name = let(F.array_max(F.transform(some, lambda g: F.length(g))), lambda n: F.element_at(F.filter(some, lambda g: F.length(g) == n), 1))
        one = F.coalesce(first_in(V.MUNPIA_MILITARY), F.when(first_in(V.MUNPIA_FANTASY).isNotNull(), first_in(V.MUNPIA_HISTORY)), *pairs, longest_name)
        several = let(one, lambda k: F.struct(k.alias("k"), F.coalesce(exact(k)["g"], k).alias("g")))
        return F.when(F.size(some) >= 2, several).when(F.size(some) == 1, exact(_first(some)))

    return F.coalesce(_hit(let(genres, main), "문피아_meta_path", 0.92), _hit(longest(p["text"]), "문피아_page", 0.85))


def naver_series(p: Column, url: Column, near: int | None = None) -> Column:
    """E-book category, hashtags and names in metas, then the text from the title on; ``near`` looks at so many characters of it only (the reference at 1,000)."""
    books = F.filter(p["links"], lambda a: F.contains(a["href"], F.lit("/ebook/categoryProductList.series")))
    book = F.when(F.contains(url, F.lit("/ebook/")), first_of(F.transform(books, lambda a: a["text"]), lambda t: exact(t, literal_table(V.EBOOK_GENRES))))

    def of_meta(m: Column) -> Column:
        tags = F.when(m["name"] == "description", F.regexp_extract_all(m["content"], F.lit("#([가-힣a-zA-Z]+)"), F.lit(1)))
        return F.coalesce(first_of(tags, exact), F.when(m["content"].rlike("판타지|무협|로맨스|BL"), longest(m["content"])))

    whole = F.coalesce(p["body"], p["text"])
    at = F.when(p["title"].isNotNull() & p["body"].isNotNull(), F.position(p["title"], p["body"])).otherwise(0)
    text = F.substr(whole, F.greatest(at, F.lit(1))) if near is None else F.substr(whole, F.greatest(at, F.lit(1)), F.lit(near))
    return F.coalesce(_hit(book, "네이버시리즈_ebook_category", 0.88, "sh"), _hit(first_of(p["metas"], of_meta), "네이버시리즈_meta", 0.88, "s"), _hit(longest(text), "네이버시리즈_page", 0.88, "s"))


def _in_order(found: Column, order: list[str]) -> Column:
    """Of several struct(k, g) the first by an order of names or genres; of one, or of none in the order, the first."""


    def chosen(some: Column) -> Column:
        best = first_of(literal_words(order), lambda o: _first(F.filter(some, lambda x: (x["g"] == o) | (x["k"] == o))))
        return F.when(F.size(some) > 1, F.coalesce(best, _first(some))).otherwise(_first(some))

    return let(found, chosen)


def novelnet(p: Column, url: Column) -> Column:
    """Meta keywords, links of the product's category, any element of a genre or category, then the text."""
    words = F.filter(p["metas"], lambda m: (m["name"] == "keywords") & (m["content"] != ""))
    by_meta = first_of(words, lambda m: _in_order(F.filter(_longest(), lambda k: F.contains(m["content"], k["k"])), V.NOVELNET_ORDER))
    product = _first(F.filter(p["elements"], lambda m: m["marked"] & (m["tag"] == "div") & F.array_contains(F.split(m["css"], r"\s+"), "product-category")))
    linked = F.filter(F.transform(F.filter(_inner(p, product), lambda x: x["tag"] == "a"), lambda a: exact(F.trim(text_of(p, a)))), lambda x: x.isNotNull())
    by_class = first_of(_texts(p, _outermost(p, "genre")), longest)
    category = F.coalesce(_in_order(linked, V.NOVELNET_ORDER), by_class)
    return F.coalesce(_hit(by_meta, "소설넷_meta", 0.88), _hit(category, "소설넷_category", 0.88), _hit(longest(p["text"]), "소설넷_page", 0.80))


def kakao(p: Column, url: Column) -> Column:
    """Names in the page's spans of one class, then the text."""
    spans = F.filter(p["elements"], lambda m: m["marked"] & (m["tag"] == "span") & (m["css"] == "break-all align-middle") & (m["letters"] <= LONGEST_NAME))
    return F.coalesce(_hit(first_of(_texts(p, spans), exact), "카카오페이지_tag", 0.90, "sh"), _hit(longest(p["text"]), "카카오페이지_page", 0.85, "sh"))


def novelpia(p: Column, url: Column) -> Column:
    """Hashtags: compounds, combinations, single names; then the text."""
    tags = _outermost(p, "hashtags")
    in_tags = F.concat(F.array_join(_texts(p, tags, strip=False), " "), F.lit(" "))

    def tagged(word: Column) -> Column:
        hash_, apart = F.concat(F.lit("#"), word), F.concat(F.lit("# "), word)
        gap = (48 - F.length(word)).cast("string")
        near = F.concat(F.lit(r"(?s)#\w+.{0,"), gap, F.lit("}"), apart, F.lit("|"), apart, F.lit(".{0,"), gap, F.lit(r"}#\w"))
        anywhere = F.contains(p["text"], hash_) | F.regexp_like(p["text"], near)
        return F.when(F.size(tags) > 0, F.contains(in_tags, hash_) | F.contains(in_tags, apart)).otherwise(anywhere)

    compound = _first(F.filter(literal_table(V.NOVELPIA_COMPOUND), lambda x: tagged(x["k"])))
    listed = F.from_json(F.lit(json.dumps([{"a": a, "b": b, "k": raw, "g": g} for a, b, g, raw in V.NOVELPIA_PAIRS], ensure_ascii=False)), "array<struct<a:string,b:string,k:string,g:string>>")
    pairs = let(_first(F.filter(listed, lambda x: tagged(x["a"]) & tagged(x["b"]))), lambda x: F.when(x.isNotNull(), F.struct(x["k"].alias("k"), x["g"].alias("g"))))
    single = _first(F.filter(literal_table({k: V.PAGE_GENRES[k] for k in V.NOVELPIA_SINGLE if k in V.PAGE_GENRES}), lambda x: tagged(x["k"])))
    return F.coalesce(_hit(compound, "노벨피아_hashtag", 0.92), _hit(pairs, "노벨피아_hashtag_analysis", 0.92), _hit(single, "노벨피아_hashtag", 0.92), _hit(longest(p["text"]), "노벨피아_page", 0.80))


def joara(p: Column, url: Column) -> Column:
    """The first span of the list of items; pages that ask for a log-in say nothing."""
    items = _first(F.filter(p["elements"], lambda m: m["marked"] & (m["tag"] == "div") & F.array_contains(F.split(m["css"], r"\s+"), "items")))
    span = text_of(p, _first(F.filter(_inner(p, items), lambda x: x["tag"] == "span")))
    closed = F.lower(F.coalesce(p["title"], F.lit(""))).rlike("로그인|인증|성인|19세|본인확인|adult|login")
    return F.when(~closed, _hit(exact(F.trim(span)), "조아라_selenium", 0.85))


def webtoonguide(p: Column, url: Column) -> Column:
    """Names in the styled elements of the genre box, by an order."""
    box = _first(_marks(p, ["div"], "sc-geveer", "sc-jlzhew", "brirua"))
    bold = F.transform(F.slice(F.filter(_inner(p, box), lambda x: x["tag"] == "b"), 1, 1), lambda x: F.trim(text_of(p, x)))
    styled = F.filter(_inner(p, box), lambda x: (x["letters"] < 30) & _has_class(x, ["div"], ["sc-cwhptr", "gkqamv"]))
    rest = F.filter(_texts(p, styled), lambda t: (t != "") & (F.length(t) < 30))
    names = F.concat(bold, rest)
    found = F.transform(literal_table(V.WEBTOONGUIDE_ORDER), lambda o: F.struct(_first(F.filter(names, lambda t: F.contains(F.lower(t), F.lower(o["k"])))).alias("k"), o["g"].alias("g")))
    return _hit(_first(F.filter(found, lambda x: x["k"].isNotNull())), "웹툰가이드_selenium", 0.75)


def mrblue(p: Column, url: Column) -> Column:
    """Metas, tags and badges, categories, then the text."""
    metas = F.filter(p["metas"], lambda m: m["name"].isin("keywords", "description") | (m["property"] == "og:description"))
    by_meta = first_of(metas, lambda m: longest(m["content"]))
    by_tag = first_of(_texts(p, _outermost(p, "badges")), lambda t: F.coalesce(exact(t), longest(t)))
    by_category = first_of(_texts(p, _outermost(p, "category"), strip=False), longest)
    return F.coalesce(_hit(by_meta, "미스터블루_meta", 0.85), _hit(by_tag, "미스터블루_tag", 0.85), _hit(by_category, "미스터블루_category", 0.85), _hit(longest(p["text"]), "미스터블루_page", 0.75))


def kyobo(p: Column, url: Column) -> Column:
    """The category path: particular kinds of novels from the right, else the longest name, less sure for general ones."""
    area = text_of(p, _first(_marks(p, ["div", "ul"], "category", "breadcrumb")))
    parts = F.reverse(F.filter(F.transform(F.split(area, ">"), lambda x: F.trim(x)), lambda x: x != ""))

    def kind(t: Column) -> Column:
        return let(_first(F.filter(literal_table(V.KYOBO_SPECIFIC), lambda s: F.contains(t, s["k"]))), lambda x: F.when(x.isNotNull(), F.struct(t.alias("k"), x["g"].alias("g"))))

    special = first_of(parts, kind)
    sure = F.when(area.rlike("일반|기타"), 0.60).otherwise(0.85)
    return F.coalesce(_hit(special, "교보문고_category", 0.85), _hit(longest(area), "교보문고_category", sure))


def _from_right(texts: Column) -> Column:
    """The last text with a name; raw is the text."""
    return first_of(F.reverse(texts), lambda t: let(longest(t), lambda x: F.when(x.isNotNull(), F.struct(t.alias("k"), x["g"].alias("g")))))


def yes24(p: Column, url: Column) -> Column:
    """Genres of a JSON-LD book from the right, else the category links."""
    books = F.filter(p["jsonld"], lambda j: (F.get_json_object(j, "$['@type']") == "Book") & F.get_json_object(j, "$.genre").startswith("["))
    by_json = first_of(F.transform(books, lambda j: F.from_json(F.get_json_object(j, "$.genre"), "array<string>")), _from_right)
    links = F.filter(p["links"], lambda a: F.contains(a["href"], F.lit("CategoryNumber")))
    return F.coalesce(_hit(by_json, "yes24_jsonld", 0.70), _hit(_from_right(F.transform(links, lambda a: a["text"])), "yes24_category", 0.70))


def aladin(p: Column, url: Column) -> Column:
    """Category links from the right, else their whole path."""
    links = F.transform(F.filter(p["links"], lambda a: F.contains(a["href"], F.lit("CID="))), lambda a: a["text"])
    return F.coalesce(_hit(_from_right(links), "알라딘_category", 0.85), F.when(F.size(links) > 0, _hit(longest(F.array_join(links, " > ")), "알라딘_category", 0.85)))


EXTRACTORS: dict[str, Callable[[Column, Column], Column]] = {
    "ridibooks": ridibooks, "munpia": munpia, "naver_series": naver_series, "kakao": kakao, "novelnet": novelnet, "novelpia": novelpia,
    "joara": joara, "webtoonguide": webtoonguide, "mrblue": mrblue, "kyobo": kyobo, "yes24": yes24, "aladin": aladin,
}


def platform_genre(platform: Column, p: Column, url: Column) -> Column:
    """The result of the page's own platform: genre, raw_genre, source, confidence and what to look at again; null for others."""
    out = F
    for key, extractor in EXTRACTORS.items():
        out = out.when(platform == key, extractor(p, url))
    return out.otherwise(F.lit(None).cast(FOUND))


def platform_key(name: Column) -> Column:
    """Key of a platform's name, in small letters where it isn't known."""
    table = F.create_map(*[F.lit(x) for kv in V.PLATFORM_KEYS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.lower(name))


def clean_page_title(platform: Column, title: Column) -> Column:
    """A page's title without what its platform adds to it."""
    out = F
    for key, steps in V.PAGE_TITLES.items():
        c = title
        for pattern, by in steps:
            c = F.regexp_replace(c, pattern, by)
        out = out.when(platform == key, collapse(c) if key == "naver_series" else F.trim(c))
    return out.otherwise(F.trim(title))


def page_name(platform: Column, p: Column) -> Column:
    """The title that a platform's page is verified by: of og:title, headings and the title element the one its platform goes by, cleaned."""
    og = F.when(p["og_title"] != "", p["og_title"])
    heading = text_of(p, _first(F.filter(p["elements"], lambda m: m["marked"] & (m["tag"] == "h2") & F.array_contains(F.split(m["css"], r"\s+"), "title"))))
    own = F.when(~og.rlike("네이버|시리즈"), og)
    # headings of the page itself, not of its menus
    told = _first(F.filter(F.transform(p["headings"], lambda h: F.trim(text_of(p, h))), lambda h: ~F.lower(h).rlike("navigation|nav|bar|menu|header|footer|local|global|series|naver|네이버|시리즈") & (F.length(h) >= 2) & ~((h == F.upper(h)) & (h != F.lower(h)) & (F.length(h) <= 10))))
    named = F.when(platform == "munpia", F.coalesce(F.trim(heading), og, p["title"])).when(platform == "naver_series", F.coalesce(own, told, p["title"])).when(platform.isin("novelpia", "novelnet", "mrblue"), F.coalesce(og, p["title"])).otherwise(p["title"])
    return clean_page_title(platform, named)


def best_ridibooks(found: Column) -> Column:
    """Of the results of several pages of one search the one whose genre comes first in the platform's order, else the first."""
    some = F.filter(found, lambda x: x.isNotNull())
    best = first_of(literal_words(V.RIDI_ORDER), lambda g: _first(F.filter(some, lambda x: x["genre"] == g)))
    return F.coalesce(best, _first(some))
