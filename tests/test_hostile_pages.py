"""Readers of pages take time that grows with the page, whatever is left open in it."""

import time

import pytest
from pyspark.sql import functions as F

from mulberry.functions import html as H
from mulberry.functions import platforms as P
from mulberry.functions.pages import read

OPEN = {
    "title": "<title>", "tag": "<", "comment": "<!--", "script": "<script ", "ld": '<script type="application/ld+json"', "link": "<a ", "links": "<a href=x>y", "nav": "<nav>", "meta": "<meta name=", "heading": "<h1>", "quote": "<a b=\"<i c='",
    "div": '<div class="category">', "span": '<div class="tag"><span class="break-all align-middle">', "p": "<p>", "list": "<ul><li>", "end": "</div>", "cell": "<table><tr><td>", "class": '<div class="', "amp": "&amp", "slash": "<a / / /",
}


def hostile(name):
    return "<body>" + OPEN[name] * (1_000_000 // len(OPEN[name])) + "무협"


@pytest.mark.parametrize("name", list(OPEN))
def test_a_megabyte_left_open(name):
    page = hostile(name)
    began = time.time()
    read(page)
    P._fields(page)
    assert time.time() - began < 15  # a machine may be slow; a quadratic reader takes many minutes


def test_patterns_on_megabytes_left_open(spark):
    p = F.col("p")
    df = spark.createDataFrame([(hostile(n),) for n in OPEN], "p string").repartition(4)
    began = time.time()
    got = df.select(F.length(H.visible_text(p)), H.page_title(p), F.size(H.links(p)), F.size(H.link_texts(p)), H.meta(p, "keywords"), H.heading(p), F.size(H.jsonld(p)), H.by_class(p, "div", "category")).collect()
    assert len(got) == len(OPEN) and time.time() - began < 120


@pytest.mark.parametrize("n", [70, 20_000])
def test_an_end_tag_finds_its_start_however_many_are_open_between(n):
    page = read(f'<div class="category">x{"<span>" * n}y</div>z')
    div = page.elements[0]
    assert page.text(div) == "xy" and "".join(page.pieces) == "xyz"
    assert P._fields(f'<div class="category">x{"<p>" * n}y</div>z')["elements"][0]["end"] == 2


def test_ends_that_are_not_written():
    page = read("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul><p>f<div>g</div><table><tr><td>h<td>i<tr><td>j</table><a href=1>k<a href=2>l</a><dl><dt>m<dd>n<dt>o</dl><select><option>p<option>q</select>")
    text = [(e.tag, page.text(e)) for e in page.elements]
    assert text == [
        ("ul", "abcde"), ("li", "a"), ("li", "bcd"), ("ul", "c"), ("li", "c"), ("li", "e"), ("p", "f"), ("div", "g"), ("table", "hij"), ("tr", "hi"), ("td", "h"), ("td", "i"), ("tr", "j"), ("td", "j"), ("a", "k"), ("a", "l"), ("dl", "mno"), ("dt", "m"), ("dd", "n"), ("dt", "o"), ("select", "pq"), ("option", "p"), ("option", "q"),
    ]


def test_attributes_raw_text_and_references():
    page = read("""<a HREF="x>y&amp;" b='c"d' e=f g h = "i">1 &lt; 2</a><!-- <b>no</b> --><script type=x>if (a < b) "</div>"</SCRIPT ><template>no<i>yes</i></template><br/><x/>z<!doctype q><?php r ?></nothing>&unknown; <3""")
    assert page.elements[0].attrs == {"href": "x>y&", "b": 'c"d', "e": "f", "g": "", "h": "i"}
    assert page.raw[1] == 'if (a < b) "</div>"' and page.text(page.elements[0]) == "1 < 2"
    assert "".join(page.pieces) == "1 < 2yesz&unknown; <3"


def test_intervals_are_those_of_a_plain_tree():
    """Sizes, last links and letters of kept elements against their definition."""
    page = '<div class="category"> a <span>b</span><div class="x"><a>c</a></div><ul class="tag list"><li><a>d e</a></li></ul></div><b>f</b><p class="badge"><strong>g</strong></p><a class=tag>h</a>'
    read_, kept = read(page), P._elements(read(page))
    assert [(e["tag"], e["size"], e["last_link"], e["letters"]) for e in kept] == [("div", 5, 5, 5), ("span", 0, -1, 1), ("div", 1, 3, 1), ("a", 0, -1, 1), ("ul", 1, 5, 2), ("a", 0, -1, 2), ("p", 1, -1, 1), ("strong", 0, -1, 1), ("a", 0, -1, 1)]
    assert all("".join(read_.pieces[e["begin"] : e["end"]]).replace(" ", "") for e in kept)
    kinds = {k: [i for i, e in enumerate(kept) if e["outermost"] >> n & 1] for n, k in enumerate(P.KINDS)}
    assert kinds == {"crumbs": [0], "genre": [0], "hashtags": [], "badges": [8], "category": [0]}
