import html
import math
import random
import re
import time

import pytest

from mulberry.llm import html_text as h

SF = "/root/testdata/sf0.001"


def plain(page):
    """The article element's blocks, for pages of that one form."""
    a = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    a = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", "\n", a))
    lines = (" ".join(html.unescape(x).split()) for x in a.split("\n"))
    return "\n".join(x for x in lines if x)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = h.op2_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text)


BODY = """<header><h1>Site</h1><p>Welcome to a site with a long slogan of many words.</p></header><nav><a href=x>A</a></nav>
<div class="cookie-notice">We use cookies on this site, as everybody does.</div>{}<aside>Side bar text of some length</aside>
<section id="comments"><p>Nice article, I like it very much indeed, thank you.</p></section><form><p>Sign up for more letters</p></form><footer>(c)</footer>"""
ARTICLE = "<h2>Title &amp; more</h2><p>Para one   with\n spaces &lt;b&gt; here.<p>Para two <a href=y>link</a> tail.</p><ul><li>item 1<li>item 2</ul><div class='ad'>Buy!</div><div><p>Section text goes on and on.</p></div>"
WANT = "Title & more\nPara one with spaces <b> here.\nPara two link tail.\nitem 1\nitem 2\nSection text goes on and on."


@pytest.mark.parametrize("form", ["<main><article>{}</article></main>", "<div id='content'>{}</div>", "<article>{}</article>", "{}"])
def test_forms(form):
    assert h.main_text(f"<html><head><title>T</title></head><body>{BODY.format(form.format(ARTICLE))}</body></html>") == WANT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("plain", "plain"),
        ("a < b &copy <br>c", "a < b ©\nc"),
        ("<script>var x='</p>';</script><p>y", "y"),
        ("<p>a<!-- <p>no</p> -->b", "ab"),
        ("<div class=ad>only this</div>", "only this"),
        ("<p title='a>b'>c</p>", "c"),
        ("<article class='has-sidebar'><p>kept</p></article>", "kept"),
        ("</div></p><b>x", "x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ],
)
def test_odd_pages(page, want):
    assert h.main_text(page) == want


def test_long_and_deep(spark):
    assert len(h.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000)) == 1
    rows = [(1, "u", "<p>" + "word " * 100_000), (1, "u", None), (None, None, "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.n_chars for r in h.extract_pages(df).collect()) == [0, 1, 499_999]
    assert h.extract_pages(df.limit(0)).count() == 0


PARAGRAPHS = [f"Paragraph {i} of the article goes on and on with many words of text, and more of them still." for i in range(12)]
READERS = "".join(f"<p>{p.replace('article', 'comment')}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("name", ["content ad-free", "social-history", "post-related-science", "menu-recipes", "widget-area-main", "skip-link-target"])
def test_a_class_name_is_a_sign_only(name):
    page = f"<body><nav><a href=x>A</a></nav><div class='{name}'>{''.join(f'<p>{p}</p>' for p in PARAGRAPHS)}</div><div class='comments'>{READERS}</div><p>Copyright by the owner of this page, all rights are reserved</p></body>"
    assert h.main_text(page) == "\n".join(PARAGRAPHS)


def test_a_form_around_all_and_a_title_beside():
    page = f"<body><form><div class='post'><div class='post-header'><h1>Title</h1></div><div>{''.join(f'<p>{p}</p>' for p in PARAGRAPHS)}</div></div><div class='sidebar'>{READERS}</div></form></body>"
    assert h.main_text(page) == "\n".join(["Title", *PARAGRAPHS])
    assert h.main_text(f"<body><article><p>Short.</p></article><div class='comment-list'>{READERS * 5}</div></body>") == "Short."


@pytest.mark.parametrize("page", ["<" + "a" * 1_000_000, '<a b="x ' * 125_000, "<a '" * 250_000, '<a b=">" ' * 110_000 + "<a b='x>", '<a ">" ' * 140_000 + "'", "</script " * 110_000, "<script>" + "</script " * 110_000, "<div>" * 100_000 + "</x>" * 125_000, "<b>" * 160_000 + "<p>" * 160_000, "<b><div>" + "<i>" * 160_000 + "</b>" * 125_000, "<p class" + " " * 1_000_000 + ">x", "<a b=" + " " * 1_000_000 + '"x">y', "&#" + "9" * 1_000_000 + ";", "<" * 1_000_000])
def test_time_grows_with_the_page_only(page):
    began = time.time()
    h.main_text(page)
    assert time.time() - began < 6


def test_densities_against_their_definition():
    rng = random.Random(5)

    def tree(depth):
        kids = [tree(depth + 1) for _ in range(rng.choice([0, 1, 2, 3]) if depth < 4 else 0)]
        return (rng.choice(["div", "span", "a", "section"]) if depth else "body", "x" * rng.choice([0, 3, 40]), kids)

    def markup(t):
        return f"<{t[0]}>{t[1]}{''.join(map(markup, t[2]))}</{t[0]}>"

    def chars(t):
        return len(t[1]) + sum(map(chars, t[2]))

    def tags(t):
        return sum(1 + tags(k) for k in t[2])

    def link_chars(t):
        return chars(t) if t[0] == "a" else sum(map(link_chars, t[2]))

    def link_tags(t):
        return (t[0] == "a") + sum(map(link_tags, t[2]))

    def density(t, body):
        if not chars(t):
            return 0.0
        c, n, lc, lt = chars(t), max(tags(t), 1), link_chars(t), link_tags(t)
        base = math.log(c / max(c - lc, 1) * lc + link_chars(body) / max(chars(body), 1) * c + math.e)
        ratio = math.log(max(c / max(lc, 1) * (n / max(lt, 1)), 1.0))
        return c / n * (ratio / math.log(base) if base > 1 else ratio or 1.0)

    def walk(t):
        yield t
        for k in t[2]:
            yield from walk(k)

    for _ in range(30):
        body = tree(0)
        dom = h.Dom(markup(body))
        own = [0] * len(dom.tag)
        for x, raw in dom.flow:
            own[x] += len(raw or "")
        got, sums = h._densities(dom, [False] * len(dom.tag), own, [1.0] * len(dom.tag))
        nodes = list(walk(body))
        assert dom.tag[1:] == [t[0] for t in nodes]
        assert got[1:] == pytest.approx([density(t, body) for t in nodes])
        assert sums[1:] == pytest.approx([sum(density(k, body) for k in t[2]) for t in nodes])


LONG = [f"Paragraph {i} says a good deal about its matter, in plain words and at some length, so that nobody takes it for a menu." for i in range(12)]
CONTENT = '<div class="content">' + "".join(f"<p>{p}</p>" for p in LONG) + "</div>"
MENU, END = '<nav><a href="/a">Home</a> <a href="/b">News</a></nav>', "<footer>Imprint and terms</footer>"


@pytest.mark.parametrize(
    "before,after,more_before,more_after",
    [
        ("<h1>A title</h1>", "", ["A title"], []),
        ('<div class="post-header"><h1>A title</h1></div>', "", ["A title"], []),
        ('<div class="post-header"><h1>A title</h1><p>By nobody</p></div>', "", ["A title", "By nobody"], []),
        ("<h1>A title</h1><p>An introduction.</p>", "", ["A title", "An introduction."], []),
        ("", "<section><h2>Second</h2><p>Short.</p><p>Shorter.</p><p>End.</p></section>", [], ["Second", "Short.", "Shorter.", "End."]),
        ("", '<section><p>See also <a href="/x">this page</a> of ours, which says more.</p></section>', [], ["See also this page of ours, which says more."]),
        ("", '<section><a href="/1">One more story</a> <a href="/2">Another story</a></section>', [], []),
        ('<div class="cookie-notice">We use cookies.</div>', '<div class="sidebar">Beside.</div>', [], []),
    ],
)
def test_parts_of_an_article_beside_its_densest(before, after, more_before, more_after):
    page = f"<html><body>{MENU}{before}{CONTENT}{after}{END}</body></html>"
    assert h.main_text(page).split("\n") == [*more_before, *LONG, *more_after]


def test_sections_of_one_article():
    sections = [f"<section><h2>Part {i}</h2>" + "".join(f"<p>{p}</p>" for p in LONG[: 2 + 3 * (i == 2)]) + "</section>" for i in range(6)]
    text = h.main_text(f"<body>{MENU}<div class=x>{''.join(sections)}</div>{END}</body>").split("\n")
    assert text == [t for i in range(6) for t in [f"Part {i}", *LONG[: 2 + 3 * (i == 2)]]]


def test_comments_without_a_telling_class():
    said = [f"Reader {i} thinks that this is a long remark about the matter, with more than enough words to look like a paragraph of its own." for i in range(40)]
    comments = '<div class="x7">' + "".join(f'<div class="k"><b>reader{i}</b><span>2024-01-{i % 28 + 1:02}</span><p>{s}</p></div>' for i, s in enumerate(said)) + "</div>"
    article = "".join(f"<p>{p} {p}</p>" for p in LONG)
    assert h.main_text(f"<body>{MENU}<h1>A title</h1><div class=c>{article}</div>{comments}{END}</body>").split("\n") == ["A title", *(f"{p} {p}" for p in LONG)]
    # a page of nothing but such blocks keeps them
    blocks = h.main_text(f"<body>{MENU}{comments}{END}</body>")
    assert all(s in blocks for s in said)
