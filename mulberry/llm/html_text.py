"""Main text of web pages by composite text density (F. Sun, D. Song, L. Liao, "DOM Based Content Extraction via Text Density", 2011).

Every node of the DOM gets its characters per tag, adjusted by the share of
characters and tags in links.  A node's density sum is the sum of its
children's densities.  The least density on the path from the node of the
largest sum up to the body is the threshold; in every subtree that reaches it
the node of the largest sum is content, with all below it.

Scripts, hidden elements and the like are never content.  Elements that look
apart by their name, role or class (menus, comments, adverts) have their
densities lowered before the largest sum is sought, the more the surer the
sign.  Where the largest sum lies within one of them all the same, it was no
sign of anything there; the others are taken out.  Blocks of one shape that
repeat beside each other, as readers' comments do, are a weak sign.

The threshold comes from one densest element, so shorter parts of the same
article beside it can fall below.  What stands beside it without any sign, and
isn't mostly links, belongs to it, unless the page itself names its article.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.llm.common import table

# Elements of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "br", "option", "body", "html", "head"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table select div article section main body html aside nav header footer form".split())
# What is never part of an article, and what is a sign of being none.
NEVER_TAGS = frozenset("head button select input object canvas audio video".split()) | RAW
APART_TAGS = frozenset("nav header footer aside form dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer colophon share sharing social related recommended recommendations widget widgets skip".split()
)
READER_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
ARTICLE_WORDS = frozenset("post entry article story content title hentry".split())
HOLDERS = frozenset("div section article main body td center blockquote dd form aside #root".split())
NEVER_APART = frozenset("html body main article #root".split())
#: What is left of a density by the sign: readers' comments, a name or role or class of its own, a class among others or a repeated shape.
READERS, SURE, UNSURE = 0.0002, 0.05, 0.2
#: Blocks of one shape beside each other from which they are a list of comments or the like.
REPEATED = 5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b\s{0,9}(?:=\s{0,9}(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_CLASS = re.compile(r"""\bclass\s{0,9}=\s{0,9}(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_MODIFIER = re.compile(r"\b(?:has|with|no|without|is)[-_]", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL, _SIMPLE = re.compile("[>\"']"), re.compile("[^>\"']{0,200}>")
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{8,});?")


def unescaped(text: str) -> str:
    """A text with its character references decoded; numbers beyond all characters become U+FFFD."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def sign(tag: str, attrs: str, in_article: bool) -> float:
    """What is left of an element's density by its name, role and class: 0 if it is never content, 1 if nothing speaks against it."""
    if tag in NEVER_APART:
        return 1.0
    if tag in NEVER_TAGS:
        return 0.0
    out = SURE if tag in APART_TAGS and not (in_article and tag == "header") else 1.0
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return out
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), unescaped(m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 0.0
        if name == "style" and re.search(r"display\s{0,9}:\s{0,9}none|visibility\s{0,9}:\s{0,9}hidden", value):
            return 0.0
        if name == "role" and value in APART_ROLES:
            out = min(out, SURE)
        if name in ("class", "id"):
            for word in value.split():
                parts = set() if _MODIFIER.match(word) else set(_PART.findall(word))
                if parts & READER_WORDS:
                    out = min(out, READERS)
                elif parts & APART_WORDS or parts & HEAD_WORDS and not parts & ARTICLE_WORDS:
                    out = min(out, SURE if len(parts) == 1 else UNSURE)
    return out


class Dom:
    """Nodes in page order as parallel lists; node 0 is the root.  ``flow`` holds (node, text) and (node, None) where a block begins or ends.

    One pass over the page: what a tag needs of it is found once, whatever
    is left open or never closed.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.sign, self.css = ["#root"], [-1], [1.0], [""]
        self.flow: list[tuple[int, str | None]] = []
        self.body = 0
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.special: tuple[int, int] = (0, -1)
        self.dead: set[int] = set()
        self._parse(page)

    def _next_special(self, at: int) -> int:
        start, found = self.special
        if not start <= at <= found:
            m = _SPECIAL.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.special = (at, found)
        return found

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag; within the quotes of a value it doesn't.  Where quotes are never closed the next one; -1 if there is none."""
        page, seen = self.page, []
        m = _SIMPLE.match(page, at)
        if m:
            return m.end() - 1
        i = self._next_special(at)
        while i < len(page) and i not in self.dead:
            if page[i] == ">":
                return i
            seen.append(i)
            j = i - 1
            while page[j].isspace():
                j -= 1
            if page[j] == "=":
                if i >= self.last[page[i]]:
                    break
                i = page.find(page[i], i + 1)
            m = _SPECIAL.search(page, i + 1)
            i = m.start() if m else len(page)
        self.dead.update(seen)
        return page.find(">", at) if at <= self.last[">"] else -1

    def _add(self, tag: str, attrs: str, parent: int, article: bool) -> int:
        self.tag.append(tag)
        m = _CLASS.search(attrs) if "class" in attrs.lower() else None
        self.css.append(m[1] or m[2] or m[3] or "" if m else "")
        self.parent.append(parent)
        self.sign.append(sign(tag, attrs, article))
        return len(self.tag) - 1

    def _parse(self, page: str) -> None:
        at, n = 0, len(page)
        flow, tags, parents = self.flow, self.tag, self.parent
        stack, article = [0], 0
        open_tags: dict[str, int] = {}  # in the whole stack
        levels: list[dict[str, int]] = [{}]  # since each scope began

        def push(node: int) -> None:
            nonlocal article
            name = tags[node]
            stack.append(node)
            open_tags[name] = open_tags.get(name, 0) + 1
            levels[-1][name] = levels[-1].get(name, 0) + 1
            article += name in ("article", "main")
            if name in SCOPES:
                levels.append({})

        def pop() -> int:
            nonlocal article
            node = stack.pop()
            name = tags[node]
            if name in SCOPES:
                levels.pop()
            open_tags[name] -= 1
            levels[-1][name] -= 1
            article -= name in ("article", "main")
            return node

        while at < n:
            begin = page.find("<", at)
            if begin < 0:
                flow.append((stack[-1], page[at:]))
                break
            after = page[begin + 1 : begin + 2]
            if after in ("!", "?"):
                if page.startswith("<!--", begin):
                    end = page.find("-->", begin + 4)
                    end = n if end < 0 else end + 3
                else:
                    end = page.find(">", begin) + 1 or n
                if begin > at:
                    flow.append((stack[-1], page[at:begin]))
                at = end
                continue
            closing = after == "/"
            m = _NAME.match(page, begin + 1 + closing)
            if m is None:
                end = page.find("<", begin + 1)
                end = n if end < 0 else end
                flow.append((stack[-1], page[at:end]))
                at = end
                continue
            end = self._tag_end(m.end())
            if end < 0:  # no tag ends here any more: all is text
                flow.append((stack[-1], page[at:]))
                break
            if begin > at:
                flow.append((stack[-1], page[at:begin]))
            at = end + 1
            name, attrs = m[0].lower(), page[m.end() : end]
            if closing:
                inline = name in ("p", "b", "i", "a", "span", "em", "strong", "li")
                if (levels[-1] if inline else open_tags).get(name, 0):
                    while True:
                        node = pop()
                        if tags[node] in BLOCKS:
                            flow.append((parents[node], None))
                        if tags[node] == name:
                            break
                continue
            ended = ENDED_BY.get(name, ("p",) if name in CLOSES_P else ())
            while any(levels[-1].get(x, 0) for x in ended):
                while True:
                    node = pop()
                    if tags[node] in ended:
                        break
                flow.append((parents[node], None))
                if name not in ("tr", "li", "dt", "dd"):
                    break
            if name in ("html", "body") and (name == "html" or self.body):
                continue  # only one of each; the root stands for html
            node = self._add(name, attrs, stack[-1], article > 0)
            if name == "body":
                self.body = node
            if name in BLOCKS:
                flow.append((stack[-1], None))
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else n
            elif name not in VOID and not attrs.endswith("/"):
                push(node)


def _densities(dom: Dom, apart: list[bool], chars: list[int], left: list[float]) -> tuple[list[float], list[float]]:
    """Composite density and density sum of every node; ``left`` is what is left of each node's density."""
    n, parent, tags = len(dom.tag), dom.parent, dom.tag
    c, t, lc, lt = list(chars), [0] * n, [0] * n, [0] * n
    for x in range(n - 1, -1, -1):
        if apart[x]:
            c[x] = 0
            continue
        if tags[x] == "a":
            lc[x], lt[x] = c[x], lt[x] + 1
        if x:
            p = parent[x]
            c[p] += c[x]
            t[p] += t[x] + 1
            lc[p] += lc[x]
            lt[p] += lt[x]
    body_share = lc[dom.body] / max(c[dom.body], 1)
    density, total = [0.0] * n, [0.0] * n
    for x in range(n - 1, -1, -1):
        if apart[x] or not c[x]:
            continue
        per_tag = c[x] / max(t[x], 1)
        base = math.log(c[x] / max(c[x] - lc[x], 1) * lc[x] + body_share * c[x] + math.e)
        ratio = c[x] / max(lc[x], 1) * (max(t[x], 1) / max(lt[x], 1))
        # a base of 1 (no link on the page) leaves the logarithm to it undefined: natural there
        density[x] = per_tag * (math.log(max(ratio, 1.0)) / math.log(base) if base > 1 else math.log(max(ratio, 1.0)) or 1.0)
        density[x] *= left[x]
        if x:
            total[parent[x]] += density[x]
    return density, total


def _repeated(dom: Dom) -> list[int]:
    """Blocks that stand beside REPEATED or more of the same shape: of one tag and class and with the same children, several, at least one a block, none a heading."""
    n, children = len(dom.tag), [[] for _ in dom.tag]
    for x in range(1, n):
        children[dom.parent[x]].append(x)
    shapes: dict[tuple, list[int]] = {}
    for x in range(1, n):
        own = [dom.tag[c] for c in children[x]]
        if dom.tag[x] in ("div", "section", "article", "li", "dd") and 2 <= len(own) <= 12 and not HEADINGS & set(own) and {"p", "div", "blockquote"} & set(own):
            shapes.setdefault((dom.parent[x], dom.tag[x], dom.css[x], tuple(dict.fromkeys((t, dom.css[c]) for t, c in zip(own, children[x], strict=True)))), []).append(x)
    return [x for same in shapes.values() if len(same) >= REPEATED for x in same]


def _apart(dom: Dom, chars: list[int], inside: list[bool]) -> list[bool]:
    """Which nodes are no content by any sign, their own or of one that they are in.

    A sign counts for nothing where the largest density sum of the page, of
    densities lowered by the signs, lies within.
    """
    n, parent = len(dom.tag), dom.parent
    signs = list(dom.sign)
    for x in _repeated(dom):
        signs[x] = min(signs[x], UNSURE)
    left = list(signs)
    for x in range(1, n):
        left[x] = min(left[x], left[parent[x]])
    never = [v == 0 for v in left]
    if any(0 < v < 1 and c for v, c in zip(left, chars, strict=True)):
        _, total = _densities(dom, never, chars, left)
        x = max((x for x in range(n) if inside[x] and dom.tag[x] in HOLDERS), key=lambda x: total[x], default=0)
        while x > 0 and total[x] >= 0:
            if signs[x] > 0:
                signs[x] = 1.0
            x = parent[x]
    out = [v < 1 for v in signs]
    for x in range(1, n):
        out[x] = out[x] or out[parent[x]]
    return out


def main_text(page: str | None) -> str:
    """The article of a page: blocks parted by line feeds."""
    if not page:
        return ""
    dom = Dom(page)
    n, parent = len(dom.tag), dom.parent
    chars = [0] * n
    pieces: list[tuple[int, str | None]] = []
    for x, raw in dom.flow:
        if raw is not None:
            raw = unescaped(raw)
            chars[x] += len(raw) - raw.count(" ") - raw.count("\n") if raw.strip() else 0
        pieces.append((x, raw))
    top = dom.body
    inside = [not top] * n
    inside[top] = True
    for x in range(top + 1, n):
        inside[x] = inside[x] or inside[parent[x]]
    apart = _apart(dom, chars, inside)
    if not any(chars[x] and not apart[x] for x in range(n)):
        # all was taken out by name or class: only what is never shown stays out
        apart = [False] * n
        for x in range(1, n):
            apart[x] = apart[parent[x]] or dom.tag[x] in RAW or dom.tag[x] == "head"
    density, total = _densities(dom, apart, chars, [1.0] * n)
    # the first element of the largest sum in each subtree; a paragraph or a list alone is no article
    best = list(range(n))
    sums = [total[x] if dom.tag[x] in HOLDERS else 0.0 for x in range(n)]
    for x in range(n - 1, 0, -1):
        p = parent[x]
        if inside[x] and not apart[x] and sums[best[x]] > 0 and sums[best[x]] >= sums[best[p]] and sums[best[x]] > sums[p]:
            best[p] = best[x]
    # an element inside one that the page names its article stands for that one
    whole = list(range(n))
    for x in range(1, n):
        p = whole[parent[x]]
        if dom.tag[p] == "article" or dom.tag[p] == "main" and dom.tag[x] != "article":
            whole[x] = p
    winner = x = best[top] = whole[best[top]]
    threshold = density[x]
    while x != top:
        x = parent[x]
        threshold = min(threshold, density[x])
    content = [False] * n
    for x in range(n):
        if inside[x] and not apart[x]:
            if x and content[parent[x]]:
                content[x] = True
            elif chars[x] or density[x]:
                if density[x] >= threshold:
                    content[whole[best[x]]] = True
    # what has no sign against it and is not mostly links
    held, linked = list(chars), [0] * n
    for x in range(n - 1, 0, -1):
        if not apart[x]:
            held[parent[x]] += held[x]
            linked[parent[x]] += held[x] if dom.tag[x] == "a" else linked[x]
    told = [not apart[x] and held[x] > 0 and 2 * linked[x] <= held[x] for x in range(n)]
    # a title that leads up to the content, in an element beside it
    leads = [False] * n
    for x in range(n - 1, 0, -1):
        leads[x] = (leads[x] or dom.tag[x] == "h1") and told[x]
        leads[parent[x]] = leads[parent[x]] or leads[x]
    first: dict[int, int] = {}
    for x in range(n - 1, 0, -1):
        if content[x] and not apart[x]:
            first[parent[x]] = x
    for x in range(1, n):
        if leads[x] and x < first.get(parent[x], 0) and inside[x]:
            content[x] = True
    # parts of the article beside its densest one; directly in the body only what follows a title before it, and sections
    if dom.tag[winner] not in ("article", "main", "body", "#root"):
        titled = parent[winner] != top
        for x in range(1, n):
            if parent[x] == parent[winner] and inside[x] and told[x]:
                titled = titled or leads[x] and x < winner
                content[x] = content[x] or titled and x < winner or parent[winner] != top or dom.tag[x] in ("section", "article")
    for x in range(n):
        content[x] = (content[x] or x > 0 and content[parent[x]]) and not apart[x]
    blocks, line = [], []
    for x, raw in pieces:
        if raw is None:
            if line:
                blocks.append(" ".join("".join(line).split()))
                line = []
        elif content[x]:
            line.append(raw)
    blocks.append(" ".join("".join(line).split()))
    return "\n".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have the empty text, and so have pages of nothing but
    markup.  Repeated rows give repeated rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": list(map(len, texts))}, index=pdf.index)

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
