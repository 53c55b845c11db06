"""Main text of web pages by scoring their element tree.

Paragraphs pass points for their length and commas to their parent (whole) and to the
ancestors above (halved at each step), discounted by the share of linked text. The best
container is kept with those of its siblings that score a fifth of it or are plain
paragraphs; where it stands in an article or main element, that element is the container.
Page furniture is cut out before: by element, by role and by the words of class and id. Such a
word may also describe a layout ("with-sidebar"): an element with one stays where it holds all
article and main elements and a fifth of the text outside links. Where a page has none, it stays
with more than half of that text (comments: nine tenths), unless a whole name is such a word
("sidebar"). Ids do not cut headings and paragraphs.

Null, empty and text-free pages give an empty text. Markup may be broken: unclosed and stray
tags are mended as far as blocks need it. Ties go to the first container in the page. Pages
are rows of their own: repeated ones give equal results. Further columns pass through, text
and n_chars replace any of the same name. Nothing is cut by length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stepfold.llm.base import small_batches

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object")
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
PARAGRAPHS = {"p", "pre", "blockquote", "td", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Open elements that a new element of the key closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which CLOSES does not reach.
SCOPES = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "section", "div"}
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "header", "fieldset", "canvas", "audio", "video"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
FURNITURE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "pagination", "pager", "popup", "promo", "promoted", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Of these, the words of what readers wrote: often longer than the page's own text.
READER_WORDS = {"comment", "comments", "disqus", "replies", "respond"}
#: Elements whose ids are made from their text, and tell nothing.
TITLED = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"article", "main"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "main", "words", "plain", "score", "size", "linked", "points", "place")

    def __init__(self, tag: str, parent: Node | None, place: int):
        self.tag, self.parent, self.place = tag, parent, place
        self.kids: list[Node | str] = []
        self.cut = self.main = self.plain = False
        self.words: set[str] = set()
        self.score = self.points = 0.0
        self.size = self.linked = 0


def _looks(node: Node, attrs: str, in_main: bool) -> None:
    """Mark page furniture and main containers by element and attributes."""
    tag = node.tag
    node.main = tag in CONTAINERS
    node.cut = tag in FURNITURE_TAGS and not (tag == "header" and in_main)
    if not attrs.strip():
        return
    given: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        given.setdefault(name.lower(), "".join(values).lower())
    role = given.get("role", "")
    node.main |= role in ("main", "article") or given.get("itemprop") == "articlebody"
    node.cut |= role in FURNITURE_ROLES or "hidden" in given or given.get("aria-hidden") == "true"
    node.cut |= "display:none" in given.get("style", "").replace(" ", "")
    if tag not in ("html", "body", "article", "main"):
        named = given.get("class", "") + ("" if tag in TITLED else " " + given.get("id", ""))
        node.words = FURNITURE_WORDS.intersection(_WORD.findall(named))
        node.plain = not FURNITURE_WORDS.isdisjoint(named.split())


def _drop_named(root: Node) -> None:
    """Cut the elements that class or id name as furniture, unless they hold the page's text."""
    nodes = _order(root)
    if not any(n.words for n in nodes):
        return
    size: dict[Node, int] = {}
    mains: dict[Node, int] = {}
    for n in reversed(nodes):
        kids = [k for k in n.kids if isinstance(k, Node)]
        size[n] = 0 if n.tag == "a" else sum(size[k] for k in kids) + sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        mains[n] = n.main + sum(mains[k] for k in kids)

    def cut(readers: bool, enough: float) -> None:
        todo = [root]
        while todo:
            n, gone = todo.pop(), set()
            for k in [k for k in n.kids if isinstance(k, Node)]:
                if mains[root]:
                    holds = mains[k] == mains[root] and size[k] >= 0.2 * size[root]
                else:
                    holds = not k.plain and size[k] > enough * size[root]
                if k.words and bool(k.words & READER_WORDS) == readers and not holds:
                    gone.add(k)
                    up, s, m = n, size[k], mains[k]
                    while up is not None:
                        if up.tag == "a":
                            s = 0
                        size[up] -= s
                        mains[up] -= m
                        up = up.parent
                else:
                    todo.append(k)
            if gone:
                n.kids = [k for k in n.kids if k not in gone]

    cut(True, 0.9)
    cut(False, 0.5)


def parse(html: str) -> Node:
    """The element tree, closing what HTML closes by itself. Furniture keeps no content."""
    root = Node("html", None, 0)
    stack, at, place, mains = [root], 0, 0, 0

    def pop() -> None:
        nonlocal mains
        mains -= stack.pop().main

    def say(text: str) -> None:
        if text and not stack[-1].cut:
            stack[-1].kids.append(unescape(text) if "&" in text else text)

    for m in _TOKEN.finditer(html):
        say(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break  # a stray inline end does not close blocks
            continue
        if tag in ("html", "body"):
            continue
        if tag not in INLINE and tag not in VOID:
            # a block ends the paragraph it would stand in, and the inline elements within that
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag not in INLINE:
                    break
            closes = CLOSES.get(tag)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in SCOPES:
                        break
        place += 1
        node = Node(tag, stack[-1], place)
        _looks(node, m["attrs"] or "", mains > 0)
        node.cut |= stack[-1].cut
        if not node.cut:
            stack[-1].kids.append(node)
        if tag not in VOID and not (m["attrs"] or "").endswith("/"):
            stack.append(node)
            mains += node.main
    say(html[at:])
    _drop_named(root)
    return root


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def score(root: Node) -> list[Node]:
    """Sizes, link shares and points of all nodes, in page order."""
    nodes = _order(root)
    for node in reversed(nodes):
        commas = 0
        for k in node.kids:
            if isinstance(k, Node):
                node.size += k.size
                node.linked += k.size if k.tag == "a" else k.linked
                node.points += k.points if k.tag in INLINE else 0
            else:
                node.size += len(k.strip())
                commas += k.count(",") + k.count("،") + k.count("、") + k.count("，")
        node.points += commas
        if node.tag in PARAGRAPHS or node.tag == "div" and any(isinstance(k, str) and k.strip() for k in node.kids):
            if node.size:
                points = (1.0 if node.size >= 25 else 0.2) + node.points + min(node.size / 100, 3.0)
                up, share = node.parent, 1.0
                while up is not None and share > 0.01:
                    up.score += points * share
                    up, share = up.parent, share / 2
    for node in nodes:
        node.score *= 1 - node.linked / node.size if node.size else 0
    return nodes


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks below a node, in page order."""
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        k = todo.pop()
        if k is None:
            close()
        elif isinstance(k, str):
            run.append(k)
        elif k.tag == "br":
            run.append(" ")
        elif k.tag in INLINE or k.tag in ("img", "wbr"):
            todo.extend(reversed(k.kids))
        else:
            close()
            todo.append(None)
            todo.extend(reversed(k.kids))
    close()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes = score(parse(html))
    best = max(nodes, key=lambda n: (n.score, -n.place))
    if best.score <= 0:
        best = nodes[0]
    up, inside = best, None
    while up is not None:
        inside = up if up.main else inside
        up = up.parent
    out: list[str] = []
    if inside is not None:
        parent = inside.parent
        near = [k for k in parent.kids if isinstance(k, Node) and k.main and (k is inside or k.score >= 0.2 * inside.score)] if parent else [inside]
        for k in near:
            _blocks(k, out)
        return "\n\n".join(out)
    if best.parent is None:
        _blocks(best, out)
        return "\n\n".join(out)
    least = max(1.0, 0.2 * best.score)
    for k in best.parent.kids:
        if isinstance(k, str):
            continue
        plain = k.tag in PARAGRAPHS and k.size and k.linked / k.size < 0.25
        if k is best or k.score >= least or plain:
            _blocks(k, out)
    return "\n\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` with text and n_chars (code points)."""
    added = {"text": T.StringType(), "n_chars": T.LongType()}
    pages = pages.drop(*added)
    small_batches(pages.sparkSession)
    schema = T.StructType([*pages.schema.fields, *[T.StructField(n, t) for n, t in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            out = [*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *added])

    return pages.mapInArrow(run, schema)
