"""HTML readers on the standard library's tolerant parser, applied as Arrow UDFs.

Every reader maps a broken page to an empty result or an error column, never to a failed task: no reader recurses, JSON that
is malformed or nested too deeply counts as absent, and a listing row of an unexpected shape is left out alone.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from html.parser import HTMLParser

import pandas as pd
from dateutil import parser as lenient
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags dropped inside an article, tags that never nest, meta properties that carry a publish time.
CHROME = {"script", "style", "nav", "header", "footer", "aside", "iframe", "figure"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
TIME_PROPERTIES = ("article:published_time", "og:article:published_time")
_BLOCK = {"p", "div", "section", "article", "ul", "ol", "li", "table", "h1", "h2", "h3", "h4", "h5", "h6", "form", "nav", "header", "footer", "aside", "figure"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        """Elements below in document order, without recursion."""
        stack = [iter(self.kids)]
        while stack:
            for kid in stack[-1]:
                if isinstance(kid, Node):
                    yield kid
                    stack.append(iter(kid.kids))
                    break
            else:
                stack.pop()

    def texts(self, skip=frozenset()):
        stack = [iter(self.kids)]
        while stack:
            for kid in stack[-1]:
                if isinstance(kid, str):
                    yield kid
                elif kid.tag not in skip:
                    stack.append(iter(kid.kids))
                    break
            else:
                stack.pop()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def _close(self, tags):
        node = self.at
        while node.parent is not None:
            if node.tag in tags:
                self.at = node.parent
                return
            if node.tag in ("article", "div", "section", "body", "td"):
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:  # an open paragraph ends where a block begins
            self._close({"p"})
        if tag == "li":
            self._close({"li"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except (AssertionError, ValueError):
        pass
    return tree.root


def joined(node: Node, sep: str = "", skip=frozenset()) -> str:
    return sep.join(t for t in (x.strip() for x in node.texts(skip)) if t)


def _json(text: str | None):
    """The parsed value, or None for text that is not JSON or is nested deeper than the parser goes."""
    try:
        return json.loads(text or "")
    except (ValueError, RecursionError):
        return None


def _densest(nodes: list[Node]) -> Node | None:
    """The div or section with most text, the first on ties; text lengths are summed from the leaves up in one pass."""
    size: dict[int, int] = {}
    for n in reversed(nodes):  # document order puts parents first, so in reverse a node's length is whole when it is met
        own = size.get(id(n), 0) + sum(len(k.strip()) for k in n.kids if isinstance(k, str))
        size[id(n)] = own
        if n.parent is not None:
            size[id(n.parent)] = size.get(id(n.parent), 0) + own
    return max((n for n in nodes if n.tag in ("div", "section")), key=lambda n: size[id(n)], default=None)


def _body(nodes: list[Node]) -> str:
    node = next((n for n in nodes if n.tag == "article"), None) or next((n for n in nodes if n.attrs.get("itemprop") == "articleBody"), None) or _densest(nodes)
    if node is None:
        return ""
    dropped, paragraphs = set(), []
    for n in node.walk():
        if n.tag in CHROME or id(n.parent) in dropped:
            dropped.add(id(n))
        elif n.tag == "p":
            paragraphs.append(joined(n, "", CHROME))
    return "\n".join(p for p in paragraphs if p) or joined(node, "\n", CHROME)


def _times(nodes: list[Node]) -> list[str]:
    linked, by_property, by_name, elements = [], {}, {}, []
    for n in nodes:
        a = n.attrs
        if n.tag == "script" and a.get("type") == "application/ld+json":
            found = _json("".join(n.texts()))
            linked += [x.get("datePublished") for x in (found if isinstance(found, list) else (found,)) if isinstance(x, dict)]
        elif n.tag == "meta":
            by_property.setdefault(a.get("property"), a.get("content"))
            by_name.setdefault(a.get("name"), a.get("content"))
        elif n.tag == "time":
            elements.append(a.get("datetime"))
    ranked = linked + [by_property.get(p) for p in TIME_PROPERTIES] + [by_name.get("pubdate")] + elements
    return [str(x) for x in ranked if x]


def body_text(html: str | None) -> str:
    """Article text: located first, chrome dropped after; paragraphs by line, else all text; '' if nothing is found."""
    return _body(list(parse(html).walk()))


def time_candidates(html: str | None) -> list[str]:
    """Publish times a page states, most trusted first: JSON-LD, two meta properties, meta pubdate, time elements."""
    return _times(list(parse(html).walk()))


def article(html: str | None) -> dict:
    """Body and time candidates of a page that is parsed once; dates in unusual forms are rewritten as ISO 8601."""
    nodes = list(parse(html).walk())
    return {"body": _body(nodes), "times": [iso_date(t) or t for t in _times(nodes)]}


def anchors(html: str | None) -> list[dict]:
    return [{"pos": i, "href": n.attrs["href"], "title": joined(n)} for i, n in enumerate(n for n in parse(html).walk() if n.tag == "a" and "href" in n.attrs)]


def untagged(tree):
    """Plain data of component props, where each value travels as a pair of a type number and a payload.

    Type 0 wraps a scalar or an object, type 1 a list of further pairs; the payload of any other type (dates, sets, patterns)
    is left as it came. Slots still to be read wait on a list, so depth costs no recursion.
    """
    top = [tree]
    slots: list[tuple] = [(top, 0)]
    while slots:
        holder, at = slots.pop()
        value, opaque = holder[at], False
        while isinstance(value, list) and len(value) == 2 and isinstance(value[0], int) and not opaque:
            kind, value = value
            if kind:
                opaque = kind != 1 or not isinstance(value, list)
                break
        if not opaque and isinstance(value, dict | list):
            value = value.copy()
            slots += [(value, k) for k in (value if isinstance(value, dict) else range(len(value)))]
        holder[at] = value
    return top[0]


def _listing_row(item) -> dict | None:
    """href, title and epoch of one listing entry; None for a hollow one, no epoch where it is not a number."""
    entry = item if isinstance(item, dict) else {}
    title, key = str(entry.get("title") or "").strip(), entry.get("articleId")
    stamp = entry.get("publishedAt")
    digits = str(stamp).partition(".")[0] if isinstance(stamp, int | float | str) and not isinstance(stamp, bool) else ""
    epoch = int(digits) if digits.isdecimal() and 0 < len(digits) <= 12 else None
    return {"href": str(entry.get("articleUrl") or f"/news/{key}"), "title": title, "epoch": epoch or None} if title and key else None


def island_rows(html: str | None, island: str = "RealTimeList") -> dict:
    """Listing rows in a component's props, or an error text when the component is missing or unreadable."""
    found = [n.attrs.get("props") for n in parse(html).walk() if n.tag == "astro-island" and island in n.attrs.get("component-url", "")]
    if not found:
        return {"error": f"no {island} island found", "rows": []}
    data = untagged(_json(found[0]))
    for name in ("initialArticles", "data"):
        if not isinstance(data, dict):
            return {"error": f"unreadable props of {island}", "rows": []}
        data = data.get(name) or ({} if name == "initialArticles" else [])
    rows = map(_listing_row, data) if isinstance(data, list) else ()
    return {"error": None, "rows": [r for r in rows if r]}


def iso_date(text: str | None) -> str | None:
    """ISO form of a date that only a lenient parser reads; None for ISO itself, for no date, and for a date without a day.

    Fields that the text leaves out would come from the clock of the machine, so two defaults must agree.
    """
    if not text or re.match(r"\s*\d{4}[-/]\d\d?[-/]\d\d?", text):
        return None
    try:
        a, b = (lenient.parse(text, default=dt.datetime(y, m, d)) for y, m, d in ((2000, 1, 1), (2004, 2, 2)))
        return a.isoformat(sep=" ") if a == b else None
    except (ValueError, OverflowError, TypeError, AttributeError, RecursionError):
        return None


_ANCHORS = T.ArrayType(T.StructType().add("pos", "integer").add("href", "string").add("title", "string"))
_ISLAND = T.StructType().add("error", "string").add("rows", T.ArrayType(T.StructType().add("href", "string").add("title", "string").add("epoch", "long")))
_ARTICLE = T.StructType().add("body", "string").add("times", T.ArrayType(T.StringType()))


@F.pandas_udf(T.StringType())
def extract_body(html: pd.Series) -> pd.Series:
    return html.map(body_text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def published_candidates(html: pd.Series) -> pd.Series:
    return html.map(time_candidates)


@F.pandas_udf(_ARTICLE)
def read_article(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([article(h) for h in html], columns=["body", "times"])


@F.pandas_udf(_ANCHORS)
def extract_anchors(html: pd.Series) -> pd.Series:
    return html.map(anchors)


@F.pandas_udf(_ISLAND)
def extract_island(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([island_rows(h) for h in html], columns=["error", "rows"])


@F.pandas_udf(T.StringType())
def lenient_date(text: pd.Series) -> pd.Series:
    """ISO form of dates in unusual forms, for ``free_datetime``; other texts stay."""
    return text.map(lambda t: iso_date(t) or t, na_action="ignore")
