"""HTML pages: text by patterns, titles, links, and main content as markdown by scoring.

The patterns are native. Scoring walks the tree of a page and is done in Python, a batch of
pages at a time: paragraphs give points to their ancestors, link density takes them away, and
the best candidate with siblings of its kind becomes markdown. Where that finds too little,
the patterns' text is the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FALLBACK = 50_000
# Elements and class words that the patterns drop.
_DROP = "script|style|nav|header|footer|noscript"
_DROP_CLASS = "sidebar|ad|ads|comments"
_PLAIN = "(?is)"


def fallback_text(html: Column, most: int | None = MOST_FALLBACK) -> Column:
    """Text without scripts, menus, headers, footers, sidebars, adverts and comments; blank lines between parts."""
    c = F.regexp_replace(html, f"{_PLAIN}<({_DROP})\\b.*?</({_DROP})\\s*>", "")
    c = F.regexp_replace(c, f"{_PLAIN}<!--.*?-->", "")
    c = F.regexp_replace(c, f'{_PLAIN}<(div|section|aside)[^>]*class="[^"]*\\b({_DROP_CLASS})\\b[^"]*"[^>]*>.*?</(div|section|aside)>', "")
    c = F.regexp_replace(c, f"{_PLAIN}<title\\b.*?</title>", "")
    c = F.regexp_replace(c, "<[^>]*>", "\n")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    out = F.array_join(lines, "\n\n")
    return out if most is None else F.substring(out, 1, most)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, f"{_PLAIN}<title[^>]*>(.*?)</title>", 1))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), 1)


# Words of class and id, elements that score, and points.
_UNLIKELY = re.compile(
    r"-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote",
    re.I,
)
_MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
_GOOD = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
_BAD = re.compile(
    r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget",
    re.I,
)
_ROLES = frozenset(("menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog"))
_SCORED = frozenset(("section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre"))
_POINTS = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_SKIP = frozenset(("script", "style", "noscript", "nav", "footer", "aside", "form", "head", "template", "iframe", "svg", "button"))
_BLOCK = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
CHAR_THRESHOLD, LEAST_CHARS, DEPTH = 500, 25, 5
SMALL_IMAGE = 10
#: Elements nested deeper become siblings, as in browsers; no text is lost by that.
DEEPEST = 100


class Node:
    __slots__ = ("name", "attrs", "parent", "children", "score", "depth")

    def __init__(self, name: str, attrs: dict, parent: "Node | None"):
        self.name, self.attrs, self.parent, self.children, self.score = name, attrs, parent, [], None
        self.depth = parent.depth + 1 if parent else 0

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo.extend(reversed(n.children))
        return re.sub(r"\s+", " ", "".join(out)).strip()

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", {}, None)
        self.skip = ""

    def handle_starttag(self, name, attrs):
        if self.skip:
            return
        if name in ("script", "style"):
            self.skip = name
            return
        n = self.at
        while n is not None and n.name in ("b", "i", "em", "strong", "a", "span") and name in _BLOCK:
            n = n.parent
        if name in _BLOCK and n is not None and n.name == "p":
            self.at = n.parent
        if name == "li" and self.at.name == "li":
            self.at = self.at.parent
        node = Node(name, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if name not in _VOID and node.depth < DEEPEST:
            self.at = node

    def handle_endtag(self, name):
        if self.skip:
            self.skip = "" if name == self.skip else self.skip
            return
        n = self.at
        while n is not None and n.name != name:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        if not self.skip:
            self.at.children.append(data)


def _weight(n: Node) -> int:
    total = 0
    for key in ("class", "id"):
        v = n.attrs.get(key, "")
        total += (25 if v and _GOOD.search(v) else 0) - (25 if v and _BAD.search(v) else 0)
    return total


def _unlikely(n: Node) -> bool:
    names = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".strip()
    if n.attrs.get("role", "") in _ROLES:
        return True
    return bool(names) and n.name not in ("body", "a") and bool(_UNLIKELY.search(names)) and not _MAYBE.search(names)


def _link_density(n: Node) -> float:
    every = len(n.text())
    return sum(len(x.text()) * (0.3 if x.attrs.get("href", "").startswith("#") else 1) for x in n.walk() if x.name == "a") / every if every else 0.0


def _pruned(n: Node, strict: bool) -> None:
    n.children = [c for c in n.children if isinstance(c, str) or not (c.name in _SKIP or strict and _unlikely(c))]
    for c in n.children:
        if isinstance(c, Node):
            _pruned(c, strict)


def _best(root: Node, weigh: bool) -> Node | None:
    candidates: list[Node] = []
    for n in root.walk():
        if n.name not in _SCORED:
            continue
        text = n.text()
        if len(text) < LEAST_CHARS:
            continue
        points = 1 + len(re.split(r"[,،﹐︐︑⹁⸴⸲，]", text)) + min(len(text) // 100, 3)
        parent, level = n.parent, 0
        while parent is not None and parent.parent is not None and level < DEPTH:
            if parent.score is None:
                parent.score = _POINTS.get(parent.name, 0) + (_weight(parent) if weigh else 0)
                candidates.append(parent)
            parent.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            parent, level = parent.parent, level + 1
    for c in candidates:
        c.score *= 1 - _link_density(c)
    return max(candidates, key=lambda c: c.score, default=None)


def _inline(n: Node) -> str:
    out = []
    for c in n.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
            continue
        inner = _inline(c)
        bare = inner.strip()
        if c.name in ("b", "strong") and bare:
            out.append(f"**{bare}**")
        elif c.name in ("i", "em") and bare:
            out.append(f"_{bare}_")
        elif c.name == "code" and bare:
            out.append(f"`{bare}`")
        elif c.name == "a" and bare and c.attrs.get("href"):
            out.append(f"[{bare}]({c.attrs['href']})")
        elif c.name == "img" and c.attrs.get("src"):
            sizes = [re.match(r"\s*[+-]?\d+", c.attrs.get(side, "")) for side in ("width", "height")]
            small = any(m and int(m[0]) < SMALL_IMAGE for m in sizes)
            out.append("" if small else f"![{c.attrs.get('alt', '')}]({c.attrs['src']})")
        elif c.name == "br":
            out.append("  \n")
        else:
            out.append(inner)
    return "".join(out)


def _blocks(n: Node, out: list[str]) -> None:
    loose: list = []

    def flush() -> None:
        if loose:
            text = _inline(_holder(loose)).strip()
            if text:
                out.append(text)
            loose.clear()

    for c in n.children:
        if isinstance(c, str) or c.name not in _BLOCK and not any(x.name in _BLOCK for x in c.walk()):
            loose.append(c)
            continue
        flush()
        if c.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            if text := _inline(c).strip():
                out.append(f"{'#' * int(c.name[1])} {text}")
        elif c.name == "blockquote":
            inner: list[str] = []
            _blocks(c, inner)
            out.append("\n".join(f"> {line}" if line else ">" for line in "\n\n".join(inner).split("\n")))
        elif c.name in ("ul", "ol"):
            items = [x for x in c.children if isinstance(x, Node) and x.name == "li"]
            rows = []
            for k, item in enumerate(items, 1):
                inner = []
                _blocks(item, inner)
                mark = f"{k}. " if c.name == "ol" else "- "
                rows.append(mark + "\n".join(inner).replace("\n", "\n    "))
            if rows:
                out.append("\n".join(rows))
        elif c.name == "pre":
            raw = "".join(x if isinstance(x, str) else x.text() for x in c.children)
            out.append(f"```\n{raw.strip()}\n```")
        elif c.name == "hr":
            out.append("---")
        elif c.name == "table":
            rows = []
            for r in c.walk():
                if r.name == "tr":
                    cells = []
                    for x in r.children:
                        if isinstance(x, Node) and x.name in ("td", "th"):
                            inner = []
                            _blocks(x, inner)
                            cells.append(f" {'\n\n'.join(inner).strip()} |")
                    rows.append("|" + "".join(cells))
            lines = "\n".join(rows).strip().split("\n")
            # a line below the first row, whatever it is, as wide as that
            out.append("\n".join([lines[0], "|" + " --- |" * (lines[0].count("|") - 1), *lines[1:]]))
        else:
            _blocks(c, out)
    flush()


def _holder(children: list) -> Node:
    n = Node("span", {}, None)
    n.children = list(children)
    return n


def readable(html: str) -> tuple[str, str]:
    """(title, markdown) of the main content; '' where no attempt finds any."""
    best = ""
    heading = re.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
    for strict, weigh in ((True, True), (False, True), (False, False)):
        b = _Builder()
        try:
            b.feed(html or "")
            b.close()
        except AssertionError:  # a malformed declaration: the patterns' text is the answer
            break
        _pruned(b.root, strict)
        top = _best(b.root, weigh)
        if top is None:
            continue
        out: list[str] = []
        _blocks(top, out)
        text = "\n\n".join(out)
        if len(text) > len(best):
            best = text
        if len(best) >= CHAR_THRESHOLD:
            break
    return re.sub(r"\s+", " ", heading[1]).strip() if heading else "", best


def main_markdown(pages: DataFrame) -> DataFrame:
    """page_id, title and markdown; the patterns' text where scoring finds nothing."""
    rows = pages.select("page_id", "html", fallback_text(F.col("html"), most=None).alias("fallback"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [readable(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "title": [t for t, _ in got], "markdown": [m or x for (_, m), x in zip(got, f["fallback"])]})

    return rows.mapInPandas(run, "page_id bigint, title string, markdown string")
