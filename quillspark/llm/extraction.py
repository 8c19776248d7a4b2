"""Main text of HTML pages by two passes of block rules.

A page is cut into blocks at block elements. Elements that by their name, role, class or id aren't text (menus,
headers, footers, sidebars, notices, adverts, forms, comments) set apart all that is in them, articles too. Names can be
wrong, so all but the surest of these are weighed first: one that holds most of the page's plain long blocks, with
its headline or article or with hardly any text beside it, is what stands round the text, and sets nothing apart.
Comments count as text only on a page that has no other.

The first pass decides blocks by where they stand, by link density, and by length with stop-word density.
How many stop words a text has depends on its language, so the bounds go down with the
page's own density, and pages in languages without a list are decided by length and links. Blocks that are
short, or long with few stop words, stay ambiguous. The second pass gives each of those the
label of its nearest decided neighbours in the same section; in an article without decided
blocks they are text, as an article is what a page is for, and so are unlinked ones of a page without any text.

Blocks have their character references decoded and white space turned into single spaces,
and are joined by a line feed. Null and empty pages have the text ''. Cut pages end where
they end. Repeated rows give repeated results. Other columns stay as they are.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.common import appended

SHORT = 70
LINKED = 0.5
STOP_HIGH = 0.2
STOP_LOW = 0.1
#: Parts of the page's own density of stop words that these bounds don't exceed.
HIGH_PART, LOW_PART = 0.6, 0.3
#: The part of the page's plain text that an element must hold to stand round it; how many times the text beside it, if it has neither headline nor article.
MOST, OTHERS = 0.5, 9

# Frequent words of ten languages.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with be by this at from or an not have but
    le la les de des du un une et en que qui est dans pour par sur au avec ne pas il elle ce
    der die das und ist in den von zu mit sich des auf für ein eine im dem nicht als auch es
    el los las y una por con para del se lo su al más como o pero
    di il che è non della dei nel sono gli alla o os da em um uma não mais dos ao foi het een van niet dat op zijn voor met aan
    och att som på är av till inte med w na z że nie jest się do jak и в не на что с он как это по но из у за от""".split()
)
# Elements.
_RAW = "script|style|noscript|template|svg|iframe|object|canvas|textarea|title|select|audio|video"
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section
    summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements that are never text; those that are weighed.
_NEVER = frozenset("nav menu dialog button label head search".split())
_APART = frozenset("footer aside form fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that mark what isn't text; what marks comments; words that give way to
# others in the attribute; these others; words that say that a layout has a part, not that it is one.
_MARKS = frozenset(
    """nav navbar navigation menu menubar footer sidebar aside widget ad ads adv advert adverts advertisement
    advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe
    signup social share sharing related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar copyright disclaimer
    login contentinfo complementary alert notice notices notification masthead topbar skip skiplink outbrain taboola tracking feedback""".split()
)
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())
_WEAK = frozenset("header head side search form foot bar".split())
_STRONG = frozenset("article post entry content main body story text title".split())
_LAYOUT = frozenset("with without has have no open closed enabled disabled".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    rf"|<(?P<raw>{_RAW})\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/!?][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_RIGHTS = re.compile(r"(©|\(c\)\s|copyright\b|all rights reserved)", re.I)


class Apart:
    """An element that sets apart what is in it, unless it turns out to stand round the text."""

    __slots__ = ("kind", "up", "mass", "anchors", "own", "any", "heads", "sections", "held")

    def __init__(self, kind: str, up: Apart | None):
        self.kind, self.up = kind, up
        self.mass = self.own = 0  # plain text in all of it, and outside other such elements
        self.any = self.sections = 0  # any text there, and of articles there
        self.anchors = self.heads = 0  # headlines and articles in all of it, and there
        self.held = True


def kind_of(name: str, rest: str) -> str | None:
    """How sure an element's name or attributes say that it isn't text: never, comments or perhaps."""
    if name in _NEVER:
        return "never"
    found = "perhaps" if name in _APART else None
    if not rest.strip():
        return found
    tokens: list[set[str]] = []
    for key, *values in _ATTRIBUTE.findall(rest):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "never"
        if key in ("class", "id", "role"):
            tokens += [{w.lower() for w in _PART.findall(t)} for t in value.split()]
    words = set().union(*tokens)
    marking = [t for t in tokens if t & (_MARKS | _COMMENTS) and not t & _LAYOUT]
    if any(t & _COMMENTS for t in marking):
        return "comments"
    return "perhaps" if marking or words & _WEAK and not words & _STRONG else found


class Block:
    __slots__ = ("text", "linked", "within", "section", "label")

    def __init__(self, text: str, linked: int, within: Apart | None, section: int):
        self.text, self.linked, self.within, self.section, self.label = text, linked, within, section, None

    @property
    def apart(self) -> bool:
        return self.within is not None and self.within.held

    def long(self) -> bool:
        """Characters of scripts that write words with one or two count thrice."""
        return len(self.text) >= SHORT or len(self.text) + 2 * len(_WIDE.findall(self.text)) >= SHORT

    def density(self) -> float:
        words = self.text.lower().split()
        return sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / max(1, len(words))


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text; it is known of each whether it is apart."""
    found: list[Block] = []
    aparts: list[Apart] = []
    anchors: list[Apart | None] = []  # what headlines and articles are in
    # open elements: name, what sets it apart, section
    stack: list[tuple[str, Apart | None, int]] = [("", None, 0)]
    opened: Counter = Counter()  # of the stack's names
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = sections = 0  # in_link: how deep the stack was when the open anchor began

    def text_of(raw: list[str]) -> str:
        return _SPACE.sub(" ", html.unescape("".join(raw))).strip()

    def flush() -> None:
        if parts:
            if text := text_of(parts):
                found.append(Block(text, len(text_of(link_parts)) if link_parts else 0, stack[-1][1], stack[-1][2]))
            parts.clear()
            link_parts.clear()

    def take(raw: str) -> None:
        if raw:
            parts.append(raw)
            if in_link:
                link_parts.append(raw)

    def push(name: str, kind: str | None, section: int) -> None:
        within = stack[-1][1]
        # in what is never text nothing is weighed, nor is the same again
        if kind and not (within and (within.kind == "never" or within.kind == kind == "comments")):
            within = Apart(kind, within)
            aparts.append(within)
        stack.append((name, within, section))
        opened[name] += 1

    def pop(size: int) -> None:
        while len(stack) > size:
            opened[stack.pop()[0]] -= 1

    at = 0
    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            in_link = 0 if m["close"] else len(stack)
        elif name == "br":
            take(" ")
        elif name in _BLOCKS or name in ("button", "label"):
            flush()
            if name in _VOID:
                continue
            if not m["close"]:
                if stack[-1][0] == "p":
                    pop(len(stack) - 1)
                    in_link = min(in_link, len(stack))
                if name in ("article", "main"):
                    sections += 1
                    push(name, kind_of("", m["rest"]), sections)
                    anchors.append(stack[-1][1])
                elif name == "body":
                    pop(1)
                    push(name, None, 0)
                    in_link = 0
                elif name == "header":
                    push(name, kind_of("", m["rest"]) or (None if stack[-1][2] else "never"), stack[-1][2])
                elif not m["rest"].endswith("/"):
                    push(name, kind_of(name, m["rest"]), stack[-1][2])
                    if name == "h1":
                        anchors.append(stack[-1][1])
            elif opened[name]:
                inner = name in ("p", "li", "div", "td", "tr")
                k = len(stack) - 1
                while stack[k][0] != name and not (inner and stack[k][0] in ("article", "main")):
                    k -= 1
                if stack[k][0] == name:
                    pop(k)
            if in_link > len(stack):  # an anchor ends with what it is in
                in_link = 0
    take(page[at:])
    flush()
    weigh(found, aparts, anchors)
    return found


def weigh(found: list[Block], aparts: list[Apart], anchors: list[Apart | None]) -> None:
    """Decides which of aparts hold, from the outermost in; they stand in the order in which they begin."""
    if not aparts:
        return
    free = [b for b in found if b.linked <= LINKED * len(b.text)]
    plain = [b for b in free if b.linked <= LINKED * len(b.text) / 2 and b.long()]
    out: dict[int, bool] = {}  # whether it is, or is in, what is no text for sure
    for a in aparts:
        out[id(a)] = a.kind in ("never", "comments") or a.up is not None and out[id(a.up)]
    alone = all(b.within and out[id(b.within)] for b in plain)  # there is nothing but comments
    if alone:
        for a in aparts:
            out[id(a)] = a.kind == "never" or a.up is not None and out[id(a.up)]
    every = Apart("", None)  # the page
    for b in free:
        to = b.within or every
        to.any += len(b.text)
        to.sections += len(b.text) if b.section else 0
    for b in plain:
        if b.within is None or not out[id(b.within)]:
            to = b.within or every
            to.mass += len(b.text)
            to.own += len(b.text)
    for x in anchors:
        if x is None or not out[id(x)]:
            (x or every).anchors += 1
            (x or every).heads += 1
    for a in reversed(aparts):
        up = a.up or every
        up.mass += a.mass
        up.anchors += a.anchors
    for a in aparts:
        up = a.up or every
        if out[id(a)] or a.up is not None and a.up.held:
            continue
        told = up.sections or up.heads and up.own  # the text is beside it
        large = a.mass and a.mass >= MOST * every.mass and not told
        a.held = not (large and (a.anchors and a.mass >= 2 * up.own or a.mass >= OTHERS * up.any) or alone and a.kind == "comments")


def decide(found: list[Block]) -> None:
    """Both passes."""
    free = [b for b in found if not b.apart and b.linked <= LINKED * len(b.text)]
    long = [b for b in free if b.long()]
    words = sum(len(b.text.split()) for b in long)
    usual = sum(b.density() * len(b.text.split()) for b in long) / max(1, words)
    high, low = min(STOP_HIGH, HIGH_PART * usual), min(STOP_LOW, LOW_PART * usual)
    for b in found:
        if b.apart or b.linked > LINKED * len(b.text) or not b.section and _RIGHTS.match(b.text):
            b.label = False
        elif b.long():
            density = b.density()
            b.label = True if density >= high or density >= low and b.section else False if density < low and not b.section else None
    sections: dict[int, list[Block]] = {}
    for b in found:
        if not b.apart:
            sections.setdefault(b.section, []).append(b)
    nothing = not any(b.label for b in found)
    for section, own in sections.items():
        first = [b.label for b in own]  # what the first pass decided

        def nearest(order) -> dict[int, tuple[int, bool]]:
            """Of each block the distance and label of the last decided one in that order."""
            seen, out = None, {}
            for k in order:
                if first[k] is not None:
                    seen = k
                elif seen is not None:
                    out[k] = (abs(k - seen), first[seen])
            return out

        before, after = nearest(range(len(own))), nearest(range(len(own) - 1, -1, -1))
        for k, b in enumerate(own):
            if first[k] is None:
                near = [x[k] for x in (before, after) if k in x]
                if nothing and not section:
                    b.label = not b.linked
                elif near:
                    closest = min(d for d, _ in near)
                    b.label = any(label for d, label in near if d == closest)
                else:
                    b.label = bool(section)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    decide(found)
    return "\n".join(b.text for b in found if b.label)


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages, without html, with text and n_chars."""

    def make():
        def work(rows):
            texts = [main_text(r) for r in rows]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return appended(pages, column, make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], without=(column,))
