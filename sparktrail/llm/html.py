"""Main text of web pages by line-block distribution.

A page is cut into lines, one a block with text; blocks without any are no lines. Markup goes. A
line weighs its text outside links, or all its text in an article or main element; elsewhere, on pages
that have such an element with text, it weighs a quarter. Lines in menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, told by element, role, class or id, weigh nothing.
Such a mark never holds for html, body, an article, a main element, or what
wraps one; a class or a form doesn't mark what holds nearly all the prose of a page without them; a class
that names a tool (search, sharing, lists of links) or a promotion marks only what holds a link or a control; and a
header inside an article is its title. Scripts, styles and hidden elements are no lines anywhere.

Weights are summed over windows of WINDOW lines. A stretch of lines surges where the sum rises from
nothing and dives where it falls to nothing again; it counts if the sum reaches the threshold between. The threshold is LOOSE characters, or a quarter of the page's
densest window where that is less. The text between is kept, lines that are one link included, but no
marked lines: of several stretches those with at least SHARE of the heaviest one's weight, and all
those of the same article as that one, however light. Articles begin and end with WINDOW empty lines.

Defined cases: null, empty or text-free html gives an empty text; unclosed elements, comments and
tags end with the page; unknown character references stay as they are; white space of any kind
becomes one space; a line break element is white space; repeated rows get the same answer each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW, LOOSE, SHARE, OUTSIDE = 3, 80, 0.2, 0.25
#: A class or form that holds so many characters, and this share of a page's prose, is its body.
WRAPS, MOST = 200, 2 / 3
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.IGNORECASE)
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noframes", "template"}
OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head", "svg", "canvas", "object", "audio", "video", "label", "fieldset", "datalist"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "label", "acronym", "nobr", "ruby", "rt", "rp"}
#: Words of class, id and role that mark what is not the article: a whole name, its last part, or its first part before a word of place.
_BEFORE = r"(?!(?:has|no|with|without|is|show|hide|js)[_-])(?:[a-z0-9]+[_-])*"
_BEHIND = r"(?:[_-](?:list|box|wrap|wrapper|container|area|block|section|bar|left|right|top|bottom|inner|outer|links?|form|widget|text|body|content|thread|item|buttons?|icons?|[0-9]+))*"
OUT_WORDS = re.compile(_BEFORE + r"(?:nav|navbar|navigation|menu|sidebar|aside|footer|header|masthead|banner|cookies?|consent|gdpr|notice|notification|alert|ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|comments?|replies|reply|respond|disqus|popup|modal|overlay|newsletter|subscribe|signup|widget|contentinfo|complementary|copyright)" + _BEHIND, re.IGNORECASE)
#: The same for what consists of links or controls; prose of such a name isn't marked.
TOOL_WORDS = re.compile(_BEFORE + r"(?:share|sharing|social|related|recommended|breadcrumbs?|login|pagination|pager|toolbar|search|skip|toc|promotion)" + _BEHIND, re.IGNORECASE)
CONTROLS = {"a", "form", "input", "button", "select", "textarea", "iframe"}


def named_out(attributes: str) -> tuple[bool, bool]:
    """Whether a class, id or role says that this is not the article, and whether one says that it is a tool."""
    names = [x for m in NAMES.finditer(attributes) for x in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").split()]
    return any(map(OUT_WORDS.fullmatch, names)), any(map(TOOL_WORDS.fullmatch, names))


class Line(NamedTuple):
    text: str
    loose: int  # characters of the text outside links
    article: int  # number of the outermost article or main element, 0 for none
    marks: frozenset[int]


class Mark:
    """An element that its name or its class tells is not the article, unless it proves to be a wrapper, or a tool without a control."""

    def __init__(self, by_class: bool, tool: bool):
        self.by_class, self.tool, self.wraps, self.prose = by_class, tool, False, 0


class Element(NamedTuple):
    name: str
    hidden: bool
    article: int
    marks: frozenset[int]


def lines(page: str) -> tuple[list[Line], list[Mark]]:
    """The lines of a page, and its marks."""
    out: list[Line] = []
    marks: list[Mark] = []
    held: list[str] = []
    loose = articles = 0
    none = Element("", False, 0, frozenset())
    stack: list[Element] = []
    link, at, n = 0, 0, len(page)

    def now() -> Element:
        return stack[-1] if stack else none

    def line(text: str, loose: int = 0) -> None:
        e = now()
        out.append(Line(text, min(loose, len(text)), e.article, e.marks))
        for k in e.marks:
            marks[k].prose += out[-1].loose
            marks[k].wraps |= bool(e.article and text and k in outer.get(e.article, ()))

    def flush() -> None:
        nonlocal loose
        text = " ".join("".join(held).split())
        if text:
            line(text, loose)
        held.clear()
        loose = 0

    def put(raw: str) -> None:
        nonlocal loose
        if raw and not now().hidden:
            text = entities.unescape(raw)
            held.append(text)
            if not link:
                loose += len("".join(text.split()))

    def close(k: int) -> None:
        """Ends the open elements from the k-th on."""
        flush()
        inside = stack[k].article and not (stack[k - 1].article if k else 0)
        del stack[k:]
        if inside:
            for _ in range(WINDOW):
                line("")

    outer: dict[int, frozenset[int]] = {}  # the marks around each article
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "a":
                link = max(0, link - 1)
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
            if name not in INLINE and k is None:
                flush()
            if k is not None:
                if name in INLINE:
                    del stack[k:]
                else:
                    close(k)
            continue
        if name in RAW:
            if name in CONTROLS:
                for k in now().marks:
                    marks[k].tool = False
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            put(" ")
            continue
        if name not in INLINE:
            flush()
        attributes = m[3] or m[6] or ""
        if name in CONTROLS:
            for k in now().marks:
                marks[k].tool = False
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "a":
            link += 1
        plain = not attributes.strip(" /")
        hidden = not plain and bool(HIDDEN.search(attributes))
        if name in INLINE:
            if hidden:
                stack.append(now()._replace(name=name, hidden=True))
            continue
        if name in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and now().name == name:
            close(len(stack) - 1)
        up, article = now(), now().article
        if name in ("article", "main") and not article:
            for _ in range(WINDOW):
                line("")
            articles += 1
            article = articles
            outer[article] = up.marks
        own = up.marks
        by_name = name in OUT and not (name == "header" and up.article)
        by_class = tool = False
        if not plain and name not in ("html", "body") and not (name in ("article", "main") and not up.article):
            by_class, tool = named_out(attributes)
        if by_name or by_class or tool:
            own |= {len(marks)}
            marks.append(Mark(not by_name or name == "form", not by_name and not by_class))
        stack.append(Element(name, up.hidden or hidden, article, own))
    flush()
    return out, marks


def stretches(lengths: list[float], threshold: float) -> list[tuple[int, int]]:
    """(surge, dive) pairs: lines between windows of nothing, where some window's sum reaches the threshold; from the first line with text."""
    found, start, dense = [], None, False
    for i, n in enumerate(lengths):
        run = sum(lengths[i : i + WINDOW])
        if start is None and n:
            start = i
        dense |= start is not None and run >= threshold
        if not run:
            if dense:
                found.append((start, i))
            start, dense = None, False
    return [*found, (start, len(lengths))] if dense else found


def weighed(page: str) -> list[tuple[Line, float | None]]:
    """Lines and their weights, none for marked lines."""
    every, marks = lines(page)
    article = any(x.article and x.text for x in every)
    prose = sum(x.loose for x in every)
    stand = {k for k, m in enumerate(marks) if not m.wraps and not m.tool and not (m.by_class and not article and m.prose >= WRAPS and m.prose > MOST * prose)}
    out = []
    for x in every:
        if x.marks & stand:
            out.append((x, None))
        elif x.article:
            out.append((x, float(len(x.text))))
        else:
            out.append((x, x.loose * (OUTSIDE if article else 1.0)))
    return out


def main_text(page: str) -> str:
    every = weighed(page)
    weights = [w or 0.0 for _, w in every]
    densest = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    if not densest:
        return ""
    found = {f: sum(weights[slice(*f)]) for f in stretches(weights, min(LOOSE, densest / 4))}
    heaviest = max(found, key=found.get)
    best = every[heaviest[0]][0].article
    kept = [f for f in stretches(weights, 0) if found.get(f, 0) >= SHARE * found[heaviest] or (best and every[f[0]][0].article == best)]
    return "\n".join(every[i][0].text for a, b in kept for i in range(a, b) if every[i][0].text and every[i][1] is not None)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
