"""Main text of web pages by the distribution of text over lines.

Markup is stripped into lines, one for each block; a line's weight is the length of its text, or 0
if it stands in a menu, header, footer, sidebar, notice, advert, form, comment section or the like,
or is mostly links; within an article it counts ``MARKED`` times. Weights are summed over sliding
windows of ``WINDOW`` lines; a surge is where the sums rise from 0 or an article begins or ends, a
dive where they fall back to 0 or the next surge is. The stretch of the largest weight is the main
one, with all others in articles if it is in one. Text are the lines with weight of the main one, of
stretches that have ``SHARE`` of its weight at least, and of shorter ones that stand next to it or
above it (short articles beside a main one outside are teasers). White space within a block, a line break included, becomes one space; character references
are decoded.

Nulls: null html has an empty text. Very long pages: whole. Broken markup: an element that isn't
closed ends with the page or with its parent, a p or li also where the next block or li begins. Repeated rows: each for itself. Empty tables: empty
result. Other columns pass through; names given here replace columns of the same name.

Names are read as whole words of a class or id (``cookie-banner``, not ``share-price``). The ids of
headings, and of sections within the article, are anchors and say nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from stemma.llm.common import with_columns
from stemma.llm.segments import slices

WINDOW = 3
SHARE = 0.2
#: Weight of a character in an article.
MARKED = 2
#: Characters in links, of all, from which a line is a menu's.
LINKS = 0.5

# fixed values: elements and names of what isn't main text
OPAQUE = "script|style|noscript|template|svg|iframe|textarea|title|select|object|canvas"
ASIDE = frozenset("nav footer aside form dialog menu button head".split())
MAIN = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = re.compile(
    r"ads?|adverts?|advertisements?|adsbygoogle|banners?|sponsor(?:ed|s)?|promos?|menus?|nav(?:bar|igation)?|sidebars?|footer|masthead|breadcrumbs?|cookies?|consent|notices?|"
    r"comments?|disqus|replies|social|share|sharing|related|recommended|popup|modal|newsletter|subscribe|signup|login|pagination|pager|widgets?|toolbar"
)
#: What may stand beside them in a class or id: ``ad-slot-1``, ``site-header``.
BESIDE = re.compile(
    r"\d*|[a-z]|main|site|page|header|top|bottom|left|right|upper|lower|inner|outer|primary|secondary|mobile|desktop|fixed|sticky|global|box|block|wrap|wrapper|container|content|section|"
    r"area|bar|slot|unit|item|items|list|links?|buttons?|btn|icons?|panel|overlay|dialog|form|group|row|col|column|region|zone|tools?|media|posts?|articles?|stories|threads?|body|text|title|label"
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({OPAQUE})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that close an open p, as in HTML, and those that an open p or li doesn't reach out of.
CLOSES_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre section table ul".split())
BARRIERS = frozenset("table td th caption button object body html".split())


def _named(value: str) -> bool:
    """Whether a class or id is one of ``NAMES``, alone or beside words that say nothing."""
    parts = re.split(r"[-_:]+", value)
    return any(NAMES.fullmatch(p) for p in parts) and all(NAMES.fullmatch(p) or BESIDE.fullmatch(p) for p in parts) or value in ("site-header", "page-header")


def _apart(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element isn't main text."""
    if tag in ASIDE or tag == "header" and not in_main:
        return True
    if not attributes.strip() or tag in MAIN or tag == "body" or tag == "html":
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "id" and (tag in HEADINGS or in_main and tag == "section"):
            continue
        if name in ("class", "id") and any(map(_named, value.split())) or name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


def _left_open(tag: str, stack: list[tuple[str, bool, bool]]) -> int:
    """How many open elements end where ``tag`` begins: those from an open p, or li for a li, upwards."""
    n = 0
    for i in range(len(stack) - 1, -1, -1):
        name = stack[i][0]
        if name in BARRIERS or name in ("ul", "ol"):
            break
        if name == "p" and tag in CLOSES_P or name == "li" and tag == "li":
            n = len(stack) - i
    return n


def lines(html: str) -> list[tuple[str, bool, int]]:
    """(text, whether it is in an article, weight) of each line."""
    out: list[tuple[str, bool, int]] = []
    texts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: tag, apart, main
    apart = main = link = linked = 0
    at = 0

    def flush() -> None:
        nonlocal texts, linked
        text = " ".join(unescape("".join(texts)).split())
        if text:
            weight = 0 if apart or linked > LINKS * len(text) and not main else len(text)
            out.append((text, main > 0, weight * MARKED if main else weight))
        texts, linked = [], 0

    for m in TOKEN.finditer(html):
        if m.start() > at:
            texts.append(html[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                texts.append(" ")
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                texts.append(" ")
            elif tag == "a":
                link = 0 if m[2] else 1
            if not (m[4] and _apart(tag, m[4], main > 0)) and (not m[2] or not any(x[0] == tag for x in stack)):
                continue
            if tag in VOID:
                continue
        flush()
        link = 0 if tag != "a" else link
        if not m[2] and tag in CLOSES_P:
            for _ in range(_left_open(tag, stack)):
                _, off, inside = stack.pop()
                apart, main = apart - off, main - inside
        if tag in VOID:
            continue
        if not m[2]:
            off, inside = _apart(tag, m[4], main > 0), tag in MAIN and not apart
            stack.append((tag, off, inside))
            apart, main = apart + off, main + inside
        elif any(x[0] == tag for x in stack):
            while True:
                name, off, inside = stack.pop()
                apart, main = apart - off, main - inside
                if name == tag:
                    break
    texts.append(html[at:])
    flush()
    return out


def main_text(html: str | None) -> str:
    """The blocks of the main text, joined by line feeds."""
    found = lines(html or "")
    weights = [w for *_, w in found]
    sums = [sum(weights[max(0, i - WINDOW // 2) : i + WINDOW // 2 + 1]) for i in range(len(weights))]
    stretches: list[tuple[int, int]] = []
    start = None
    for i, s in enumerate([*sums, 0]):
        if start is not None and (not s or found[i][1] != found[start][1]):
            stretches.append((start, i))  # a dive
            start = None
        if s and start is None:
            start = i  # a surge
    sized = [(sum(weights[a:b]), a, b, found[a][1]) for a, b in stretches if any(weights[a:b])]
    if not sized:
        return ""
    top = max(range(len(sized)), key=lambda k: sized[k][0])
    largest, *_, marked = sized[top]
    last = max(k for k, (*_, inside) in enumerate(sized) if inside) if marked else top
    kept = [(a, b) for k, (n, a, b, inside) in enumerate(sized) if n >= SHARE * largest or k <= last + 1 and (marked or not inside)]
    return "\n".join(found[i][0] for a, b in kept for i in range(a, b) if weights[i])


def extract_text(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` without ``html_col``, with text and n_chars (its code points)."""

    def run(pages: pa.Array) -> Iterator[dict[str, pa.Array]]:
        for at, rows in slices(pages):
            texts = [main_text(h) for h in pages.slice(at, rows).to_pylist()]
            yield {"text": pa.array(texts, pa.string()), "n_chars": pa.array([*map(len, texts)], pa.int64())}

    return with_columns(df, html_col, run, "text string, n_chars long", drop=(html_col,))
