"""Main-text extraction from web pages by the distribution of text over lines.

Markup is stripped so that each block of the page becomes a line; blocks whose element says that they are no main text
(menus, forms, hidden ones, ...) leave none. A line's length is its text's, twice less what of it is in links. A window
of WINDOW lines slides down the page: where its sum of lengths reaches SURGE (or the page's highest sum, if that is
less), main text begins, with the lines that lead up to it; where its sum dives to nothing, main text ends; all lines
between are kept. A paragraph of whole sentences up to a line more than a window behind such an end goes on with it. At
either end of such text, labels of one or two words in blocks that are no paragraphs, and copyright lines, go.

Names (class or id) that speak of adverts, notices, comments and the like only weigh: the block goes, unless lengths say
that it holds the main text: it has a surge and over BULK times as much text as all that is outside of such blocks (and
than SURGE, beside a named article), and, if it is comments, there is no surge outside. Headings in an article go by no
name.

If the page names its article (``article`` or ``main``), the window slides over that part only, unless there is more text
outside; of several, those with half of the most text and more count. Text lengths decide in there, too: rows of links of
a window's height and more are a menu and end the text; but text goes on behind them without a new surge, and fewer lines
of links at either end stay.

Nulls: a null page is empty, its text the empty string. Pages without text, very long ones, unclosed and cut-off
markup all give a text. Repeated rows each give theirs. An empty table gives an empty result. Only the id, url and
html columns are read.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTRACTED = "page_id long, url string, text string, n_chars long"
WINDOW, SURGE, BULK = 3, 80, 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|template|iframe|svg|object|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = set("head nav header footer aside form button select dialog menu audio video canvas map fieldset".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banners?|sidebars?|side|menus?|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|widgets?|comments?|commentlist|disqus|respond|replies|toolbar|pagination|pager|skip)(?=$|[\s_-])", re.I
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}


_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies)(?=$|[\s_-])", re.I)
_NOTICE = re.compile(r"^\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_SENTENCE = re.compile(r"[.!?…][\"'”’»)]*$")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KEEP, DROP, NAMED, COMMENTS = range(4)


def _boilerplate(name: str, attrs: str, inside: bool) -> int:
    """What an element's name and attributes say of its text: KEEP or DROP it, or that it is NAMED like other text than
    the main one, or like COMMENTS."""
    if name in _DROPPED:
        return DROP
    if not attrs or name in ("html", "body", "article", "main") and "comment" not in attrs.lower():
        return KEEP
    if _HIDDEN.search(attrs):
        return DROP
    said = KEEP
    for kind, value in _ATTR.findall(attrs):
        value = value.strip("\"'")
        if kind.lower() == "role":
            if value.lower() in _ROLES:
                return DROP
        elif _HINT.search(value) and not (inside and name in _HEADINGS):
            said = COMMENTS if _COMMENTS.search(value) or said == COMMENTS else NAMED
    return said


@dataclass
class Line:
    text: str
    #: its length without links, twice less what is in links; its article (0: none) and named block (0: none)
    length: int
    article: int
    block: int
    #: the element that it is in: h, p or another
    kind: str


def lines_of(page: str) -> tuple[list[Line], list[tuple[int, int]]]:
    """The page's lines, and its named blocks: (the block around it, what it is named like), from 1."""
    lines: list[Line] = []
    blocks: list[tuple[int, int]] = [(0, KEEP)]
    parts: list[str] = []
    #: open named blocks: element, how many of its kind are open in it, block
    opened: list[list] = []
    linked = inside = depth = links = article = 0
    dropping, kind = "", "o"

    def ends(name: str, at: int) -> bool:
        """Whether the element is closed anywhere from here on. Each name's ends are gone through once."""
        if 0 <= last.get(name, 0) < at or name not in last:
            found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            last[name] = found.start() if found else -1
        return last[name] >= 0

    last: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, max(0, len(text) - 2 * min(linked, len(text))), article if inside else 0, opened[-1][2] if opened else 0, kind))
        parts.clear()
        linked = 0

    at, closes = 0, {}
    for m in _TOKEN.finditer(page):
        run, at = page[at : m.start()], m.end()
        if run and not dropping:
            parts.append(run)
            linked += len(run) if links else 0
        closing, name, attrs = m.group(2), (m.group(3) or "").lower(), m.group(4) or ""
        if not name:
            continue
        if dropping:
            if name == dropping and name not in _VOID:
                depth += -1 if closing else not attrs.endswith("/")
                if not depth:
                    dropping = ""
            elif name in ("article", "main") and not closing and not closes.get(dropping, True):
                dropping = ""  # what was dropped is never closed: it ends where the article begins
            if dropping:
                continue
            if closing:
                continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        own = name not in _VOID and not attrs.endswith("/")
        if not closing and own:
            said = _boilerplate(name, attrs, inside > 0)
            if said == DROP:
                flush()
                dropping, depth = name, 1
                closes[name] = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at) is not None
                continue
            if said != KEEP and ends(name, at):
                flush()
                blocks.append((opened[-1][2] if opened else 0, said))
                opened.append([name, 0, len(blocks) - 1])
            if opened and name == opened[-1][0]:
                opened[-1][1] += 1
        if name not in _INLINE:
            flush()
            links = 0
            kind = "o" if closing else "h" if name in _HEADINGS else "p" if name in ("p", "blockquote", "pre") else "o"
            if name in ("article", "main"):
                article += not closing and not inside
                inside = max(0, inside + (-1 if closing else 1))
        if closing and opened and name == opened[-1][0]:
            opened[-1][1] -= 1
            if opened[-1][1] <= 0:
                flush()
                opened.pop()
    if at < len(page) and not dropping:
        parts.append(page[at:])
    flush()
    return lines, blocks


def _surges(lengths: list[int]) -> bool:
    total = [0, *accumulate(lengths)]
    return any(total[min(len(lengths), i + WINDOW)] - total[i] >= SURGE for i in range(len(lengths)))


def unnamed(lines: list[Line], blocks: list[tuple[int, int]]) -> list[Line]:
    """The lines outside of named blocks, and those of blocks that lengths say to hold the main text."""
    if len(blocks) == 1:
        return lines
    own: dict[int, list[int]] = {}
    for x in lines:
        own.setdefault(x.block, []).append(x.length)
    # a named article that is short stands against a long advert, but not against a long text
    least = BULK * SURGE if any(x.article and not x.block for x in lines) else 0
    within: dict[int, list[int]] = {}
    for block, (around, _) in enumerate(blocks[1:], 1):
        within.setdefault(around, []).append(block)
    held, text, surged, ready = {0}, sum(own.get(0, [])), _surges(own.get(0, [])), []
    reach = lambda around: [heapq.heappush(ready, (-sum(own.get(b, [])), b)) for b in within.get(around, [])]
    reach(0)
    while ready:
        size, block = heapq.heappop(ready)
        lengths = own.get(block, [])
        holds = _surges(lengths) and -size > max(least, BULK * text) and (blocks[block][1] == NAMED or not surged)
        if holds or not lengths:  # with nothing of its own, what is in it is judged by itself
            held.add(block)
            text, surged = text - size, surged or holds
            reach(block)
    return [x for x in lines if x.block in held]


def segments(lengths: list[int], named: bool, sentences: list[bool] | None = None) -> list[tuple[int, int]]:
    """Beginnings and ends of the main text among lines of these lengths, in a named article or a whole page. sentences:
    which lines are paragraphs of whole sentences."""
    n = len(lengths)
    total = [0, *accumulate(lengths)]
    sums = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    surge = min(SURGE, max(sums, default=0))
    if not surge:
        return [(0, n)] if named and n else []
    found: list[tuple[int, int]] = []
    i = 0
    while i < n:
        goes_on = found and (named or sentences and sentences[i] and i - found[-1][1] <= WINDOW + 1)
        if not lengths[i] or sums[i] < (1 if goes_on else surge):
            i += 1
            continue
        begin = i
        while i < n and sums[i]:
            i += 1
        while begin and lengths[begin - 1]:
            begin -= 1
        found.append((begin, i))
    if named and found[0][0] < WINDOW:
        found[0] = (0, found[0][1])
    if named and n - found[-1][1] < WINDOW:
        found[-1] = (found[-1][0], n)
    return found


def articles(lines: list[Line]) -> list[Line]:
    """The lines of the named articles that count, or all where there is none or more text lies outside."""
    mass: dict[int, int] = {}
    for x in lines:
        mass[x.article] = mass.get(x.article, 0) + x.length
    outside = mass.pop(0, 0)
    if not mass:
        return lines
    chosen = {a for a, n in mass.items() if 2 * n >= max(mass.values())}
    if sum(mass[a] for a in chosen) < outside:
        return [Line(x.text, x.length, 0, x.block, x.kind) for x in lines]
    return [x for x in lines if x.article in chosen]


def _label(x: Line) -> bool:
    """Whether a line at an end of the main text is no part of it."""
    return x.kind == "o" and not _SENTENCE.search(x.text) and (len(x.text.split()) <= 2 or bool(_NOTICE.match(x.text)))


def main_text(page: str | None) -> str:
    """The lines between surges and dives, one per row."""
    if not page:
        return ""
    lines = articles(unnamed(*lines_of(page)))
    named = any(x.article for x in lines)
    sentences = [x.kind == "p" and bool(_SENTENCE.search(x.text)) and not _NOTICE.match(x.text) for x in lines]
    kept: list[str] = []
    for begin, end in segments([x.length for x in lines], named, sentences):
        if not named:
            core = [i for i in range(begin, end) if not _label(lines[i])]
            begin, end = (core[0], core[-1] + 1) if core else (begin, end)
        kept += [x.text for x in lines[begin:end]]
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """EXTRACTED for every page (page_id, url, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(x) for x in frame["html"].tolist()]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, EXTRACTED)
