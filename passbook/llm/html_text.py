"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line weighs as many characters as its text has, and
nothing if it stands in a part that is not running text (menus, forms, adverts ...) or is mostly links. The weights
are summed over windows of ``WINDOW`` lines, on every page over all its lines. A surge is where the sum rises from
nothing, a dive where it falls back to nothing; the text of weighing lines between a surge and its dive is kept if
some window between reaches ``SURGE`` characters (if none does: the heaviest stretch). Where the page marks an article
that holds at least half of the weight, its lines of links weigh too and its light stretches are kept; a mark never
takes weight from lines outside it. Nothing is capped.

Weight goes to no line within nav, aside, footer and the like. A word in an element's names (menu, comments, advert ...), or
being a form, only makes it doubtful: its lines lose their weight unless it holds ``WRAPPER`` times what stands unmarked
outside it; then it wraps the text of the page, whatever it is called.

Script, style and textarea run to their end tag or the end of the page. Drawings, templates, frames and noscript are
dropped up to their end tag; without one, or if closed in themselves (``<svg/>``), only the tag is. Formulas and what
stands in object, audio, video and canvas are text like any other.

Nulls: a null page is empty and gives the empty text. Unclosed, crossed and cut-off tags are read to the end. Equal pages
have equal texts, repeated rows are each read; very long pages are read whole. Of stretches of equal weight the first is
the heaviest. Extra columns pass through; an input column named ``text`` is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked, with_row

WINDOW = 3
SURGE = 80
#: A doubtful element is the page's text if it weighs so many times what stands unmarked outside it.
WRAPPER = 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

_INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i iframe img ins kbd label mark nobr noscript object q rp rt ruby s samp small span strike strong sub sup svg"
    " time tt u var video wbr math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext"
    " mtr munder munderover semantics annotation annotation-xml".split()
)
#: Elements dropped whole if their end tag is there.
_DROPPED = {t: re.compile(rf"</{t}\s*(?:>|\s[^>]*>)", re.I) for t in ("svg", "template", "iframe", "noscript")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
_ASIDE = frozenset("nav footer aside head title menu button select dialog".split())
#: Words in class, id, role or label that make an element doubtful.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager"
    " sidebar aside widget related recommended footer foot header masthead topbar toolbar search login subscribe newsletter signup social share sharing"
    " cookie cookies consent notice notices notification alert popup modal overlay disclaimer copyright comment comments commentlist reply replies respond discussion disqus feedback"
    " complementary contentinfo hidden".split()
)
#: A name that begins with one of these tells about the layout around the element.
_ABOUT = frozenset("has no not is".split())
#: Inside an article these name its own heading; elements whose names say nothing.
_TOPS = frozenset("header head masthead".split())
_UNNAMED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
#: Words that mark an element as the article, whatever else its names say.
_ARTICLE_WORDS = frozenset("article main post-body entry-content article-body post-content".split())


def _words(attrs: str) -> set[str]:
    """Names in class, id, role and label and their parts; names that say what an element has or lacks (``no-sidebar``) say nothing."""
    names = " ".join(next(filter(None, m.groups()), "") for m in _NAMES.finditer(attrs)).lower().split()
    parts = [n for n in names if re.split(r"[_-]", n)[0] not in _ABOUT and not ({"with", "without"} & set(re.split(r"[_-]", n)))]
    return {*parts, *(w for n in parts for w in re.split(r"[_-]+", n))}


def lines(page: str) -> tuple[list[tuple[str, int, bool, bool]], list[tuple[int, int]]]:
    """(text, characters in links, stands aside by its tags, in an article) of each block, in page order; and the blocks,
    first to last (exclusive), of each element that a word in its names, or being a form, makes doubtful.
    """
    out: list[tuple[str, int, bool, bool]] = []
    doubts: list[tuple[int, int]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open elements that are not inline: name, aside, article, block where a doubt begins or -1
    text: list[str] = []
    linked, in_link, at = 0, False, 0
    unended: set[str] = set()  # dropped elements of which no end tag follows

    def close() -> None:
        nonlocal linked
        if text:
            if line := " ".join("".join(text).split()):
                aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append((line, linked, aside, article))
            text.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            text.append(plain := html.unescape(raw))
            linked += len(plain.strip()) if in_link else 0

    def pop() -> str:
        name, _, _, begun = stack.pop()
        if 0 <= begun < len(out):
            doubts.append((begun, len(out)))
        return name

    while m := _TOKEN.search(page, at):
        put(page[at : m.start()])
        at, tag = m.end(), m["tag"]
        if tag is None:
            continue
        tag, end = tag.lower(), bool(m["end"])
        if tag in _DROPPED and not end and tag not in unended and not (tag == "svg" and m["attrs"].endswith("/")):
            if over := _DROPPED[tag].search(page, at):
                at = over.end()
                continue
            unended.add(tag)
        if tag == "br":
            text.append(" ")
        elif tag in _INLINE:
            in_link = not end if tag == "a" else in_link
        elif tag in _VOID:
            close() if tag == "hr" else None
        elif end:
            close()
            in_link = False
            if any(name == tag for name, *_ in stack):
                while pop() != tag:
                    pass
        else:
            close()
            in_link = False
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                pop()
            aside, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            names, begun = _words(m["attrs"]) if m["attrs"] else set(), -1
            if (tag in ("article", "main") or names & _ARTICLE_WORDS) and not names & {"comment", "comments", "related"} and tag not in ("body", "html"):
                # Menus and heads that were never closed end where an article begins.
                aside, article = any(a and n not in ("head", "title", "nav", "menu", "header") for n, a, *_ in stack), True
            elif tag in _ASIDE or (tag == "header" and not article):
                aside = True
            elif tag == "form" or (tag not in _UNNAMED and names & (_WORDS - _TOPS if article else _WORDS)):
                begun = len(out)
            stack.append((tag, aside, article, begun))
    put(page[at:])
    close()
    while stack:
        pop()
    return out, doubts


def _aside(found: list[tuple[str, int, bool, bool]], doubts: list[tuple[int, int]]) -> list[bool]:
    """Whether each block stands aside: by its tags, or in a doubtful element that is no wrapper of the text.

    The heaviest elements are looked at first: one that holds ``WRAPPER`` times the weight of all blocks without any mark outside
    it is where the page has its text, whatever its names say.
    """
    weight = [0 if aside or 2 * links > len(text) else len(text) for text, links, aside, _ in found]
    marks = [0] * (len(found) + 1)
    for first, last in doubts:
        marks[first] += 1
        marks[last] -= 1
    marks = list(accumulate(marks))[:-1] if found else []
    free = [0, *accumulate(w for w in (0 if n else w for w, n in zip(weight, marks)))]
    whole = [0, *accumulate(weight)]
    for first, last in sorted(doubts, key=lambda d: (whole[d[0]] - whole[d[1]], d)):
        outside = free[-1] - (free[last] - free[first])
        if whole[last] - whole[first] > WRAPPER * outside:
            marks[first:last] = [n - 1 for n in marks[first:last]]
            free = [0, *accumulate(0 if n else w for w, n in zip(weight, marks))]
        elif whole[last] == whole[first]:
            break
    return [bool(aside or n) for (_, _, aside, _), n in zip(found, marks)]


def kept(found: list[tuple[str, int, bool, bool]], doubts: list[tuple[int, int]]) -> list[str]:
    """The lines between surges and dives of the line-block distribution."""
    away = _aside(found, doubts)
    plain = [0 if aside or 2 * links > len(text) else len(text) for (text, links, *_), aside in zip(found, away)]
    inside = [article and not aside for (*_, article), aside in zip(found, away)]
    full = [len(line[0]) if article else weight for line, weight, article in zip(found, plain, inside)]
    marked = sum(w for w, article in zip(full, inside) if article)
    trusted = marked > 0 and 2 * marked >= sum(full)
    weights = full if trusted else plain
    sums = [sum(weights[i : i + WINDOW]) for i in range(1 - WINDOW, len(weights))]  # of the window that ends at line i + WINDOW - 1
    stretches: list[tuple[int, int, int, int]] = []  # first, last line, highest sum, whole weight
    i = 0
    while i < len(sums):
        if sums[i]:
            j = i
            while j + 1 < len(sums) and sums[j + 1]:
                j += 1
            first, last = max(0, i + 1 - WINDOW), j
            stretches.append((first, last, max(sums[i : j + 1]), sum(weights[max(0, i + 1 - WINDOW) : j + 1])))
            i = j
        i += 1
    if stretches:
        light = lambda s: trusted and any(inside[s[0] : s[1] + 1])
        stretches = [s for s in stretches if s[2] >= SURGE or light(s)] or [max(stretches, key=lambda s: s[3])]
    chosen = {k for first, last, _, _ in stretches for k in range(first, last + 1)}
    return [line[0] for k, line in enumerate(found) if k in chosen and weights[k]]


def main_text(page: str | None) -> str:
    return "\n".join(kept(*lines(page))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = pa.array([main_text(x) for x in b.column("page").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("row"), text], names=["row", "text"])


def extracted(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``pages`` (all by default) with ``text``, the main text of the whole page."""
    df = packed(pages, keep, page=F.col(f"`{html_col}`").cast("string"))
    return unpacked(df.mapInArrow(_extract, with_row(df, "text string")), text=F.col("text"))
