"""Main text of web pages by tag-path ratios.

A page is cut into blocks (runs of text between block-level tags), each with its root-to-leaf path of block tags and
first classes. Per path the length of unlinked text and the punctuation of all its blocks are summed and divided by the
number of its blocks; the two ratios and the path's share of the page's text are fused and smoothed over the paths that
follow each other on the page. A path
also stands in its containers: the ratios of all blocks directly in one count for what is nested in it, less with each
step, so that a heading or a short list is judged with the prose around it. What the markup says of a place (menus,
footers and forms by tag; words of class, id or role; inside or outside an article or main element) is one more
factor, a mild one: two or three such hints don't take a path with the page's best ratios below the threshold that an
advert's or a menu's ratios miss. Every path is then held against the best one of the page: those that reach `SHARE` of
its score are content, wherever they stand. Only reader comments and sidebars are told by the markup alone, since they are
prose. A container's ratios don't count for what the markup sets apart in it, and a marked path must also reach `FLOOR`,
so that a page of nothing but a menu and a footer has no main text. Paths of equal score are all content or all not.

Never text are scripts, styles and other raw elements, comments, and elements hidden by attribute or style.

Null and empty pages give an empty text; pages are read whole whatever their length, open tags and cut-off ends
included, in time and memory in proportion to their length; rows are neither merged nor dropped; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches

#: A tag up to its `>`; a quote counts only as the first thing of an attribute's value. A failed match means that no `>` follows outside quotes.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?)*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW = {x: re.compile(f"</{x}(?=[\\s/>]|\\Z)[^>]*+>?", re.I) for x in "script style noscript template svg textarea iframe title select math".split()}
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARKS = re.compile(r"[.,;:!?。、،؛؟]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: Tags that companions of prose stand in; other block tags are containers of their own.
COMPANION = frozenset("h1 h2 h3 h4 h5 h6 p li ul ol dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre hgroup".split())
#: Tags of places that hold something other than the main text.
LANDMARK = frozenset("nav header footer aside form button dialog menu head option fieldset object audio video canvas".split())
#: Words of class, id or role that hint at such places.
MARK_WORDS = frozenset(
    """ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion popup modal overlay nav navbar navigation menu
    footer header masthead topbar breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice notification alert disclaimer share sharing
    social related recommended newsletter subscribe subscription signup login search widget toolbar complementary contentinfo dialog form skip""".split()
)
#: Words of places with prose of their own, which no ratio tells from an article's: reader comments and sidebars.
PROSE_WORDS = frozenset("comment comments commentlist disqus reply replies respond sidebar sidenav aside".split())
#: Words that name a page's header, or an article's own heading within it.
HEADING_WORDS = frozenset(["header", "masthead"])
#: Words that hint at an article element that is something other than the page's article.
OTHER_ARTICLES = frozenset("ad advert advertisement comment reply promo sponsored related teaser".split())
MAIN = frozenset(["article", "main"])
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
}

#: Share of the best path's score from which a path is content, and the score that a marked path needs besides.
SHARE, FLOOR = 0.25, 4.0
#: Factors of the places: a landmark tag, a hinting word, prose of its own (reader comments, sidebars), outside the article where a page has one.
IN_LANDMARK, IN_MARKED, IN_PROSE, OUTSIDE = 0.4, 0.7, 0.08, 0.4
#: What a container's score is worth one step further in, by the tag of that step.
COMPANION_STEP, CONTAINER_STEP = 0.85, 0.4
#: What of a linked character's weight is lost.
LINKED_LOSS = 0.9
#: Power of a path's share of the page's unlinked text.
SPREAD = 0.5
#: Weight of a path's own ratio against each neighbour's.
OWN_WEIGHT = 6


@dataclass
class Page:
    """A page's blocks in order, as (path, text, length of its linked text), and its tree of paths."""

    blocks: list[tuple[int, str, int]] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    place: list[float] = field(default_factory=lambda: [1.0])
    inside: list[bool] = field(default_factory=lambda: [False])


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _attributes(attrs: str, tag: str, inside: bool) -> tuple[bool, float, bool, str]:
    """Whether an element is hidden, the factor of words that hint at something other than main text, whether it says it is the main one, and its class."""
    if not attrs or attrs.isspace():
        return False, 1.0, False, ""
    words = OTHER_ARTICLES if tag in MAIN else MARK_WORDS - HEADING_WORDS if inside else MARK_WORDS
    remarks = PROSE_WORDS & OTHER_ARTICLES if tag in MAIN else PROSE_WORDS
    hidden, main, hinted = False, False, 1.0
    shown = ""
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "style":
            hidden |= bool(HIDDEN.search(value))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hinted = min(hinted, IN_MARKED if value == "true" else 1.0)
        else:
            said = re.split(r"[^a-z]+", value)
            hinted = min(hinted, IN_PROSE if not remarks.isdisjoint(said) else IN_MARKED if not words.isdisjoint(said) else 1.0)
            main |= name == "role" and value in MAIN
            if name == "class":
                shown = value.split()[0] if value.split() else ""
    return hidden, hinted, main, shown


def read(page: str) -> Page:
    """The blocks and paths of a page. A path is known by its parent and its last step (tag, class, what the markup says of it)."""
    out = Page()
    known: dict[tuple, int] = {}
    stack: list[tuple[str, int, bool]] = []  # tag, path, hidden
    opened: Counter[str] = Counter()
    parts: list[str] = []
    path, hidden = 0, False
    linked, anchor = 0, -1  # the depth at which a link was opened
    tag_at = TAG

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.blocks.append((path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal path, hidden, anchor
        opened[stack.pop()[0]] -= 1
        _, path, hidden = stack[-1] if stack else ("", 0, False)
        if anchor > len(stack):
            anchor = -1

    at, end = 0, len(page)
    while at < end:
        less = page.find("<", at)
        follows = page[less + 1 : less + 2]
        while less >= 0 and not (_letter(follows) or follows in ("!", "/", "?")):
            less = page.find("<", less + 1)
            follows = page[less + 1 : less + 2]
        text = page[at : less if less >= 0 else end]
        if text and not hidden:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if anchor >= 0:
                linked += len(text.strip())
        if less < 0:
            break
        if page.startswith("<!--", less):
            at = page.find("-->", less + 4)
            at = at + 3 if at >= 0 else end
            continue
        m = tag_at.match(page, less)
        if m is None:
            if not _letter(follows) and not (follows == "/" and _letter(page[less + 2 : less + 3])):
                at = page.find(">", less) + 1 or end
                continue
            tag_at = LOOSE_TAG  # from here on quotes aren't looked at, so that no part of a page is scanned twice
            m = tag_at.match(page, less)
            if m is None:
                break
        at = m.end()
        closing, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in RAW and not closing:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            close = RAW[tag].search(page, at)
            at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                anchor = -1 if closing else len(stack)
            if tag in VOID or closing and not opened[tag]:
                continue
            if closing and stack[-1][0] == tag and (stack[-2][1] if len(stack) > 1 else 0) == path:
                pop()
                continue
            if not closing:
                unseen, hinted, *_ = _attributes(attrs, tag, out.inside[path])
                if unseen or hinted == 1.0:
                    if unseen or opened[tag]:
                        hidden = hidden or unseen
                        stack.append((tag, path, hidden))
                        opened[tag] += 1
                    continue
        if closing:
            if opened[tag]:
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag not in INLINE:
                flush()
            continue
        flush()
        while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
            pop()
        if tag in VOID:
            continue
        unseen, hinted, main, shown = _attributes(attrs, tag, out.inside[path])
        if tag in ("html", "body"):
            unseen, hinted = False, 1.0
        landmark = tag in LANDMARK and not (tag == "header" and out.inside[path])
        place = min(out.place[path], hinted, IN_PROSE if tag == "aside" else IN_LANDMARK if landmark else 1.0)
        inside = out.inside[path] or tag in MAIN or main
        step = (path, tag, shown, place, inside)
        path = known.setdefault(step, len(out.parent))
        if path == len(out.parent):
            out.parent.append(step[0])
            out.tag.append(tag)
            out.place.append(place)
            out.inside.append(inside)
        hidden = hidden or unseen
        stack.append((tag, path, hidden))
        opened[tag] += 1
    flush()
    return out


def fused(length: float, marks: float, number: float, whole: float) -> float:
    """The ratios of a path in one: unlinked length and punctuation, each a block, and its share of the page's text."""
    return (length / number * (0.5 + marks / number)) ** 0.5 * (length / whole) ** SPREAD if number and whole else 0.0


def path_scores(page: Page) -> dict[int, float]:
    """The score of each path that has blocks."""
    n = len(page.parent)
    length, marks, number, whole = [0.0] * n, [0] * n, [0] * n, [0] * n
    order: dict[int, None] = {}
    for path, text, linked in page.blocks:
        length[path] += len(text) - LINKED_LOSS * linked
        whole[path] += len(text)
        marks[path] += len(MARKS.findall(text))
        number[path] += 1
        order[path] = None
    paths = list(order)
    total = sum(length)
    own = [fused(length[p], marks[p], number[p], total) for p in paths]
    placed = [x * page.place[p] for x, p in zip(own, paths)]
    weight = lambda i: OWN_WEIGHT * own[i] + sum(placed[max(0, i - 1) : i] + placed[i + 1 : i + 2])
    smooth = {p: weight(i) / (OWN_WEIGHT + (i > 0) + (i + 1 < len(paths))) for i, p in enumerate(paths)}

    direct_length, direct_marks, direct_number = [0.0] * n, [0] * n, [0] * n
    for p in paths:
        up = page.parent[p]
        for at in [p, up] if up >= 0 and page.place[up] == page.place[p] else [p]:
            direct_length[at] += length[p]
            direct_marks[at] += marks[p]
            direct_number[at] += number[p]
    support = [0.0] * n
    for p in range(n):  # parents come before what they hold
        group = fused(direct_length[p], direct_marks[p], direct_number[p], total)
        step = COMPANION_STEP if page.tag[p] in COMPANION else CONTAINER_STEP
        support[p] = max(group, step * support[page.parent[p]]) if p and page.place[page.parent[p]] == page.place[p] else group

    bounded = any(page.inside[p] for p in paths)
    out = {}
    for p in paths:
        up = page.parent[p]
        step = COMPANION_STEP if page.tag[p] in COMPANION else CONTAINER_STEP
        unlinked = length[p] / max(whole[p], 1)
        around = step * support[up] * unlinked if up >= 0 and page.place[up] == page.place[p] else 0.0
        out[p] = max(smooth[p], around) * page.place[p] * (1.0 if page.inside[p] or not bounded else OUTSIDE)
    return out


def main_text(html: str) -> str:
    page = read(html)
    scores = path_scores(page)
    least = SHARE * max(scores.values(), default=0.0)
    kept = {p for p, s in scores.items() if s > 0 and s >= least and (page.place[p] == 1.0 or s >= FLOOR)}
    return "\n".join(text for path, text, _ in page.blocks if path in kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of `keep`, and text, for every row."""
    names = list(keep)
    bounded_batches(pages.sparkSession)
    given = pages.select(*names, F.col(html_col).alias("__page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) if p else "" for p in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*names, "text"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}text string")
