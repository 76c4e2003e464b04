"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. The first pass labels a block by its link density, its length and its density of
stop words: linked text is bad, long text dense in stop words is good, long text without them bad, and what is short or of middling
density stays undecided. In the second pass each undecided block takes the label of its nearest decided neighbour.

Structure is one feature beside these three. What stands in an element made for something else (menus, forms and the like, or of such a
class) is bad. An article element moves the bounds of the first pass: in it, dense text needs less length and sparse text stays
undecided, and outside it only long and dense text is good. In the second pass the edge of an article or of an element made for
something else counts as CROSSING steps, and beyond PRIOR steps what stands in an article counts as good and what stands outside it as bad. Articles without prose, as cards that
lead to other pages, say nothing where prose stands outside them.

Text inside a paragraph that stands in such an element (a button, an advert) is left out of it; scripts and the like don't split it.

Defined results: a null page is an empty one, whose text is empty; where no block is decided and no article stands, all
undecided ones are text; tags left open, stray signs and cut-off pages are read as they stand; text that is no markup stays,
however long; repeated rows and empty tables are no special case; columns other than the id, the address and the page are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import rebatch, tidy

# Element names, words of class names and stop words.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: Their content is not text at all.
SKIPPED = frozenset("script style noscript template svg math iframe object audio video canvas textarea title head".split())
#: Of these, what a slash at the tag's end closes.
FOREIGN = frozenset("svg math".split())
#: What stands in them is not the article.
OUTSIDE = frozenset("nav footer aside form menu button select dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INSIDE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of an element's class names, id and role, split at spaces.
BOILERPLATE = re.compile(
    r"(?:site|page|main|top|bottom|left|right|global|post|article|user|js|wp|c|l|o)?[-_]*"
    r"(?:ads?|advert(?:s|isement|ising)?|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|consent|disqus|footer|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notices?|pagination"
    r"|popup|promo(?:ted|tion)?|related|replies|respond|search|share|sharing|sidebar|social|sponsor(?:ed)?|subscribe|subscription|toolbar|widget)"
    r"(?:[-_]*(?:area|articles?|bar|block|bottom|box|button|container|content|form|item|left|links?|list|main|message|news|posts?|right|section|slot|stories|top|unit|wrap|wrapper|\d+))*",
    re.I,
)
STOP_WORDS = {
    "en": frozenset("a about all an and are as at be been but by can for from had has have he her his if in is it its not of on or she that the their they this to was were which will with you".split()),
    "fr": frozenset("au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous".split()),
    "de": frozenset("als am an auch auf aus bei das dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und von war wie zu zum zur".split()),
    "es": frozenset("a al como con de del el ella en entre era es esta este fue ha hay la las le lo los más no o para pero por que se ser sin sobre son su sus también un una y ya".split()),
}

SHORT, LONG = 70, 200
LINKED = 0.33
#: Of the densities of paragraphs of LONG or more, the least 10 % and 25 % quantile of the four languages (sf0.1, even page_id).
LOW, HIGH = 0.17, 0.23
#: Steps of the second pass: over such an edge, and to the label that the structure alone suggests.
CROSSING, PRIOR = 3, 3

_TOKEN = re.compile(
    r"<(?:!--(?P<note>.*?)(?:-->|\Z)|!\[CDATA\[.*?\]\]>|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|[!?/][^>]*+>)",
    re.S,
)
_CUT = re.compile(r"<(?:/?[a-zA-Z]|!)[^<>]*\Z")
_MARKS = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    #: Share of the text that is linked.
    linked: float
    #: Whether it stands in an article element, and in an element made for something else.
    inside: bool
    outside: bool


def blocks(page: str) -> list[Block]:
    """The blocks that have text, in page order."""
    out: list[Block] = []
    opened: list[tuple[str, bool, bool]] = []  # name, whether it begins an article, whether it is made for something else
    inside = outside = links = breaks = 0
    parts: list[str] = []  # of the open block
    aside: list[str] = []  # its text in elements made for something else
    linked = 0

    def close():
        nonlocal parts, aside, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, min(1.0, linked / len(text)), inside > 0, False))
        elif aside and (text := " ".join(html.unescape("".join(aside)).split())):
            out.append(Block(text, 0.0, inside > 0, True))
        parts, aside, linked = [], [], 0

    def leave(k: int):
        nonlocal inside, outside, links
        while len(opened) > k:
            name, i, o = opened.pop()
            inside -= i
            outside -= o
            links -= name == "a"

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        if not m and (cut := _CUT.search(piece)):
            piece = piece[: cut.start()]
        if piece:
            (aside if outside else parts).append(piece)
            if not piece.isspace():
                breaks = 0
                if links and not outside:
                    linked += len(" ".join(html.unescape(piece).split()))
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name in BLOCKS:
                close()
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == name:
                    leave(k)
                    break
                if opened[k][0] in BLOCKS and name not in BLOCKS:
                    break
            continue
        if name in SKIPPED and name != "head":
            if name in FOREIGN and _self_closed(m["attrs"] or m["attrs2"] or ""):
                continue
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                close()
            continue
        if name in BLOCKS:
            close()
            breaks = 0
            if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") or name in HEADINGS:  # these end the one before
                for k in range(len(opened) - 1, -1, -1):
                    if opened[k][0] == name or (opened[k][0] == "p" and name not in VOID):
                        leave(k)
                        break
                    if opened[k][0] in BLOCKS:
                        break
        if name in VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        marks = [x for a in _MARKS.findall(attrs) for x in (a[0] or a[1] or a[2]).split()] if "=" in attrs else []
        in_here = name in INSIDE or "main" in marks
        out_here = name in OUTSIDE or (name == "header" and not inside) or (not in_here and name not in ("body", "html") and any(map(BOILERPLATE.fullmatch, marks)))
        opened.append((name, in_here, out_here))
        inside += in_here
        outside += out_here
        links += name == "a"
    close()
    return out


def _self_closed(attrs: str) -> bool:
    """Whether the slash at the end is the tag's own, not the end of an unquoted value."""
    before = attrs[: max(map(attrs.rfind, " \t\n\r\f\"'")) + 1]
    return attrs.endswith("/") and "=" not in attrs[len(before) :] and not before.rstrip().endswith("=")


def stop_density(text: str) -> float:
    words = [w.lower() for w in _WORD.findall(text)]
    return max((sum(map(s.__contains__, words)) for s in STOP_WORDS.values()), default=0) / len(words) if words else 0.0


def first_pass(found: list[Block]) -> tuple[list[int], bool]:
    """Labels (1: text; -1: not; 0: undecided), and whether the page's articles say anything."""
    features = [(len(b.text), b.linked, stop_density(b.text) if len(b.text) >= SHORT and not b.outside and b.linked <= LINKED else 0.0) for b in found]
    plain = [-1 if b.outside else label(*f, False, False) for b, f in zip(found, features)]
    articles = {x for x, b in zip(plain, found) if b.inside and not b.outside}
    elsewhere = {x for x, b in zip(plain, found) if not b.inside and not b.outside}
    hint = bool(articles) and (1 in articles or 1 not in elsewhere)
    return [-1 if b.outside else label(*f, hint and b.inside, hint and not b.inside) for b, f in zip(found, features)] if hint else plain, hint


def label(length: int, linked: float, density: float, inside: bool, elsewhere: bool) -> int:
    """One block's label; `inside` an article, `elsewhere` on a page with an article, or neither."""
    if linked > LINKED:
        return -1
    if length < SHORT:
        return -1 if linked else 0
    if density >= HIGH:
        return 1 if length >= LONG or inside else 0
    if density >= LOW:
        return 0 if length < LONG or elsewhere else 1
    return -1 if length >= LONG and not inside else 0


def second_pass(found: list[Block], labels: list[int], hint: bool) -> list[bool]:
    """Undecided blocks get the label of the nearest decided block; of two as near, text wins but outside an article of the page."""
    if not hint and not any(labels):
        return [True] * len(labels)
    far = 1 << 40

    def distances(order: range) -> list[tuple[int, int]]:
        """To the nearest good and bad block on one side."""
        out, good, bad, before = [], far, far, None
        for k in order:
            here = (hint and found[k].inside, found[k].outside)
            step = 1 + (CROSSING if before not in (None, here) else 0)
            good, bad, before = good + step, bad + step, here
            if labels[k]:
                good, bad = (0, bad) if labels[k] > 0 else (good, 0)
            out.append((good, bad))
        return out

    n = len(labels)
    kept = []
    for b, x, one, other in zip(found, labels, distances(range(n)), distances(range(n - 1, -1, -1))[::-1]):
        good, bad = min(one[0], other[0]), min(one[1], other[1])
        if hint:
            good, bad = (min(good, PRIOR), bad) if b.inside else (good, min(bad, PRIOR))
        kept.append(x > 0 or (x == 0 and (good < bad or (good == bad and (b.inside or not hint)))))
    return kept


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels, hint = first_pass(found)
    return "\n".join(b.text for b, kept in zip(found, second_pass(found, labels, hint)) if kept)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the address, `text` and n_chars."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for key, url, page in zip(*(c.to_pylist() for c in b.columns)):
                    text = main_text(page)
                    yield key, url, text, len(text)

        yield from rebatch(rows(), schema, lambda r: 4 * r[3])

    selected = df.select(df[id_col].alias("id"), df[url_col].alias("url"), df[html_col].alias("html"))
    return selected.mapInArrow(tidy(run), "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
