"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Pass one decides by density: blocks with many characters in links are
boilerplate, blocks of SHORT characters or more with enough stop words are text, the others stay open. What stands in
navigation, footers, forms and the like, or under a class or id that names such parts, is boilerplate whatever its density; names that
articles use for their own parts too (header, notice, related) count outside articles only. Pass two gives each open
block the label of its nearest decided neighbours: those of its own section if there are any, else those of the page; of both if
they agree, else of the nearer one in characters. Where nothing is decided, what stands in an article or main element, or on a page without any
decided block, is text.

Cases: null or empty html gives an empty text; unclosed and truncated markup is read as far as it
goes; repeated pages are treated alike, whatever their ids; very long or deeply nested pages take time in proportion; an empty
table gives no rows; other columns may stand beside page_id, url and html.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|svg|select|textarea|object)\b(?:[^>]*/>|.*?(?:</\1\s*>|\Z))", re.I | re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)|<[!?][^>]*>", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# fixed values: the elements and names these rules know
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("head title nav footer aside form button dialog menu".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "disqus reply replies cookie cookies consent gdpr popup modal newsletter subscribe share sharing toolbar pagination pager login signup contentinfo".split()
)
OUTSIDE = frozenset("header masthead menu notice notices social related recommended widget skip search complementary".split())  # count outside articles only
AREAS = frozenset("article main section aside nav header footer form body div td".split())
SCOPES = frozenset("div ul ol table section article dl aside nav footer blockquote".split())
CLOSED_BY = {"p": ("p",), "li": ("li",), "tr": ("tr",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i if in into is it its more no not of on one or our she so some than that the their them there they this to was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais mes ne nous on ou par pas pour qu que qui sa se ses son sur te tu un une vous "
    "aber als am auch auf aus bei bin bis das dass dem den der des die doch du ein eine einem einen einer es für haben hat ich ihr im ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wie wir zu zum zur "
    "al como con cuando del el ella ellos era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se si sin sobre su sus también un una uno y ya".split()
)
SHORT, LINKED, STOPS = 60, 0.4, 0.12
WORDS = re.compile(r"[^\W\d_]+")
GOOD, BAD, OPEN = 1, 0, -1


def _parts(attributes: str) -> set[str]:
    """Words of the classes, ids and roles; side-bar is sidebar, has-sidebar says nothing of the element itself."""
    names = (n for m in NAMED.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().replace("side-bar", "sidebar").split())
    return {w for n in names for w in (re.split(r"[_-]+", n) if not n.startswith(("has-", "with-", "without-", "no-", "is-", "not-")) else ())}


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    bad: bool  # boilerplate by place
    article: bool  # inside an article or main element
    area: int  # number of the innermost section


class _Open(NamedTuple):
    tag: str
    bad: bool
    article: bool
    link: bool
    area: int


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that have text."""
    page = RAW.sub(" ", page)
    out: list[Block] = []
    top = _Open("", False, False, False, 0)
    stack, opened, areas = [top], Counter(), 0
    pieces: list[str] = []
    linked = at = 0

    def close(depth: int) -> None:
        opened.subtract(x.tag for x in stack[depth:])
        del stack[depth:]

    def end() -> None:
        nonlocal linked
        if text := " ".join(entities.unescape("".join(pieces)).split()):
            inner = stack[-1]
            out.append(Block(text, linked, inner.bad, inner.article, inner.area))
        pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    def nearest(tags: tuple[str, ...], within: frozenset = frozenset()) -> int | None:
        if not any(opened[t] > 0 for t in tags):
            return None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in within:
                return None
        return None

    for m in TAG.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            end()
        if m[1] or m[4]:
            if (depth := nearest((tag,))) is not None:
                close(depth)
        elif tag not in VOID:
            if tag in CLOSED_BY and (depth := nearest(CLOSED_BY[tag], SCOPES)) is not None:  # an open one of these ends here
                close(depth)
            outer, own = stack[-1], m[3] or m[6] or ""
            names = _parts(own) if own and tag not in ("html", "body") else set()
            bad = outer.bad or tag in OUT or not names.isdisjoint(PARTS) or not outer.article and (tag == "header" or not names.isdisjoint(OUTSIDE))
            areas += tag in AREAS
            stack.append(_Open(tag, bad, outer.article or tag in ("article", "main"), outer.link or tag == "a", areas if tag in AREAS else outer.area))
            opened[tag] += 1
    say(page[at:])
    end()
    return out


def first_labels(found: list[Block]) -> list[int]:
    """GOOD or BAD by density, OPEN where it says nothing."""
    out = []
    for b in found:
        words = WORDS.findall(b.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        out.append(BAD if b.bad or b.linked > LINKED * len(b.text) else GOOD if len(b.text) >= SHORT and stops >= STOPS else OPEN)
    return out


def _neighbours(found: list[Block], labels: list[int], same: bool) -> list[list[tuple[int, int]]]:
    """Label and distance of the nearest decided block on either side; same: in the same area only."""
    sides = []
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last: dict[int, tuple[int, int]] = {}  # area: label and place in characters
        side, place = [(OPEN, 0)] * len(labels), 0
        for k in order:
            area = found[k].area if same else 0
            label, where = last.get(area, (OPEN, 0))
            side[k] = (label, place - where)
            place += len(found[k].text)
            if labels[k] != OPEN:
                last[area] = (labels[k], place)
        sides.append(side)
    return sides


def final_labels(found: list[Block], labels: list[int]) -> list[int]:
    """Open blocks inherit from their neighbours."""
    out, some = list(labels), GOOD in labels
    near = [_neighbours(found, labels, same) for same in (True, False)]
    for k, label in enumerate(labels):
        if label != OPEN:
            continue
        for (a, far_a), (b, far_b) in ((sides[0][k], sides[1][k]) for sides in near):
            if a != OPEN or b != OPEN:
                out[k] = b if a == OPEN or b != OPEN and far_b < far_a else a
                break
            if found[k].article or not some:
                break
        if out[k] == OPEN:
            out[k] = GOOD
    return out


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    return " ".join(b.text for b, label in zip(found, final_labels(found, first_labels(found))) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
