"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags, in one scan per page. Elements that
never hold main text (scripts, menus, forms, ...) are left out by their tag or role. A
class or id that speaks of what surrounds an article is evidence only: such an element
is left out unless it holds most of the page's text (nearly all, if the word is the
whole class name). Pass one decides blocks by length, link density and stop-word density, on every
page and wherever the block lies; pass two gives the open ones (short, or of few
stop words) the label of their nearest decided neighbours. The tags article and
main are evidence, not a decision: inside them more links are allowed, and open
blocks ask neighbours on their own side of the tag first. Blocks outside go
through the same rules. Dropping asks for evidence.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# fixed values: HTML's tags by what they do to the text
_RAW = "script|style|noscript|template|svg|iframe|object|canvas|math|audio|video"
_SOFT_RAW = "textarea|select|button|title"         # left open, they end where one of these begins:
_SOFT_ENDS = "p|h[1-6]|article|main|section|body|table|ul|ol|nav|footer|header|form"
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ASIDE_TAGS = frozenset("nav footer aside form dialog menu head fieldset".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# fixed values: parts of class names and ids of what surrounds an article
_ASIDE_WORDS = frozenset("ad ads adsense advert advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
                         "newsletter subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments "
                         "reply replies respond disqus share sharing social related recommended widget toolbar login search pagination pager copyright".split())
# fixed values: common function words of the languages at hand
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an they you were her she there been their has will "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais on "
    "el y los del se las por con no una su para lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<soft>{_SOFT_RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:(?!<(?:{_SOFT_ENDS})\b|</(?P=soft)\b).)*(?:</(?P=soft)\s*>|(?=<)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME_PARTS = re.compile(r"[^a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")

LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_MOST, LINKS_MOST_INSIDE, LIST_SHORT = 70, 200, 0.10, 0.15, 0.2, 0.8, 140
_BELIEVED = {"named": 0.9, "aside": 0.5, "header": 0.5}      # up to which share of the text a class is believed
_WEAK = "weak"                             # open, and of too few stop words to follow one neighbour


class _Block:
    __slots__ = ("doubts", "heading", "inside", "label", "linked", "links", "text")

    def __init__(self, text, linked, links, inside, heading, doubts):
        self.text, self.linked, self.links, self.inside, self.heading, self.doubts, self.label = text, linked, links, inside, heading, doubts, None


def _is_aside(tag: str, attrs: str) -> tuple[bool, bool, str]:
    """(never main text, a header, what its class or id says): by tag, role or being hidden."""
    if tag in _ASIDE_TAGS:
        return True, False, ""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False, tag == "header", ""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attrs)}
    if found.get("role") in _ASIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True, False, ""
    if tag in ("html", "body", "main", "article"):
        return tag == "article" and any(w.startswith("comment") for w in _NAME_PARTS.split(found.get("class", ""))), False, ""
    names = (found.get("class", "") + " " + found.get("id", "")).split()
    parts = {w for n in names for w in _NAME_PARTS.split(n)}
    said = "named" if _ASIDE_WORDS.intersection(names) else "aside" if parts & _ASIDE_WORDS else "header" if "header" in parts else ""
    if said in ("named", "aside") and tag not in _BLOCK:
        return True, tag == "header", ""                # inside a line of text: an advert, a share link
    return False, tag == "header", "" if tag == "header" and said == "header" else said


def page_blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, without those of surrounding elements."""
    blocks: list[_Block] = []
    stack: list[tuple[str, bool, bool, str]] = []      # open elements: tag, never main text, a header, what its class says
    opened: Counter[str] = Counter()                   # how many of each tag are open
    doubts: tuple[tuple[int, str], ...] = ()           # open elements whose class says something, by number
    number = 0
    aside = inside = headers = anchors = heading = 0
    pieces: list[str] = []
    linked = links = breaks = 0

    def close():
        nonlocal pieces, linked, links, breaks
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and not (headers and not (inside and heading)):
                blocks.append(_Block(text, linked, links, bool(inside), bool(heading), doubts))
        pieces, linked, links, breaks = [], 0, 0, 0

    def text_from(raw: str):
        nonlocal linked, breaks
        if raw and not aside:
            pieces.append(raw)
            if not raw.isspace():
                breaks = 0
            if anchors:
                linked += len(" ".join(html.unescape(raw).split()))

    def leave(k: int):
        nonlocal aside, inside, headers, anchors, heading, doubts
        for tag, was_aside, was_header, said in stack[k:]:
            opened[tag] -= 1
            doubts = doubts[:-1] if said else doubts
            aside -= was_aside
            headers -= was_header
            inside -= tag in ("article", "main")
            anchors -= tag == "a"
            heading -= tag in _HEADINGS
        del stack[k:]

    at = 0
    for m in _TOKEN.finditer(page):
        text_from(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:                                # a comment, a declaration or an element of raw text
            if m["raw"] or m["soft"] and m["soft"].lower() != "title":
                text_from(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            if breaks == 2:
                close()
            else:
                text_from(" ")
            continue
        block = tag in _BLOCK
        if m["end"]:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                # an inline end tag does not leave the blocks opened after it
                if block or not any(t[0] in _BLOCK for t in stack[k + 1:]):
                    if block:
                        close()
                    leave(k)
                else:
                    anchors -= tag == "a"
                    aside -= stack[k][1]
                    opened[tag] -= 1
                    del stack[k]
            elif block:
                close()
            continue
        if block:
            close()
            if tag == "body" and opened["head"]:        # its end tag may be left out
                leave(next(k for k, t in enumerate(stack) if t[0] == "head"))
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or tag in _HEADINGS:
                # these end an open paragraph or a sibling of their own kind
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == tag:
                        leave(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
        if tag in _VOID or m["attrs"].endswith("/") and not block:
            continue
        was_aside, was_header, said = _is_aside(tag, m["attrs"])
        if said and tag not in _BLOCK:
            said = ""
        stack.append((tag, was_aside, was_header, said))
        opened[tag] += 1
        if said:
            number += 1
            doubts = (*doubts, (number, said))
        aside += was_aside
        headers += was_header
        inside += tag in ("article", "main")
        heading += tag in _HEADINGS
        if tag == "a":
            anchors += 1
            links += not aside
    text_from(page[at:])
    close()
    # a class is believed unless its element holds most of the text; nearly all of it,
    # where the word is the whole name
    held, total = Counter(), sum(len(b.text) for b in blocks)
    for b in blocks:
        held.update(dict.fromkeys((d for d, _ in b.doubts), len(b.text)))
    return [b for b in blocks if not any(held[d] <= _BELIEVED[said] * total and (said != "header" or not (b.inside and b.heading)) for d, said in b.doubts)]


def _decide(b: _Block) -> bool | str | None:
    """Pass one: main text, not main text, or open (None or weak)."""
    length, density = len(b.text), b.linked / len(b.text)
    if b.inside:
        if density > LINKS_MOST_INSIDE and (b.links > 1 or length < LENGTH_LOW) and length < LIST_SHORT:
            return False
        if b.heading:
            return True if length >= LENGTH_LOW or density == 0 else None
    elif density > LINKS_MOST:
        return False
    if length < LENGTH_LOW or b.heading:
        return False if density > 0 and not b.heading and not b.inside else None
    words = _LETTERS.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= (STOP_LOW if length > LENGTH_HIGH else STOP_HIGH):
        return True
    return None if stops >= STOP_LOW or b.inside else _WEAK


def _nearest(labels: list[bool | None]) -> list[tuple[tuple[int, bool | None], tuple[int, bool | None]]]:
    """The decided neighbours before and after each place: how far, and their label."""
    far, sides = len(labels) + 1, []
    for places in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last, side = None, [(far, None)] * len(labels)
        for i in places:
            last = i if labels[i] is not None else last
            side[i] = (abs(i - last), labels[last]) if last is not None else (far, None)
        sides.append(side)
    return list(zip(*sides, strict=True))


def main_text(page: str | None) -> str:
    """The kept blocks joined by a line feed."""
    if not page:
        return ""
    blocks = page_blocks(page)
    found = [_decide(b) for b in blocks]
    if not any(x is True for x in found):              # stop words say nothing here (another language, a table): length and links decide
        found = [True if x in (None, _WEAK) and len(b.text) >= LENGTH_LOW and not b.heading else x for b, x in zip(blocks, found, strict=True)]
    decided = [None if x is _WEAK else x for x in found]
    # pass two: the nearest decided neighbours on either side, and how far away
    every = _nearest(decided)
    own = {side: _nearest([x if b.inside == side else None for b, x in zip(blocks, decided, strict=True)]) for side in {b.inside for b in blocks}}
    kept = [False] * len(blocks)
    for i, b in enumerate(blocks):
        before, after = every[i]
        if decided[i] is not None:
            kept[i] = decided[i]
        elif before[1] is None and after[1] is None:
            kept[i] = b.inside
        elif b.heading:
            kept[i] = bool(after[1])                    # a heading belongs to what follows
        elif found[i] is _WEAK:
            kept[i] = bool(before[1] and after[1])
        else:
            if own[b.inside][i] != ((len(blocks) + 1, None),) * 2:
                before, after = own[b.inside][i]
            elif b.inside:                              # nothing decided inside: the tag is all there is
                before = after = (0, True)
            kept[i] = bool(before[1] or after[1]) if before[0] == after[0] else bool(min(before, after, key=lambda x: x[0])[1])
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``.

    Null or empty html, and a page without main text, give an empty text; null
    ids and urls stay null; repeated rows give a row each; other columns are not
    read; an empty table gives no rows. Whole pages are read, however long.
    """
    def extract(batches):
        import pyarrow as pa

        for batch in slices(batches):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
