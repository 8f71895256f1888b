"""Main text of web pages by two-pass block rules.

A page is cut into text blocks. Pass one decides a block from its own signs: the containers it
stands in, stop-word density, length and link density. Pass two gives every undecided short
block the label of its nearest decided neighbours. An ``article`` or ``main`` element is one sign
among others: inside it the thresholds are lower and a tie of the neighbours means text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where markup begins: comment, declaration, tag.
START = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][\w:-]*))")
#: One attribute: name, then a value up to white space or the end of the tag. Quotes are looked at
#: only behind "="; anywhere else they are characters like others.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=)(?:\s*=\s*)?", re.S)
UNQUOTED = re.compile(r"[^\s>]*")
TAG_ENDS = re.compile(r"[\s/]*(>?)")
#: Elements whose content is no text, and what ends them; a title also ends where the body begins.
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template textarea iframe select".split()}
TITLE_ENDS = re.compile(r"</title\s*>|(?=</head\b|<body\b)", re.I)
#: What may end a picture that is not closed: a block that opens outside a foreignObject.
SVG_PARTS = re.compile(r"(</svg\s*>)|(<foreignObject\b)|(</foreignObject\s*>)|(?=</?(?:body|article|main|section|div|p|h[1-6]|[uod]l|li|table|nav|footer|header|aside)\b)", re.I)
LINK_TAG = re.compile(r"<(/?)a(?=[\s/>])", re.I)
INLINE = set("a abbr b bdi bdo cite code data del dfn em font i img input ins kbd label mark q s samp small span strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed head hr img input link meta param source track wbr".split())
#: Containers of page furniture, by element and by words of class, id and role.
FURNITURE = set("nav header footer aside form button menu dialog".split())
FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav\w*|breadcrumbs?|header|footer|sidebar|side|aside|widget|cookies?|consent|notice|popup|modal|"
    r"newsletter|subscribe|share|social|related|comments?|replies|disqus|login|search|legal|copyright|toolbar|pagination)(?:$|[\s_-])", re.I)  # fmt: skip
#: Names that tell of a layout, not of a container: has-sidebar, with-menu-left, no-footer.
LAYOUT = re.compile(r"(?<![^\s_-])(?:has|with|without|no|not)[_-]\S*", re.I)
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: Names that chapters of an article have too; as the id of a part with a heading they are anchors.
CHAPTERS = set("related legal search menu notice copyright social login header footer nav navigation share side".split())
MAIN = {"article", "main"}
ROOTS = MAIN | {"html", "body"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
STOP_WORDS = set(
    "a an and are as at be but by for from had has have he her his i if in is it its not of on or our she so that the their they this to was we were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind und von war wie wir zu zum zur "
    "al como con de del el ella en es esta este la las lo los más no para pero por que se sin su sus un una y ya "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui sa ses son sur un une vous à".split()
)
#: Link density above which a block is a menu; lengths (characters) of short and long blocks;
#: stop-word shares of low and high density. Inside article and main the last four are lower by
#: IN_MAIN, and long text without stop words (another language) may hold links up to MAIN_LINKS.
MAX_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.5, 70, 200, 0.1, 0.25
IN_MAIN, MAIN_LINKS = 0.5, 0.25


class Block:
    __slots__ = ("furniture", "linked", "main", "named", "parts")

    def __init__(self, furniture: bool, main: int, named: int) -> None:
        self.parts: list[str] = []
        self.linked = 0
        #: inside furniture by element or hidden; which article or main; innermost container with a furniture name, or -1
        self.furniture, self.main, self.named = furniture, main, named


def quoted(html: str, at: int) -> tuple[str, int]:
    """Value that starts with a quote at ``at``, and where it ends.

    A quote without a partner, or whose partner opens another value behind a ">", ends at the ">".
    """
    end = html.find(html[at], at + 1)
    tag = html.find(">", at, end if end >= 0 else len(html))
    if end < 0 or tag >= 0 and html[end + 1 : end + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
        return (html[at + 1 : tag], tag) if tag >= 0 else (html[at + 1 :], len(html))
    return html[at + 1 : end], end + 1


def attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of a tag, the place after its ">", and whether it closes itself."""
    found: dict[str, str] = {}
    while True:
        ends = TAG_ENDS.match(html, at)
        if ends.group(1) or ends.end() == len(html):
            return found, ends.end(), "/" in html[max(at, ends.end() - 2) : ends.end()]
        m = ATTRIBUTE.match(html, at)
        name, at = m.group(1).lower(), m.end()
        value = ""
        if html[at - 1] == "=" or m.group(0).rstrip().endswith("="):
            if html[at : at + 1] in ("'", '"') and html[at : at + 1]:
                value, at = quoted(html, at)
            else:
                value, at = (v := UNQUOTED.match(html, at)).group(0), v.end()
        found.setdefault(name, value)


class Tag:
    """A tag or, with an empty name, markup without text such as a comment."""

    __slots__ = ("attributes", "closing", "end", "name", "start")

    def __init__(self, start: int, end: int, name: str = "", closing: bool = False, attrs: dict[str, str] | None = None) -> None:
        self.start, self.end, self.name, self.closing, self.attributes = start, end, name, closing, attrs or {}


def tags_of(html: str) -> Iterator[Tag]:
    """Tags in page order, in one pass; a "<" behind the last ">" is text."""
    at, last, pictures_end = 0, html.rfind(">"), True
    while (m := START.search(html, at)) and m.start() < last:
        start, end = m.start(), m.end()
        name, closing = (m.group(4) or "").lower(), bool(m.group(3))
        if m.group(1):
            end = html.find("-->", end)
            at = len(html) if end < 0 else end + 3
            yield Tag(start, at)
            continue
        if m.group(2):
            at = html.find(">", end) + 1 or len(html)
            yield Tag(start, at)
            continue
        attrs, at, empty = attributes(html, end)
        if not closing and name in RAW:
            at = m.end() if (m := RAW[name].search(html, at)) else len(html)
            name = ""
        elif not closing and name == "title":
            at = m.end() if (m := TITLE_ENDS.search(html, at)) else len(html)
            name = ""
        elif not closing and name == "svg":
            if not empty:
                at, whole = _picture_end(html, at, pictures_end)
                pictures_end = pictures_end and whole
            name = ""
        yield Tag(start, at, name, closing, attrs)


def _picture_end(html: str, at: int, nested: bool) -> tuple[int, bool]:
    """Where a picture ends. With a foreignObject that never ends, at the first sign of an end."""
    first, depth = None, 0
    for m in SVG_PARTS.finditer(html, at):
        if m.group(2):
            depth += 1
        elif m.group(3):
            depth = max(0, depth - 1)
        else:
            first = m.end() if first is None else first
            if not depth or not nested:
                return (m.end() if not depth else first), True
    return (len(html) if first is None else first), not depth


class Container:
    """An element with a furniture name: the one around it, and whether it is a chapter."""

    __slots__ = ("before", "chapter", "parent")

    def __init__(self, parent: int, before: int | None) -> None:
        #: number of blocks before it where its name is an anchor, else null
        self.parent, self.before, self.chapter = parent, before, False


def blocks_of(html: str) -> tuple[list[Block], list[Container]]:
    """Text blocks in page order with their containers' signs, and the containers they name."""
    out: list[Block] = []
    open_tags: list[tuple[str, bool, int, int]] = []  # name, and the signs outside it
    opened: dict[str, int] = defaultdict(int)
    inside, main, mains, at = False, 0, 0, 0
    #: The open link: tags open around it, and whether its end tag is there.
    link: tuple[int, bool] | None = None
    named = -1
    containers: list[Container] = []
    block = Block(False, 0, -1)

    def close_block() -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = Block(inside, main, named)

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            if link:
                block.linked += len(" ".join(unescape(text).split()))

    def pop(name: str) -> None:
        nonlocal inside, main, named, link
        while open_tags:
            top, inside, main, named = open_tags.pop()
            opened[top] -= 1
            if link and len(open_tags) < link[0]:
                link = None
            if top == name:
                return

    for tag in tags_of(html):
        add(html[at : tag.start])
        at, name = tag.end, tag.name
        if not name:
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            link = None
            if not tag.closing and "href" in tag.attributes:
                after = LINK_TAG.search(html, at)
                link = (len(open_tags), bool(after and after.group(1)))
        if name in INLINE:
            continue
        if link and not link[1]:
            link = None  # a link without an end tag goes no further than its block
        if tag.closing:
            if opened[name]:
                pop(name)
        else:
            if name in ENDS_P and opened["p"]:
                pop("p")
            elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and open_tags and open_tags[-1][0] == name:
                pop(name)
            if name in HEADINGS and named >= 0 and containers[named].before == len(out) + bool("".join(block.parts).strip()):
                containers[named].chapter = True
            if name not in VOID:
                open_tags.append((name, inside, main, named))
                opened[name] += 1
                said = tag.attributes
                names = " ".join(said[k] for k in ("class", "id", "role") if k in said and not (k == "id" and name in HEADINGS))
                bad = bool(FURNITURE_NAME.search(LAYOUT.sub(" ", names)))
                hidden = "hidden" in said or said.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(said.get("style", "")))
                inside = inside or name in FURNITURE and not (name == "header" and main) or hidden
                if name in MAIN or "main" in names.lower().split() and not bad:
                    named = named if bad else -1  # a wrapper's name says nothing of the article in it
                    if not main:
                        main = mains = mains + 1
                elif bad and name not in ROOTS:
                    others = LAYOUT.sub(" ", f"{said.get('class', '')} {said.get('role', '')}")
                    anchor = main and said.get("id", "").lower() in CHAPTERS and not FURNITURE_NAME.search(others)
                    containers.append(Container(named, len(out) + bool("".join(block.parts).strip()) if anchor else None))
                    named = len(containers) - 1
        close_block()
    add(html[at:])
    close_block()
    return out, containers


def first_pass(block: Block, text: str) -> int | None:
    """1 = main text, 0 = furniture, None = a short block without clear signs."""
    if block.furniture or block.linked > MAX_LINKS * len(text):
        return 0
    if text[:1] == "©" and (not block.main or len(text) < LONG):
        return 0
    lower = IN_MAIN if block.main else 1
    if len(text) < lower * SHORT:
        return None
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(len(words), 1)
    if stops >= lower * MANY_STOPS:
        return 1
    if len(text) >= lower * LONG:
        return 1 if stops >= lower * FEW_STOPS or block.linked <= (MAIN_LINKS * len(text) if block.main else 0) else 0
    return 1 if stops >= lower * FEW_STOPS else None


def furniture_by_name(blocks: list[Block], labels: list[int | None], texts: list[str], containers: list[Container]) -> list[bool]:
    """Blocks in a container whose name says furniture, however long they are.

    The name is refuted where the container holds all blocks of the page that pass one calls text
    (the wrapper of a page), or is a chapter of an article: an anchor with a heading and prose.
    """
    prose = [0] * len(containers)
    every = 0
    for block, label, text in zip(blocks, labels, texts, strict=True):
        if label == 1 and not block.furniture:
            every += len(text)
            if block.named >= 0:
                prose[block.named] += len(text)
    for i in range(len(containers) - 1, -1, -1):
        if containers[i].parent >= 0:
            prose[containers[i].parent] += prose[i]
    bad: list[bool] = []
    for n, c in zip(prose, containers, strict=True):
        refuted = n >= LONG and (n == every or c.chapter)
        bad.append(not refuted or c.parent >= 0 and bad[c.parent])
    return [block.named >= 0 and bad[block.named] for block in blocks]


def _nearest(labels: list[int | None], mains: list[int]) -> list[int | None]:
    """The last label decided before each block; inside article or main only one of the same element.

    Furniture that stands in the element comes with main 0: a form says nothing of the text beside it.
    """
    out: list[int | None] = []
    last: int | None = None
    own: dict[int, int] = {}
    for label, main in zip(labels, mains, strict=True):
        out.append(own.get(main) if main else last)
        if label is not None:
            own[main] = last = label
    return out


def second_pass(labels: list[int | None], mains: list[int], texts: list[str]) -> list[bool]:
    """Undecided blocks: both neighbours agree, or the only one decides.

    Between text and furniture a heading opens the text below it, and inside article or main the
    element decides for text; anything else is left out. Without decided neighbours it stays.
    """
    before, after = _nearest(labels, mains), _nearest(labels[::-1], mains[::-1])[::-1]
    out = []
    for own, main, text, left, right in zip(labels, mains, texts, before, after, strict=True):
        near = {x for x in (left, right) if x is not None}
        tie = len(near) == 2 and (main > 0 or right == 1 and not text.endswith((".", "!", "?")))
        out.append(own == 1 or own is None and (near in (set(), {1}) or tie))
    return out


def extract_text(html: str | None) -> str:
    """The main text of one page; empty when there is none.

    Inside a block all white space becomes one space; blocks follow in page order with a space
    between. Nothing is capped. Malformed markup: a quote opens a value only behind "=" and ends at
    the tag's ">" when it has no partner, tags without ">" are text, raw elements and comments that
    are not closed reach to the end of the page. The work is linear in the page.
    """
    found, containers = blocks_of(html or "")
    kept = [(b, t) for b in found if (t := " ".join(unescape("".join(b.parts)).split()))]
    blocks, texts = [b for b, _ in kept], [t for _, t in kept]
    labels = [first_pass(b, t) for b, t in kept]
    named = furniture_by_name(blocks, labels, texts, containers)
    labels = [0 if bad else label for bad, label in zip(named, labels, strict=True)]
    keep = second_pass(labels, [0 if bad or b.furniture else b.main for b, bad in zip(blocks, named, strict=True)], texts)
    return " ".join(t for t, ok in zip(texts, keep, strict=True) if ok)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``text`` and ``n_chars``; a null page is an empty one."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([extract_text(h) for h in html], dtype="object")

    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    return pages.select(*keep, main_text("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
