"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block elements (and at double line breaks). Each
block knows its length, its share of linked characters, its share of stop words
and the elements around it.

First pass. Blocks in navigation, footers, page headers, sidebars, forms,
adverts, notices and reader comments (by element, role, class or id) are bad,
and so are blocks that are mostly links. Where the page marks its article, what
lies outside is bad too. Of the rest, long blocks are good inside the article,
and good elsewhere if enough of their words are stop words; short ones stay
undecided.

Second pass. An undecided block takes the label of the nearest decided block
before or behind it in its article or container, else on the page (a heading
that of the block behind it); at equal distance with different labels it is
good if it holds enough stop words. An article without any decided block is
good as a whole, and so are a page's undecided blocks if none is good.

Null or empty pages give an empty text, as do pages without main text.
Character references are decoded, white space within a block becomes one
space, blocks are joined by an empty line. Repeated rows stay; further columns
are carried only if asked for. An empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ebbtide.llm.common import lean

#: Frequent function words of seven languages.
STOP_WORDS = frozenset(
    (
        "a an the and or but of to in on at by for from with as is are was were be been it its this that not have has had he she they we you i "
        "der die das den dem ein eine einen und oder aber von zu im in mit auf für ist sind war nicht es er sie wir ich sich auch als wie "
        "le la les un une des du et ou mais de à au aux en dans pour par sur avec est sont était ne pas il elle nous vous que qui ce se "
        "el los las una y o pero del al con por para es son era no se su que lo como más "
        "il lo gli di che non per è sono della nel os uma um do da em não com mais het een van op te dat niet zijn voor met aan"
    ).split()
)
SHORT = 70
LONG = 140
LINKED = 0.66
LINKED_OUTSIDE = 0.33
STOP_LOW = 0.15
STOP_HIGH = 0.30
#: A marked article counts from this share of the page's text on.
ARTICLE_SHARE = 0.1

_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose blocks belong together.
_CONTAINER = frozenset("html body article main section div td th form details figure center nav aside header footer".split())
#: Elements without text of the page; some are left alone if they are never closed.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg canvas audio video object".split())
_HARD = frozenset("nav footer aside menu dialog search button select option optgroup fieldset legend label".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that an opening one ends.
_PARAGRAPH = frozenset({"p"})
_ENDS = {"li": frozenset({"p", "li"}), "dt": frozenset({"p", "dt", "dd"}), "dd": frozenset({"p", "dt", "dd"}), "tr": frozenset({"p", "tr", "td", "th"})}
_ENDS |= {name: frozenset({"p", "td", "th"}) for name in ("td", "th")} | {name: _HEADINGS | {"p"} for name in _HEADINGS}
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_BAD_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu sidenav breadcrumb breadcrumbs footer colophon copyright legal disclaimer privacy sidebar sidebars aside rail "
    "widget widgets ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion "
    "promotions banner banners cookie cookies cookiebar consent gdpr notice notices notification notifications announcement alert alerts popup modal overlay "
    "toast newsletter subscribe subscription signup login register search searchform share sharing social related recommended recommendations trending popular "
    "comment comments commentlist respond reply replies disqus discussion pagination pager toolbar dropdown skip".split()
)
_TOP_WORDS = frozenset("header masthead topbar".split())
_GOOD_WORDS = frozenset("article post entry content story main body text".split())
_GOOD_NAMES = frozenset(
    "article article-body article-content article-text articlebody post-body post-content entry-content story-body story-content main-content page-content body-text".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop|itemtype)\b", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in _RAW}
_OWNERS_MARK = re.compile(r"(©|\(c\)|copyright\b|all rights reserved)", re.IGNORECASE)


@dataclass(slots=True)
class Region:
    """An element whose content does not belong to the article, unless `needs` shows otherwise."""

    kind: str
    around: Region | None = None
    main: bool = False
    article: bool = False
    title: bool = False
    bad: bool = True

    def tell(self) -> None:
        """What this element holds, the one around it holds as well."""
        if self.around:
            self.around.main |= self.main
            self.around.article |= self.article
            self.around.title |= self.title

    def judge(self) -> None:
        if self.kind == "form":
            self.bad = not (self.main or self.article or self.title)
        elif self.kind == "class":
            self.bad = not (self.main or (self.article and self.title))
        self.bad = self.bad or bool(self.around and self.around.bad)


@dataclass(slots=True)
class Block:
    text: str
    linked: float
    heading: bool
    item: bool
    article: int
    main: int
    marked: int
    parent: int
    region: Region | None
    label: str | None = None

    def stop_share(self) -> float:
        words = [w.strip(".,;:!?()[]\"'«»“”¿¡…-") for w in self.text.lower().split()]
        return sum(w in STOP_WORDS for w in words) / max(1, len(words))


@dataclass(slots=True)
class _Element:
    name: str
    number: int
    region: Region | None = None
    article: int = 0
    main: int = 0
    marked: int = 0
    link: bool = False


def _names(value: str) -> list[tuple[str, set[str]]]:
    """Class or id names with the words they consist of."""
    return [(name.lower(), {w for part in (name, _CAMEL.sub("-", name)) for w in re.split(r"[-_]+", part.lower()) if w}) for name in value.split()]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _unwanted(attributes: dict[str, str], inside: bool) -> bool:
    """By role, class or id; a header inside the article is the article's own."""
    if attributes.get("role", "").lower() in _BAD_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.IGNORECASE) or "comment" in attributes.get("itemtype", "").lower():
        return True
    names = _names(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    if any(name in _GOOD_NAMES for name, _ in names):
        return False
    for name, words in names:
        if re.match(r"(has|with|no|without|is)[-_]", name):
            continue
        if words & _BAD_WORDS or (words & _TOP_WORDS and not inside and not words & _GOOD_WORDS):
            return True
    return False


@dataclass
class _Reader:
    """Collects the blocks of one page."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=list)
    region: Region | None = None
    regions: list[Region] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    breaks: int = 0
    articles: list[int] = field(default_factory=list)
    mains: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    links: int = 0
    headings: int = 0
    numbers: int = 0

    def text(self, raw: str) -> None:
        raw = html_lib.unescape(raw) if "&" in raw else raw
        self.parts.append(raw)
        if not raw.isspace():
            self.breaks = 0
            if self.links:
                self.linked += len("".join(raw.split()))

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            size = len(text) - text.count(" ")
            heading = self.headings > 0
            last = [x[-1] if x else 0 for x in (self.articles, self.mains, self.marks)]
            self.blocks.append(Block(text, self.linked / size, heading, self.opened["li"] > 0, *last, self.parents[-1] if self.parents else 0, self.region))
        self.parts, self.linked, self.breaks = [], 0, 0

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks > 1:
                self.end_block()
            return
        if name in _BLOCK:
            self.end_block()
            self._leave_paragraph(name)
        if name in _VOID or (attributes.endswith("/") and name not in _BLOCK):
            return
        if name == "a" and self.opened["a"]:
            self.close("a")
        inside = bool(self.articles or self.mains)
        known = _attributes(attributes) if attributes and _NAMED.search(attributes) else {}
        self.numbers += 1
        element = _Element(name, self.numbers, link=name == "a" and "href" in attributes.lower())
        kind = None
        if name in _HARD or (name == "header" and not inside):
            kind = "hard"
        elif name == "form":
            kind = "form"
        elif known and name not in ("html", "body", "main") and _unwanted(known, inside):
            kind = "class"
        if kind:
            self.end_block()
            element.region = self.region = Region(kind, self.region)
            self.regions.append(self.region)
        if name == "article" or known.get("itemprop", "").lower() == "articlebody":
            element.article = element.number
            self.articles.append(element.number)
            if self.region:
                self.region.article = True
        elif name == "main" or known.get("role", "").lower() == "main":
            element.main = element.number
            self.mains.append(element.number)
            if self.region:
                self.region.main = True
        elif known and any(n in _GOOD_NAMES for n, _ in _names(f"{known.get('class', '')} {known.get('id', '')}")):
            element.marked = element.number
            self.marks.append(element.number)
        if name == "h1" and self.region:
            self.region.title = True
        self.links += element.link
        self.headings += name in _HEADINGS
        if name in _CONTAINER:
            self.parents.append(element.number)
        self.stack.append(element)
        self.opened[name] += 1

    def _leave_paragraph(self, name: str) -> None:
        """A block element ends an open paragraph or heading, a list item the item before it."""
        ends = _ENDS.get(name, _PARAGRAPH)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name in ends:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].name in _BLOCK:
                return

    def _pop(self) -> None:
        element = self.stack.pop()
        self.opened[element.name] -= 1
        self.links -= element.link
        self.headings -= element.name in _HEADINGS
        for number, held in ((element.article, self.articles), (element.main, self.mains), (element.marked, self.marks)):
            if number:
                held.pop()
        if element.name in _CONTAINER:
            self.parents.pop()
        if element.region:
            element.region.tell()
            self.region = element.region.around

    def close(self, name: str) -> None:
        if name in _BLOCK or name == "br":
            self.end_block()
        if not self.opened[name]:
            return
        while self.stack[-1].name != name:
            if self.stack[-1].region:
                self.end_block()
            self._pop()
        if self.stack[-1].region:
            self.end_block()
        self._pop()


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, each with the elements around it."""
    reader, pos, unclosed = _Reader(), 0, set()
    while pos < len(page):
        at = page.find("<", pos)
        if at < 0:
            reader.text(page[pos:])
            break
        if at > pos:
            reader.text(page[pos:at])
        tag = _TAG.match(page, at)
        if tag:
            pos = tag.end()
            closing, name, attributes = tag[1], tag[2].lower(), tag[3]
            if closing:
                reader.close(name)
            elif name in _RAW and name not in unclosed and not attributes.endswith("/"):
                end = _CLOSING[name].search(page, pos)
                if end:
                    pos = end.start()
                elif name in ("script", "style"):
                    break
                else:
                    unclosed.add(name)
            else:
                reader.open(name, attributes)
        elif page.startswith("<!--", at):
            end = -1 if "--" in unclosed else page.find("-->", at + 2)
            if end < 0:
                unclosed.add("--")
                end = page.find(">", at)
                pos = end + 1 if end >= 0 else len(page)
            else:
                pos = end + 3
        elif page[at + 1 : at + 2] in ("!", "?", "/") or page[at + 1 : at + 2].isalpha():
            end = page.find(">", at)
            pos = end + 1 if end >= 0 else len(page)
        else:
            reader.text("<")
            pos = at + 1
    reader.end_block()
    while reader.stack:
        reader._pop()
    for region in reader.regions:  # outer ones come first
        region.judge()
    return reader.blocks


def _first_pass(blocks: Sequence[Block]) -> None:
    """Labels what its surroundings, links, length and stop words decide."""
    for b in blocks:
        if b.region and b.region.bad:
            b.label = "bad"
    rest = [b for b in blocks if b.label is None]
    total = sum(len(b.text) for b in rest)
    for scope in ("article", "main"):
        inner = sum(len(b.text) for b in rest if getattr(b, scope))
        if inner and inner >= ARTICLE_SHARE * total:
            for b in rest:
                if not getattr(b, scope):
                    b.label = "bad"
            break
    rest = [b for b in rest if b.label is None]
    plain = [b for b in rest if not (b.article or b.main or b.marked)]
    # a page in a language without listed stop words is judged by length alone
    sizes = sum(len(b.text) for b in plain)
    known = sizes and sum(b.stop_share() * len(b.text) for b in plain) >= STOP_LOW / 2 * sizes
    for b in rest:
        inside = b.article or b.main or b.marked
        size = len(b.text)
        if b.linked > (LINKED if inside else LINKED_OUTSIDE) and not (b.heading and inside):
            b.label = "bad"
        elif inside:
            b.label = "good" if size >= SHORT and not b.heading else None
        elif size < SHORT or b.heading:
            b.label = "bad" if b.linked > 0 and not b.heading or _OWNERS_MARK.search(b.text) else None
        elif not known or b.stop_share() >= STOP_HIGH:
            b.label = "good" if size > LONG else None
        elif b.stop_share() < STOP_LOW:
            b.label = "bad"


def _neighbours(blocks: Sequence[Block], groups: Sequence[int], heard: Sequence[bool]) -> list[list[tuple[int, str] | None]]:
    """Per block the nearest decided block of its group before and behind it."""
    out: list[list[tuple[int, str] | None]] = [[None, None] for _ in blocks]
    for side, order in ((0, range(len(blocks))), (1, range(len(blocks) - 1, -1, -1))):
        last: dict[int, tuple[int, str]] = {}
        for i in order:
            out[i][side] = last.get(groups[i])
            if blocks[i].label and heard[i]:
                last[groups[i]] = (i, blocks[i].label)
    return out


def _second_pass(blocks: Sequence[Block]) -> list[bool]:
    """Which blocks are good, once undecided ones have taken their neighbours' labels."""
    marked = [b.article or b.main or b.marked for b in blocks]
    own = _neighbours(blocks, [m or b.parent for m, b in zip(marked, blocks, strict=True)], [not (b.region and b.region.bad) for b in blocks])
    others = _neighbours(blocks, [0] * len(blocks), [True] * len(blocks))
    any_good = any(b.label == "good" for b in blocks)
    out = []
    for i, b in enumerate(blocks):
        before, behind = own[i] if marked[i] or any(own[i]) else others[i]
        if b.label:
            good = b.label == "good"
        elif not any_good or not (before or behind):
            good = True
        elif b.heading and behind:
            good = behind[1] == "good"
        elif before and behind and before[1] != behind[1]:
            up, down = i - before[0], behind[0] - i
            label = before[1] if up < down else behind[1] if down < up else None
            good = label == "good" if label else b.stop_share() >= STOP_LOW
        else:
            good = (before or behind)[1] == "good"
        out.append(good)
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    blocks = page_blocks(page or "")
    _first_pass(blocks)
    return "\n\n".join(b.text for b, good in zip(blocks, _second_pass(blocks), strict=True) if good)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch["_page"]]
        kept = [n for n in batch.schema.names if n != "_page"]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(texts, pa.string()), sizes], [*kept, "text", "n_chars"])


def extract_text(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns, `text` and `n_chars` (code points) of every page."""
    rows = pages.select(*keep, F.col(html).cast("string").alias("_page"))
    schema = StructType([*(rows.schema[c] for c in keep), StructField("text", StringType()), StructField("n_chars", LongType())])
    return rows.mapInArrow(lean(_extracted), schema)
