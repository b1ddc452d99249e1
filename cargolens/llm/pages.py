"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. Pass one decides each block from its text: length, share of
stop words and share of characters inside links, and from where it stands: menus, headers, footers, sidebars,
notices, adverts, forms and reader comments (by tag, role, class or id) are out, and if the page marks its
article, so is all that lies outside it. Blocks that are too short or too odd to decide are ambiguous, and so are
blocks of links and copyright lines inside a marked article; pass two gives ambiguous blocks the label of the nearest
decided neighbours of their region. Before the first and after the last decided block of a page without a marked article only
headings and paragraphs follow a good neighbour, as menus and last lines often are bare.

A class or id marks by its whole token, its first or its last part ('sidebar-left', 'site-footer'), not with a word
such as 'has' or 'no' before it. Inside an article an id marks by its whole token only, and on a heading not at all, as
ids there are made from titles. Inline elements are dropped if they are hidden or marked by class. A form is out, but not an
article inside it, and not if the page has no decided paragraph outside forms (a form around the whole page). <main> inside a wrapper marked by class or id is not out. Another article inside such
a wrapper (a layout or a teaser) is used if it has a decided paragraph and no article outside such wrappers has one.

Defined cases: null html is empty; a page without main text gives an empty string; cut-off tags, comments and
scripts end with the page; repeated pages give repeated rows; an empty table gives no rows; other columns are kept, whatever
their names, but for text and n_chars. Work is in proportion to the length of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Thresholds of the rules (characters, shares).
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
LINKS = 0.33

#: Frequent function words of four languages.
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can could for from had has have he her his how i if in into is
it its may more most my no not of on one or other our out she so some such than that the their them then there these
they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat
ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn
werden wie wird wir zu zum zur
ai au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas
plus pour que qui sa se ses si son sont sur un une vous
al como con cuando de del desde donde e el ella en entre era es esta este la las le lo los más me mi muy no nos o para
pero por que se ser si sin sobre son su sus también te tiene un una y ya
""".split())

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td
tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; the first group hides markup too.
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
HIDDEN = frozenset("head button select svg math object template canvas audio video datalist".split())
CHROME_TAGS = frozenset("nav footer aside menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre li dd figcaption".split())
CHROME_ROLES = frozenset("""navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar
toolbar""".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion reactions".split())
CHROME_WORDS = COMMENT_WORDS | frozenset("""ad ads adbox adslot adsense advert adverts advertisement advertising banner
sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie
cookies consent gdpr notice notices newsletter subscribe signup popup modal overlay share sharing social related
recommended widget toolbar pagination pager login searchbox copyright skip""".split())
#: First parts that say how a page is laid out, not what an element is.
LAYOUT_WORDS = frozenset("has no not with without is hide hidden show single".split())
REGION_WORDS = frozenset("""articlebody article-body article-content entry-content post-content post-body story-body
main-content""".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)"
                    r"(?:>|\Z)",
                    re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: How an element is marked: not at all, as an article inside a wrapper marked by class or id, by class or id, by more.
CLEAR, DOUBTFUL, NAMED, CHROME = range(4)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    chrome: int
    region: int  # 0: outside any marked article
    form: bool  # in a form, and not in an article inside it
    tag: str
    label: str = ""


@dataclass
class _Open:
    tag: str
    chrome: int
    region: int
    hidden: bool
    form: bool = False


@dataclass
class _Reader:
    """Cuts one page into blocks."""

    blocks: list[Block] = field(default_factory=list)
    open: list[_Open] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    linked: int = 0
    regions: int = 0
    counts: dict[str, int] = field(default_factory=dict)  # open elements by tag

    def push(self, element: _Open) -> None:
        self.open.append(element)
        self.counts[element.tag] = self.counts.get(element.tag, 0) + 1

    def pop(self) -> str:
        tag = self.open.pop().tag
        self.counts[tag] -= 1
        return tag

    def state(self) -> _Open:
        return self.open[-1] if self.open else _Open("", CLEAR, 0, False)

    def text(self, raw: str) -> None:
        now = self.state()
        if now.hidden or not raw:
            return
        value = entities.unescape(raw) if "&" in raw else raw
        self.pieces.append(value)
        if self.links:
            self.linked += len("".join(value.split()))

    def cut(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                now = self.state()
                self.blocks.append(Block(text, self.linked, now.chrome, now.region, now.form, now.tag))
            self.pieces = []
        self.linked = 0

    def start(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in BLOCKS:
            self.cut()
            while self.open and self.open[-1].tag not in BLOCKS and self.open[-1].tag not in HIDDEN:
                self.pop()  # inline elements end with their block
            if self.open and self.open[-1].tag == "p":
                self.pop()
        if tag == "br":
            self.pieces.append(" ")
        elif tag == "a":
            self.links = 1
        if tag in VOID or closed:
            return
        above = self.state()
        if tag not in BLOCKS and tag not in HIDDEN:
            out = bool(attributes.strip()) and self.inline_out(attributes)
            if out or self.counts.get(tag):  # those inside a marked one of the same tag are counted, to find its end
                self.push(_Open(tag, above.chrome, above.region, above.hidden or out, above.form))
            return
        words, hidden = _marks(attributes, not above.region, tag in HEADINGS) if attributes.strip() else (set(), False)
        region = above.region
        chrome = above.chrome
        article = tag in ("article", "main") or bool(words & REGION_WORDS)
        if article:
            if chrome == NAMED:
                chrome = CLEAR if tag == "main" else DOUBTFUL
            if not region or chrome != above.chrome:
                self.regions += 1
                region = self.regions
        if hidden or tag in CHROME_TAGS or tag == "header" and not above.region or ROLE in words:
            chrome = CHROME
        elif tag not in ("html", "body"):
            if words & COMMENT_WORDS:
                chrome = CHROME
            elif words & CHROME_WORDS and not article:
                chrome = max(chrome, NAMED)
        self.push(_Open(tag, chrome, region, above.hidden or tag in HIDDEN, (above.form or tag == "form") and not article))

    def inline_out(self, attributes: str) -> bool:
        words, hidden = _marks(attributes, False, True)
        return hidden or bool(words & CHROME_WORDS)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in BLOCKS:
            self.cut()
        if self.counts.get(tag):
            while self.pop() != tag:
                pass


#: Stands for a role of CHROME_ROLES.
ROLE = "role="


def _marks(attributes: str, id_parts: bool, no_id: bool) -> tuple[set[str], bool]:
    """Words of class, id, role and itemprop; whether the element is hidden. Ids count by parts, whole or not at all."""
    words: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "itemprop"):
            if name == "id" and no_id:
                continue
            for token in value.split():
                words.add(token.lower())
                if name == "id" and not id_parts:
                    continue
                parts = [p for p in _CAMEL.sub("-", token).lower().replace("_", "-").split("-") if p]
                if parts and parts[0] not in LAYOUT_WORDS:
                    words.update((parts[0], parts[-1]), COMMENT_WORDS.intersection(parts))
        elif name == "role" and value.lower() in CHROME_ROLES:
            words.add(ROLE)
        elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return words, hidden


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without labels."""
    reader, at, size = _Reader(), 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            reader.text(page[at:])
            break
        if m.start() > at:
            reader.text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
        elif tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = close.end() if close else size
            if tag not in ("script", "style", "noscript"):
                reader.pieces.append(" ")
        else:
            reader.start(tag, m[3], m[3].endswith("/"))
    reader.cut()
    return reader.blocks


def _stops(block: Block) -> float:
    words = [w for w in _WORD.findall(block.text.lower())]
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def _links(block: Block) -> float:
    return block.linked / max(len(block.text.replace(" ", "")), 1)


def _decided(block: Block, stops: float) -> bool:
    return len(block.text) >= LONG and stops >= STOP_LOW or len(block.text) >= SHORT and stops >= STOP_HIGH


def label(blocks: list[Block]) -> list[Block]:
    """Both passes: every block gets 'good' or 'bad'."""
    if any(b.chrome == DOUBTFUL for b in blocks):
        sure = {b.chrome for b in blocks if b.region and b.chrome <= DOUBTFUL and _links(b) <= LINKS
                and _decided(b, _stops(b))}
        for b in blocks:
            if b.chrome == DOUBTFUL and sure == {DOUBTFUL}:
                b.chrome = CLEAR
    stops = [_stops(b) for b in blocks]
    if any(b.form for b in blocks) and not any(
            not b.form and not b.chrome and _links(b) <= LINKS and _decided(b, v) for b, v in zip(blocks, stops, strict=True)):
        for b in blocks:
            b.form = False
    marked = any(b.region and not b.chrome and not b.form for b in blocks)
    for b, v in zip(blocks, stops, strict=True):
        links = _links(b)
        if b.chrome or b.form or marked and not b.region:
            b.label = "out"
        elif links > LINKS or b.text.startswith("\N{COPYRIGHT SIGN}"):
            b.label = "ambiguous" if b.region else "bad"
        elif _decided(b, v):
            b.label = "good"
        elif not marked and len(b.text) >= LONG and not v and links > 0:
            b.label = "bad"
        else:
            b.label = "ambiguous"
    first = [b.label for b in blocks]
    before, after = _nearest(blocks, first), _nearest(blocks[::-1], first[::-1])[::-1]
    for i, b in enumerate(blocks):
        if first[i] == "ambiguous":
            near = {v for v in (before[i], after[i]) if v}
            bare = not marked and None in (before[i], after[i]) and b.tag not in PARAGRAPHS
            # Neighbours that disagree or are missing leave the block to its region.
            b.label = "bad" if near and not b.region and (near == {"bad"} or bare) else "good"
        elif first[i] == "out":
            b.label = "bad"
    return blocks


def _nearest(blocks: list[Block], labels: list[str]) -> list[str | None]:
    """For each block the last decided label before it, without leaving its region."""
    out, last, region = [], None, None
    for b, known in zip(blocks, labels, strict=True):
        if b.region != region:
            last, region = None, b.region
        out.append(last)
        if known in ("good", "bad"):
            last = known
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in label(blocks_of(page or "")) if b.label == "good")


def extract_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """The rows with ``text`` and ``n_chars`` in place of the html."""
    kept = [c for c in df.columns if c not in (html, "text", "n_chars")]
    kept_columns = df.select(*[F.col(f"`{c}`") for c in kept])
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias("text"))
    schema = kept_columns.schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v) for v in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*kept, "text", "n_chars"])

    return rows.mapInArrow(read, schema)
