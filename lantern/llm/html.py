"""Main text of web pages: site templates by counting subtrees, other boilerplate by name.

A page is read into its blocks of text. Its content is what stands in `article` and `main`; where
these hold less than half of the page's prose (text outside links), it is also the least element
that holds more than half. Two kinds of hashes of subtrees are counted over the distinct pages of each host in
Spark, and what recurs is a template and goes:

- Every element with text, hashed with all that it holds. Outside the content it is a template from
  `min_pages` pages on, in the content from `content_pages` and a share of the host's pages on, so
  that a release which a few pages share stays. Where a subtree recurs all subtrees in it do, so
  each block needs to be looked up with the least one around it only. `article` and `main`, what
  holds them, and the prose in them (paragraphs, headings, list items) are no templates.
- The shape (elements, classes, ids, roles; no words) of the outermost elements beside the
  content: menus and adverts whose words vary. An element that isn't mostly links counts only where
  `article` or `main` is the content, so that a lead beside the body of a page of `div`s stays.
  Shapes that also occur in the content of many pages are none.

What doesn't recur, as on hosts with few pages, goes by name: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments by their element, role, or a class or
id that is made up of such words alone (`ad-slot`, not `social-science`). A form or an element so
classed stays if it holds the page's main text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import arrow, shared

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Names of elements, roles and class or id words: fixed values.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td template tfoot th thead tr ul button label svg object canvas audio video map".split()
)
DROPPED = frozenset(
    "nav footer aside form search menu dialog script style noscript template head select textarea button svg object canvas audio video map iframe".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promotion related respond reply replies share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Words that may stand beside those above in a class or id.
NEUTRAL_WORDS = frozenset(
    "area articles bar block body bottom box button buttons column container fixed form global group header holder inline inner item items js left "
    "large link links list main menu outer page post posts primary right secondary section site slot small top unit wide wp wrap wrapper".split()
)
#: Dropped whatever their place, with or without names: no text of the page.
UNSEEN = frozenset("script style noscript template head select textarea button svg object canvas audio video map iframe dialog".split())
#: Elements whose shape may be a template though they have no class, id or role.
SECTIONS = frozenset("nav header footer aside menu search form".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no templates by themselves where they stand in an article or main.
PROSE = frozenset("p li dt dd td th tr tbody pre blockquote figcaption caption summary".split()) | HEADINGS
REGIONS = ("article", "main")
ARTICLE, MAIN, HEADLINE = 1, 2, 4


@dataclass(frozen=True)
class Templates:
    """When a subtree is a template. Pages are counted with different main texts, shares are of the host's pages."""

    min_pages: int = 3  # outside the content, and for shapes
    share: float = 0.002
    content_pages: int = 10  # in the content
    content_share: float = 0.2
    in_memory: int = 2_000_000  # templates (16 MB) that are sent to the tasks; more are joined
    names: bool = True  # False: only templates go, and what is no text (`UNSEEN`)


@dataclass(slots=True)
class _Element:
    name: str
    hard: bool  # boilerplate by its name
    soft: bool  # the same, unless it holds the main text
    comment: bool
    place: int
    unit: bool  # may be a template by itself, unless it holds a region
    look: str = ""  # name, classes, id and role without digits
    parts: list[bytes] = field(default_factory=list)
    shapes: list[bytes] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)  # no part of a unit so far
    first: int = 0  # blocks of the page before it
    regions: int = 0  # regions of the page before it
    heading: bool = False
    region: bool = False  # is or holds an article or main
    main: bool = False  # is or holds main


@dataclass(slots=True)
class Block:
    text: str
    named: bool  # boilerplate by the name of an element around it
    place: int  # sum of ARTICLE, MAIN and HEADLINE
    unit: int | None = None  # hash of the least subtree around it that may be a template
    content: bool = False
    shape: int | None = None  # of the outermost subtree around it that is beside the content
    linked: bool = False  # most of it is links


@dataclass(frozen=True, slots=True)
class _Span:
    """The blocks of an element that has been closed."""

    first: int
    end: int
    name: str
    shape: int
    shaped: bool  # its shape may be a template


@dataclass(frozen=True, slots=True)
class _Drop:
    """An element that goes by its name."""

    first: int
    end: int
    soft: bool
    regions: int
    main: bool
    comment: bool


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t\r") else {}


def _class_drops(text: str) -> tuple[bool, bool]:
    """Whether one of the class or id names in `text` is made up of dropped words, with neutral ones, and whether it tells of comments."""
    drops = comment = False
    for whole in text.split():
        words = {w.lower() for w in _TOKEN.findall(whole) if not w.isdigit()}
        if words & DROPPED_WORDS and words <= DROPPED_WORDS | NEUTRAL_WORDS:
            drops, comment = True, comment or bool(words & COMMENT_WORDS)
    return drops, comment


def _drops(name: str, attrs: dict[str, str], names: bool) -> tuple[bool, bool, bool]:
    """Whether an element goes by its name; whether it does unless it holds the main text; whether it holds comments."""
    if name in UNSEEN:
        return True, False, False
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    if hidden and name not in ("html", "body"):
        return True, False, False
    if not names:
        return False, False, False
    role = attrs.get("role", "").strip().lower()
    if name in DROPPED or role in DROPPED_ROLES:
        soft = name == "form" or role == "form"
        return not soft, soft, False
    if not attrs or name in ("html", "body", "main"):
        return False, False, False
    return False, *_class_drops(attrs.get("class", "") + " " + attrs.get("id", ""))


def _look(name: str, attrs: dict[str, str]) -> str:
    if not attrs:
        return name
    kinds = sorted(set(attrs.get("class", "").split()))
    return re.sub(r"[0-9]+", "", " ".join([name, *kinds, "#" + attrs.get("id", ""), attrs.get("role", "")]))


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


class _Page:
    """The blocks of one page, built up tag by tag."""

    def __init__(self, host: str, names: bool = True) -> None:
        self.key = hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=32).digest()
        self.names = names
        self.blocks: list[Block] = []
        self.stack: list[_Element] = []
        self.text: list[str] = []
        self.spans: list[_Span] = []
        self.drops: list[_Drop] = []
        self.regions = 0
        self.link: int | None = None  # elements around an open link
        self.linked = 0  # characters of `text` in links

    def add(self, text: str) -> None:
        self.text.append(text)
        if self.link is not None:
            self.linked += len(text)

    def flush(self) -> None:
        raw = "".join(self.text)
        text = " ".join(html.unescape(raw).split()) if raw else ""
        linked, self.linked = 2 * self.linked >= len(raw.strip()), 0
        self.text.clear()
        if not text:
            return
        within = self.stack[-1] if self.stack else None
        self.blocks.append(Block(text, False, within.place if within else 0, linked=linked))
        if within:
            within.parts.append(text.encode("utf-8", "surrogatepass"))
            within.shapes.append(b"l" if linked else b"t")
            within.blocks.append(len(self.blocks) - 1)

    def open(self, name: str, attrs: dict[str, str]) -> None:
        self.flush()
        closing = CLOSES.get(name)
        if closing:
            for place in range(len(self.stack) - 1, -1, -1):
                if self.stack[place].name in closing:
                    while len(self.stack) > place:
                        self.close()
                    break
                if self.stack[place].name in ("ul", "ol", "dl", "table", "select", "article", "main"):
                    break
        while self.stack and self.stack[-1].name in ("p", *HEADINGS) and (self.stack[-1].name == "p" or name in HEADINGS):
            self.close()
        around = self.stack[-1].place if self.stack else 0
        region = ARTICLE if name == "article" else MAIN if name == "main" or attrs.get("role") == "main" else 0
        unit = not region and name not in ("html", "body") and not (around & (ARTICLE | MAIN) and name in PROSE)
        place = around | region | (HEADLINE if name == "h1" else 0)
        element = _Element(name, *_drops(name, attrs, self.names), place, unit, _look(name, attrs), first=len(self.blocks), regions=self.regions)
        element.region, element.main = bool(region), region == MAIN
        self.regions += element.region
        if name in HEADINGS:
            for e in reversed(self.stack):
                if e.heading:
                    break
                e.heading = True
        self.stack.append(element)

    def close(self) -> None:
        """Close the innermost element: its hashes go into its parent's, and to its blocks if it may be a template."""
        self.flush()
        element = self.stack.pop()
        around = self.stack[-1] if self.stack else None
        if self.link is not None and len(self.stack) < self.link:
            self.link = None
        if around:
            around.region |= element.region
            around.main |= element.main
        header = self.names and element.name == "header" and not (element.heading and around and around.place & (ARTICLE | MAIN))
        if element.hard or element.soft or header:
            self.drops.append(_Drop(element.first, len(self.blocks), element.soft and not header, self.regions - element.regions, element.main, element.comment))
        if not element.parts:
            return
        name = element.name.encode("utf-8", "surrogatepass")
        digest = hashlib.blake2b(name + b"\0".join([b"", *element.parts]), digest_size=8, key=self.key).digest()
        # Neighbours of one shape count once, so that a menu may have any number of entries.
        kinds = [b for a, b in zip([b"", *element.shapes], element.shapes) if a != b]
        shape = hashlib.blake2b(element.look.encode("utf-8", "surrogatepass") + b"\0shape" + b"\0".join([b"", *kinds]), digest_size=8, key=self.key).digest()
        shaped = element.unit and (element.look != element.name or element.name in SECTIONS)
        self.spans.append(_Span(element.first, len(self.blocks), element.name, _number(shape), shaped))
        if element.unit and not element.region:
            for place in element.blocks:
                self.blocks[place].unit = _number(digest)
            element.blocks = []
        if around:
            around.parts.append(digest)
            around.shapes.append(shape)
            if not element.region:
                around.blocks = around.blocks + element.blocks if around.blocks else element.blocks

    def end(self, name: str) -> None:
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place].name == name:
                while len(self.stack) > place:
                    self.close()
                return
            if self.stack[place].name in REGIONS and name not in ("body", "html"):
                return  # a stray end tag does not leave the article

    def _covered(self, drops: Iterable[_Drop]) -> np.ndarray:
        """Which blocks stand in one of the elements."""
        steps = np.zeros(len(self.blocks) + 1, np.int64)
        for drop in drops:
            steps[drop.first] += 1
            steps[drop.end] -= 1
        return np.cumsum(steps)[:-1] > 0

    def finish(self) -> list[int]:
        """Settle what goes by name, what is content, and the shapes beside it; returns the shapes in the content."""
        prose = np.array([0 if b.linked else len(b.text) for b in self.blocks], np.int64)
        hard = self._covered(d for d in self.drops if not d.soft)
        before = np.concatenate([[0], np.cumsum(np.where(hard, 0, prose))])
        pieces = np.concatenate([[0], np.cumsum((prose > 0) & ~hard)])

        def holds_main_text(drop: _Drop) -> bool:
            if drop.main or drop.comment:
                return drop.main
            if self.regions:
                return drop.regions == self.regions
            return pieces[drop.end] - pieces[drop.first] >= 3 and 2 * (before[drop.end] - before[drop.first]) > before[-1]

        named = hard | self._covered(d for d in self.drops if d.soft and not holds_main_text(d))
        for block, is_named in zip(self.blocks, named.tolist()):
            block.named = is_named
        region = np.array([b.place & (ARTICLE | MAIN) > 0 for b in self.blocks], bool)
        content = region.copy()
        prose[named] = 0
        before = np.concatenate([[0], np.cumsum(prose)])
        in_region = bool(self.regions) and 2 * int(prose[region].sum()) >= before[-1]
        if not in_region:  # the first element to be closed that holds most is the least one
            root = next((s for s in self.spans if s.name not in PROSE and 2 * (before[s.end] - before[s.first]) > before[-1]), None)
            content[root.first if root else 0 : root.end if root else len(content)] = True
        inside = np.concatenate([[0], np.cumsum(content)])
        links = np.concatenate([[0], np.cumsum([len(b.text) if b.linked else 0 for b in self.blocks])])
        size = np.concatenate([[0], np.cumsum([len(b.text) for b in self.blocks])])
        own: set[int] = set()
        for span in reversed(self.spans):  # from the outermost
            n = inside[span.end] - inside[span.first]
            if not span.shaped:
                continue
            if n == span.end - span.first:
                if in_region or not self.regions:
                    own.add(span.shape)
            elif n == 0 and self.blocks[span.first].shape is None:
                if in_region or 2 * (links[span.end] - links[span.first]) >= size[span.end] - size[span.first]:
                    for block in self.blocks[span.first : span.end]:
                        block.shape = span.shape
        for block, is_content in zip(self.blocks, content.tolist()):
            block.content = is_content
        return sorted(own)


def read_page(source: str, host: str = "", names: bool = True) -> list[Block]:
    """All blocks of a page in order, boilerplate among them."""
    return _read(source, host, names)[0]


def _read(source: str, host: str, names: bool) -> tuple[list[Block], list[int]]:
    """The blocks of a page, and the shapes in its content."""
    page, at = _Page(host, names), 0
    while at < len(source):
        found = _TAG.search(source, at)
        if not found:
            page.add(source[at:])
            break
        page.add(source[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if not name:
            continue
        name = name.lower()
        if found["end"] or found["end2"]:
            if name in BLOCKS:
                page.flush()
                page.end(name)
            elif name == "a":
                page.link = None
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else len(source)
        elif name in VOID:
            if name == "hr":
                page.flush()
            page.text.append(" ")
        elif name in BLOCKS:
            page.open(name, _attributes(found["attrs"] or found["attrs2"] or ""))
        elif name == "a":
            page.link = len(page.stack)
    page.flush()
    while page.stack:
        page.close()
    return page.blocks, page.finish()


def main_text(blocks: Iterable[Block]) -> list[str]:
    """The main blocks among those that are no template, by names.

    What stands in `main` is taken, where there is one; else what stands in articles, and headlines
    before them, if the articles hold two thirds of the characters or more; else all.
    """
    left = [b for b in blocks if not b.named]
    if any(b.place & MAIN for b in left):
        return [b.text for b in left if b.place & MAIN]
    own = sum(len(b.text) for b in left if b.place & ARTICLE)
    if own and 3 * own >= 2 * sum(len(b.text) for b in left):
        return [b.text for b in left if b.place & (ARTICLE | HEADLINE)]
    return [b.text for b in left]


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; '' where there is none."""
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def parsed(pages: DataFrame, names: bool = True) -> DataFrame:
    """(page_id, url, host, page_key, texts, named, places, units, content, shapes, own) of every page.

    texts to shapes have an entry a block; own are the shapes in the content. page_key is a hash of
    the main text by names, so that copies of a page count once.
    """

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            host = host_of(row["url"])
            blocks, own = _read(row["html"] or "", host, names)
            key = hashlib.blake2b("\0".join(main_text(blocks)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            yield {
                "page_id": row["page_id"],
                "url": row["url"],
                "host": host,
                "page_key": _number(key),
                "texts": [b.text for b in blocks],
                "named": [b.named for b in blocks],
                "places": [b.place for b in blocks],
                "units": [b.unit for b in blocks],
                "content": [b.content for b in blocks],
                "shapes": [b.shape for b in blocks],
                "own": own,
            }

    ddl = "url string, host string, page_key long, texts array<string>, named array<boolean>, places array<int>, units array<long>, content array<boolean>, shapes array<long>, own array<long>"
    return arrow.map_rows(pages.select("page_id", "url", "html"), run, arrow.schema(pages.schema["page_id"], ddl), rows=256)


def recurring(rows: DataFrame, templates: Templates) -> DataFrame:
    """(unit, everywhere): the subtrees and shapes that recur on many different pages of their host, which is part of their hash.

    everywhere: they recur on so many that they go from the content as well.
    """
    subtree = F.transform(F.array_distinct(F.array_compact("units")), lambda u: F.struct(u.alias("unit"), F.lit(0).alias("kind")))
    shape = F.transform(F.array_distinct(F.array_compact("shapes")), lambda u: F.struct(u.alias("unit"), F.lit(1).alias("kind")))
    own = F.transform("own", lambda u: F.struct(u.alias("unit"), F.lit(2).alias("kind")))
    seen = rows.select("host", "page_key", F.explode(F.concat(subtree, shape, own)).alias("_u")).select("host", "page_key", "_u.*").distinct()
    counted = seen.groupBy("host", "unit").agg(
        F.count_if(F.col("kind") < 2).alias("_n"), F.count_if(F.col("kind") == 2).alias("_own"), F.max("kind").alias("_kind")
    )
    counted = shared.staged(counted.filter((F.col("_n") >= templates.min_pages) & (4 * F.col("_own") <= F.col("_n"))), "html-counts")
    hosts = rows.select("host", "page_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_pages"))
    counted = shared.join_hot(counted, hosts, "host").filter(F.col("_n") >= templates.share * F.col("_pages"))
    often = (F.col("_n") >= templates.content_pages) & (F.col("_n") >= templates.content_share * F.col("_pages"))
    return counted.select("unit", ((F.col("_kind") == 0) & often).alias("everywhere"))


def _with_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` with `gone` and `everywhere`: those of their units and shapes that are in `gone`, by joins."""
    key = ["page_key", "units", "shapes"]
    every = F.array_distinct(F.array_compact(F.concat("units", "shapes")))
    pieces = rows.select(*key).distinct().withColumn("unit", F.explode(every))
    strong = F.when(F.col("everywhere"), F.col("unit"))
    found = pieces.join(gone, "unit").groupBy(*key).agg(F.collect_set("unit").alias("gone"), F.collect_set(strong).alias("everywhere"))
    return rows.join(found, key, "left")


def _found(values: list, known: np.ndarray) -> np.ndarray:
    """Which of `values` (None: no) are in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    wanted = np.array([v or 0 for v in values], np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return (known[at] == wanted) & np.array([v is not None for v in values], bool)


def extract(pages: DataFrame, templates: Templates = Templates()) -> DataFrame:
    """Main text of every row of `pages` (page_id, url, html; other columns are ignored).

    Returns page_id, url, text, n_chars, host, n_template (blocks that went as a site's subtree,
    whatever their names), n_shape (others that went as a site's shape) and n_named (blocks that
    went by name alone). Blocks are joined by two line ends, white space in them is one space. A
    null or empty page has the text ''. A null url has the host ''. Repeated rows are each returned
    and count once. An empty table gives an empty result.
    """
    rows = shared.staged(parsed(pages, templates.names), "html-blocks")
    gone = shared.staged(recurring(rows, templates), "html-templates")
    few = gone.count() <= templates.in_memory
    sent = None
    if few:
        pairs = np.fromiter(((r.unit, r.everywhere) for r in gone.toLocalIterator()), np.dtype([("unit", np.int64), ("everywhere", bool)]))
        pairs.sort(order="unit")
        sent = pages.sparkSession.sparkContext.broadcast((pairs["unit"].copy(), pairs["unit"][pairs["everywhere"]]))
    told = rows if few else _with_gone(rows, gone)

    def run(rows: Iterator[dict]) -> Iterable[dict]:
        for row in rows:
            known, often = sent.value if few else (np.sort(np.array(row[c] or [], np.int64)) for c in ("gone", "everywhere"))
            content = np.array(row["content"], bool)
            subtree = _found(row["units"], known) & ~content | _found(row["units"], often)
            shape = _found(row["shapes"], known) & ~subtree
            blocks = [Block(*b) for b in zip(row["texts"], row["named"], row["places"])]
            left = [b for b, g in zip(blocks, (subtree | shape).tolist()) if not g]
            text = "\n\n".join(main_text(left))
            yield {
                "page_id": row["page_id"], "url": row["url"], "text": text, "n_chars": len(text), "host": row["host"],
                "n_template": int(subtree.sum()), "n_shape": int(shape.sum()), "n_named": sum(b.named for b in left),
            }

    ddl = "url string, text string, n_chars long, host string, n_template int, n_shape int, n_named int"
    return arrow.map_rows(told, run, arrow.schema(pages.schema["page_id"], ddl), rows=256)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"))
