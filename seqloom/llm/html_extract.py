"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read as a stream of tags and text. Block tags end a block; each block knows its words, the share of
them inside links, and what of its surroundings the markup names. The tree sees these numbers of the block and the words and
links of its two neighbours. It is grown on the driver from the labelled page fragments of html_labels, whose features
are measured by the same code. A page takes time in proportion to its length, whatever its tags.

Defined results: a null or empty page has no text. Scripts, styles, templates, drawings, comments and the head are
no text. Character references are decoded; white space inside a block becomes one space; kept blocks are joined by a line
feed. Broken markup is read as browsers read it where that is simple: an unclosed tag ends with its parent, an
end tag without its start is left out, a "<" before anything but a letter, "/", "!" or "?" is text, an unclosed
comment or script lasts to the end of the page; a quote that never ends is part of a name, so that no text is lost.
Repeated rows get equal texts, an empty table an empty result. Pages of any length are read whole. Input columns
named like a result column are replaced.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqloom.llm.common import map_text
from seqloom.llm.html_labels import FRAGMENTS, MAIN, expand

#: Quotes count only where a value begins, so one inside an unquoted value opens nothing. Every run is taken whole, so nothing is read twice.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+|=)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
#: Fixed values of the language: elements whose content is read to their end tag, elements whose text is not shown, without content, and blocks.
RAW = frozenset("script style iframe noembed noframes textarea title xmp".split())
UNSHOWN = frozenset("svg template canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag that ends an open paragraph.
ENDS_P = BLOCK - frozenset("body caption colgroup dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
#: An opening tag that ends an open element of its own kind, up to these.
SIBLINGS = dict.fromkeys(("li",), ("ul", "ol", "menu", "dir")) | dict.fromkeys(("dd", "dt"), ("dl",)) | dict.fromkeys(("tr", "td", "th"), ("table",))
P_WALLS = ("article", "main", "section", "div", "td", "th", "table", "button", "body", "li", "blockquote")
#: Elements and names of a page's frame. Strong ones hold no main text unless the main element is in them; weak ones often don't.
STRONG, WEAK, BODY = 3, 2, 1
STRONG_TAGS = frozenset("nav aside menu dialog button".split())
STRONG_NAMES = frozenset(
    "nav navbar navigation navi menu menubar submenu sidebar sidenav ad ads advert adverts advertisement advertisements advertising adsense adslot "
    "banner sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices notification comment comments disqus reply "
    "replies respond footer foot masthead breadcrumb breadcrumbs pagination pager newsletter popup modal overlay skip hidden".split()
)
WEAK_NAMES = frozenset(
    "header head legal copyright tag tags share sharing social related recommended recommendations search widget widgets login signup subscribe "
    "subscription toolbar alert byline meta author".split()
)
BODY_NAMES = frozenset("article post entry content story main body".split())
ROLES = {
    **dict.fromkeys("navigation banner contentinfo complementary dialog alertdialog menu menubar".split(), STRONG),
    **dict.fromkeys("search form alert".split(), WEAK), **dict.fromkeys("main article".split(), BODY),
}
#: A name part that takes back what the others say.
NOT = frozenset("no non not without free less has with".split())
PARTS = re.compile(r"[a-z]+|[^a-z\s_-]+")
SIDES = frozenset(("left", "right"))
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "strong", "weak", "body", "heading")
FIELDS = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]


@dataclass(slots=True)
class Block:
    text: str
    words: int
    links: float
    heading: int
    region: int
    strong: int = 0
    weak: int = 0
    body: int = 0


@lru_cache(4096)
def _named(value: str) -> int:
    """What the names of a class or id say. A whole body name outdoes compound names beside it, a whole strong name everything."""
    names, found = value.lower().split(), 0
    if not STRONG_NAMES.isdisjoint(names):
        return STRONG
    if not BODY_NAMES.isdisjoint(names):
        return BODY
    for name in names:
        parts = set(PARTS.findall(name))
        if parts & NOT:
            continue
        strong = parts & STRONG_NAMES or "side" in parts and (parts & SIDES or "bar" in parts)
        found = max(found, STRONG if strong else WEAK if parts & WEAK_NAMES else BODY if parts & BODY_NAMES else 0)
    return found


def _region(name: str, attributes: str) -> tuple[int, bool]:
    """The kind of region that an element begins, and whether only its class or id says so."""
    if name in STRONG_TAGS:
        return STRONG, False
    if name in ("html", "body"):  # their names tell of the whole page
        return 0, False
    said = 0
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                said = max(said, _named(value))
            elif key == "role":
                said = max(said, ROLES.get(value.strip().lower(), 0))
            elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and HIDDEN.search(value):
                return STRONG, False
            elif key == "itemprop" and value == "articleBody":
                said = max(said, BODY)
    if name in ("article", "main"):
        return (STRONG, True) if said == STRONG else (BODY, False)
    return said, True


class _Reader:
    """Builds blocks from tags and text. Places of open elements are kept by name, so no tag searches the stack."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.names: list[str] = []
        #: For each open element, the region it began (or -1), whether it hides its text, and whether it is a heading.
        self.began: list[int] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.parts: list[str] = []
        self.linked = 0
        self.link_at = -1
        self.hidden = self.heading = 0
        #: Regions: parent, kind, whether something inside took it back.
        self.parents, self.kinds, self.void = [-1], [0], [False]
        self.now = 0
        self.doubtful: list[int] = []

    def put(self, text: str) -> None:
        if self.hidden:
            return
        text = html.unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.link_at >= 0:
            self.linked += len(text.split())

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                words = text.count(" ") + 1
                self.blocks.append(Block(text, words, min(1.0, self.linked / words), int(self.heading > 0), self.now))
            self.parts, self.linked = [], 0

    def _last(self, name: str) -> int:
        found = self.places.get(name)
        return found[-1] if found else -1

    def _push(self, name: str, attributes: str) -> None:
        at = len(self.names)
        self.names.append(name)
        self.places.setdefault(name, []).append(at)
        if name in BLOCK:
            self.block_places.append(at)
        self.hidden += name in UNSHOWN
        self.heading += name in HEADINGS
        kind, doubtful = _region(name, attributes)
        if name in ("header", "footer", "form") and kind != STRONG:
            # Inside an article a header holds its title; a form may wrap a whole page.
            kind, doubtful = (WEAK if name != "footer" and (name == "form" or self._inside(BODY)) else STRONG), name == "form"
        if name == "main" or name == "article" and kind == BODY:
            self._take_back(name == "main")
        if kind:
            self.began.append(len(self.kinds))
            self.parents.append(self.now)
            self.kinds.append(kind)
            self.void.append(False)
            self.now = len(self.kinds) - 1
            if doubtful and kind != BODY:
                self.doubtful.append(self.now)
        else:
            self.began.append(-1)

    def _inside(self, kind: int) -> bool:
        """Whether the innermost region is of the kind."""
        return self.kinds[self.now] == kind

    def _take_back(self, whole: bool) -> None:
        """The main element voids what classes around it say; an article voids only what is weak."""
        left = []
        for i in self.doubtful:
            if whole or self.kinds[i] == WEAK:
                self.void[i] = True
            else:
                left.append(i)
        self.doubtful = left

    def _pop(self, at: int) -> None:
        while len(self.names) > at:
            name, began = self.names.pop(), self.began.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.block_places.pop()
            self.hidden -= name in UNSHOWN
            self.heading -= name in HEADINGS
            if began >= 0:
                self.now = self.parents[began]
                if self.doubtful and self.doubtful[-1] == began:
                    self.doubtful.pop()
        if self.link_at > len(self.names):
            self.link_at = -1

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            if self.hidden and self._last("svg") >= 0 and self._last("svg") > self._last("foreignobject"):
                self._pop(self._last("svg"))  # a drawing holds no blocks of the page: it was never closed
            self.end_block()
            if name in ENDS_P:
                self._close_until("p", P_WALLS)
            elif name in SIBLINGS:
                self._close_until(name, SIBLINGS[name])
        elif name == "br":
            self.put(" ")
        if name == "a":
            self.link_at = len(self.names) if "href" in attributes.lower() else -1
            return
        if name not in VOID and not (attributes.endswith("/") and self.places.get("svg")) and not (name == "svg" and attributes.endswith("/")):
            self._push(name, attributes)

    def _close_until(self, name: str, walls: tuple[str, ...]) -> None:
        at = self._last(name)
        if at >= 0 and all(self._last(w) < at for w in walls):
            self._pop(at)

    def close(self, name: str) -> None:
        if name == "a":
            self.link_at = -1
            return
        if name in BLOCK:
            self.end_block()
        at = self._last(name)
        if at >= 0 and (name in BLOCK or name in UNSHOWN or not self.block_places or self.block_places[-1] < at):
            self._pop(at)

    def finish(self) -> list[Block]:
        """The blocks, with what their regions say in the end."""
        self.end_block()
        state = [(0, 0, 0)]
        for parent, kind, void in zip(self.parents[1:], self.kinds[1:], self.void[1:], strict=True):
            strong, weak, body = state[parent]
            if not void:
                strong, weak, body = (1, weak, body) if kind == STRONG else (strong, 1, body) if kind == WEAK else (strong, 0, 1)
            state.append((strong, weak, body))
        for b in self.blocks:
            b.strong, b.weak, b.body = state[b.region]
        return self.blocks


RAW_ENDS = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for n in RAW}


def blocks_of(page: str | None) -> list[Block]:
    """The page's text blocks in order."""
    page = page or ""
    reader, at, head, search = _Reader(), 0, False, TOKEN.search
    while m := search(page, at):
        if m.start() > at:
            text = page[at : m.start()]
            head = head and not text.strip()
            if not head:
                reader.put(text)
        at, name = m.end(), m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            head = head and name != "head"
            reader.close(name)
            continue
        if name == "plaintext":
            reader.end_block()
            break
        head = name == "head" or head and name in IN_HEAD
        if name in RAW:
            end = RAW_ENDS[name].search(page, at)
            at = end.end() if end else len(page)
        else:
            reader.open(name, m[3])
    if not head:
        reader.put(page[at:])
    return reader.finish()


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """One row of FEATURES per block; missing neighbours have no words and no links."""
    end = Block("", 0, 0.0, 0, 0)
    wide = [end, *blocks, end]
    return [
        (b.words, b.links, a.words, a.links, c.words, c.links, b.strong, b.weak, b.body, b.heading)
        for a, b, c in zip(wide, wide[1:], wide[2:], strict=False)
    ]


def labelled_rows(fragments: tuple[str, ...] = FRAGMENTS) -> list[tuple[float, ...]]:
    """FEATURES and label of every block of the fragments."""
    out = []
    for f in fragments:
        blocks = blocks_of(expand(f))
        out += [(*row, float(b.text.startswith(MAIN))) for b, row in zip(blocks, features(blocks), strict=True)]
    return out


def grow(rows: list[tuple[float, ...]], depth: int = 12) -> tuple:
    """A tree by Gini impurity: (feature, limit, at most, over) or a share of main text. Ties take the first feature."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0, 1):
        return (share,)

    def impurity(part: list) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for k in range(len(FEATURES)):
        values = sorted({r[k] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            limit = (a + b) / 2
            low, high = [r for r in rows if r[k] <= limit], [r for r in rows if r[k] > limit]
            cost = impurity(low) + impurity(high)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, k, limit, low, high)
    if best is None:
        return (share,)
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


@lru_cache(1)
def default_tree() -> tuple:
    return grow(labelled_rows())


def features_used(tree: tuple) -> set[str]:
    return set() if len(tree) == 1 else {FEATURES[tree[0]]} | features_used(tree[2]) | features_used(tree[3])


def classify(tree: tuple, row: tuple[float, ...]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(page: str | None, tree: tuple) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if classify(tree, row))


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """Add text and n_chars."""
    tree = default_tree()

    def factory():
        def one(t: str | None) -> tuple:
            text = main_text(t, tree)
            return text, len(text)

        return one

    base = pages.drop("text", "n_chars") if page not in ("text", "n_chars") else pages
    return map_text(base, factory, FIELDS, page)


def block_table(pages: DataFrame, page: str = "html") -> DataFrame:
    """Add blocks: text, FEATURES and the tree's decision of every block of a page."""
    tree = default_tree()
    numbers = [T.StructField(n, T.DoubleType()) for n in FEATURES]
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *numbers, T.StructField("kept", T.BooleanType())]))

    def factory():
        def one(t: str | None) -> tuple:
            blocks = blocks_of(t)
            rows = features(blocks)
            found = [{"text": b.text, "kept": classify(tree, r), **dict(zip(FEATURES, map(float, r), strict=True))} for b, r in zip(blocks, rows, strict=True)]
            return (found,)

        return one

    return map_text(pages.drop("blocks") if page != "blocks" else pages, factory, [T.StructField("blocks", kind)], page)
