"""HTML extraction by the maximum-scoring contiguous run of blocks of words and tags.

A page becomes blocks of words and the tags between them. A word's score is the sum of the weights of
what it stands in: a word as such counts for, its block by element and link share, the elements around
it by name and class words, and whether the page's own mark of its content holds it. Tags count
against. One linear scan finds the run with the largest sum; its blocks of positive score, joined, are
the text.

Weights are log odds of a feature lying inside the content of labelled pages, drawn to a default where
the pages show little. Labels are the pages' own: where a page marks one content region (``article``,
else ``main``, else ``itemprop=articleBody``) that region is the label, and all else, menus and notices
too, counts as outside.

Elements end where HTML ends them: a list item at the next, a paragraph at the next block, everything
at the end of what holds it. An element that holds most of the page is no furniture, whatever its name.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Element names of HTML, and which open elements a new one ends, up to which.
RAW = "script style noscript template textarea svg math iframe object select canvas audio video title".split()
TO_THE_END = "script style textarea title".split()
SECTIONS = "nav footer aside menu dialog button".split()
CONTROLS = "form fieldset".split()
FRAMES = {*SECTIONS, *CONTROLS, "header"}
BLOCK = (
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = "a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
IN_TABLE = "table caption td th".split()
TABLE_PARTS = {"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
KNOWN = {*RAW, *BLOCK, *VOID, *INLINE}
PROSE = {"p", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
# Words of a class, id or role that mostly name page furniture, and such as name either.
FURNITURE = re.compile(
    r"ads?|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|respond|sidebar|widgets?|related|recommend\w*|share|sharing|social|"
    r"cookies?|consent|gdpr|notice|notification|popup|modal|newsletter|subscri\w*|signup|login|menu|navbar|nav|navigation|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|"
    r"copyright|disclaimer|complementary|contentinfo|alert|alertdialog"
)
EITHER = re.compile(r"side|overlay|toc|skip|legal|search")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S
)
ATTR = re.compile(r"(?P<name>[^\s=/\"'>]+)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?")
ATTRIBUTES = "class id role itemprop hidden aria-hidden style".split()
NAME_WORD = re.compile(r"[^\s_-]+")

#: Default weights: of a word, of a tag, of words inside and outside of the marked region.
WORD, TAG, INSIDE, OUTSIDE = 1.0, -0.3, 2.0, -4.0
#: Bounds of a learned word and tag: lists and links stand in articles too.
WORD_LEAST = 0.75
TAG_LEAST, TAG_MOST = -0.5, -0.1
#: Of a block by its element; a block that is one link, or nothing but links, by LINKED unless it is prose.
PROSE_BLOCK, PLAIN_BLOCK, LINKED = 2.0, 0.0, -4.0
#: Of furniture by name, of names that may be either; all the elements around a word count between FURNISHED and 2.
FURNISHED, PERHAPS, AROUND = -8.0, -2.0, 2.0
#: What a block of furniture costs the run that passes over it, at most, and what any tag or cut-out costs in a marked region.
SKIPPED, LIGHT = 0.5, 0.001
#: Words of evidence that weigh as much as a default.
SMOOTH = 20.0
#: Class words are counted by hash, so the weights are bounded.
NAMES = 1 << 14
#: An element with this share of the page's words is no furniture, for names that may be either, and for the others.
MOST, NEARLY_ALL = 0.5, 0.9


@dataclass
class Element:
    """An element with names of its own: features, and the words it holds."""

    parent: int
    features: tuple[str, ...]
    prior: float
    kind: str = ""  # "", "either" or "furniture"
    words: int = 0
    inside: int = 0


@dataclass
class Block:
    """Words between two block edges, or (``tag``) one tag."""

    tag: str
    parts: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    links: set[int] = field(default_factory=set)
    around: int = 0
    feature: str = ""
    regions: dict[str, int] = field(default_factory=dict)
    #: Whether the block goes on in the next item, where other elements are around.
    joined: bool = False


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(text) if text and not text.isspace() else ():
        if m["name"].lower() in ATTRIBUTES:
            out.setdefault(m["name"].lower(), m["a"] or m["b"] or m["c"] or "")
    return out


def _named(name: str, attrs: dict[str, str]) -> tuple[list[str], float, str]:
    """(features, default weight, kind) of an element by its name and attributes."""
    found, prior, kind = [], 0.0, ""
    if not attrs and name not in FRAMES:
        return found, prior, kind
    if name in SECTIONS or name in CONTROLS or name == "header":
        found, prior, kind = [f"in {name}"], FURNISHED, "either" if name in CONTROLS else "furniture"
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        found, prior, kind = [*found, "hidden"], FURNISHED, "furniture"
    words = {w.lower() for k in ("class", "id", "role") for w in NAME_WORD.findall(attrs.get(k, ""))}
    for w in sorted(words):
        found.append(f"name {zlib.crc32(w.encode('utf-8', 'surrogatepass')) % NAMES}")
        if FURNITURE.fullmatch(w) and name not in ("html", "body", "main"):
            prior, kind = FURNISHED, "furniture"
        elif EITHER.fullmatch(w):
            prior, kind = prior + PERHAPS, kind or "either"
    return found, max(prior, FURNISHED), kind


class Page:
    """Blocks and tags of a page in order, the named elements around them, and the regions it marks."""

    def __init__(self, page: str):
        self.items: list[Block] = []
        self.elements = [Element(-1, (), 0.0)]
        self.regions: list[tuple[str, int]] = [("", 0)]  # (mark, words); number 0 is no region
        self._read(page)
        for e in reversed(self.elements[1:]):
            self.elements[e.parent].words += e.words
        self.words = self.elements[0].words
        self.content = self._content()
        self._hold_content()

    def _read(self, page: str) -> None:
        stack: list[str] = []  # the open block elements, and beside them:
        at_of: dict[str, list[int]] = {}
        inline: list[list[tuple[str, int]]] = [[]]
        counts: list[Counter] = [Counter()]
        self._regions_at: list[dict[str, int]] = [{}]
        around, link, link_depth, head = [0], 0, -1, False
        unclosed: set[str] = set()
        block = Block("")

        def edge() -> None:
            nonlocal block
            if block.words:
                self._close(block)
            if block.parts:
                block = Block("")

        def pop_to(i: int) -> None:
            nonlocal link
            while len(stack) > i:
                name = stack.pop()
                at_of[name].pop()
                inline.pop(), counts.pop(), around.pop(), self._regions_at.pop()
            if link_depth > len(stack):
                link = 0

        def last(names: tuple[str, ...] | list[str]) -> int:
            return max([at_of[n][-1] for n in names if at_of.get(n)], default=-1)

        at, end, n_links = 0, len(page), 0
        while at < end:
            m = TOKEN.match(page, at)
            if m["text"] == "<" and page[at + 1 : at + 2].strip("/").isalpha():  # a tag with an open quote ends at the next bracket
                cut = page.find(">", at)
                at = end if cut < 0 else cut + 1
                continue
            at = m.end()
            if m["text"] is not None:
                if not head:
                    self._text(block, m["text"], stack, inline, around, link)
                continue
            if m["name"] is None:
                continue
            name, edges = m["name"].lower(), m["name"].lower() in BLOCK
            if edges:
                edge()
            if m["close"]:
                if name == "head":
                    head = False
                elif name == "a":
                    link = 0
                elif edges:
                    if at_of.get(name):
                        i = at_of[name][-1]
                        stop = ENDS[name][1] if name in ENDS else ()
                        if i > last(stop) and (name in TABLE_PARTS or i > last(IN_TABLE)):
                            pop_to(i)
                elif counts[-1][name]:
                    while True:
                        gone = inline[-1].pop()[0]
                        counts[-1][gone] -= 1
                        if gone == name:
                            break
                self.items.append(Block("/" + (name if name in KNOWN else "other"), around=around[-1], regions=self._regions_at[-1]))
                continue
            if name in RAW:
                if name not in unclosed and not (name not in TO_THE_END and m["attrs"].rstrip().endswith("/")):
                    ends = _after(page, at, name)
                    if ends < 0:
                        unclosed.add(name)
                    else:
                        at = ends
                continue
            if name == "head":
                head = True
                continue
            head = head and name in VOID
            if name == "a":
                n_links += 1
                link, link_depth = n_links, len(stack)
            if edges and name != "br":
                if stack and stack[-1] == "p":
                    pop_to(len(stack) - 1)
                if name in ENDS:
                    ended, stop = ENDS[name]
                    i = last(ended)
                    if i > last(stop):
                        pop_to(i)
            if name not in VOID and name != "a" and not (m["attrs"].rstrip().endswith("/") and name not in KNOWN):
                self._open(name, _attributes(m["attrs"]), edges, stack, at_of, inline, counts, around)
            self.items.append(Block(name if name in KNOWN else "other", around=around[-1], regions=self._regions_at[-1]))
        edge()

    def _open(self, name, attrs, edges, stack, at_of, inline, counts, around) -> None:
        here = inline[-1][-1][1] if inline[-1] else around[-1]
        marks = self._regions_at[-1]
        features, prior, kind = _named("div" if name == "header" and "article" in marks else name, attrs)
        mark = name if name in ("article", "main") else "body" if "articlebody" in attrs.get("itemprop", "").lower() else ""
        if name == "article" and "article" in marks:  # an article inside an article is a reader's comment
            features, prior, kind = [*features, "reply"], FURNISHED, kind or "either"
        if features:
            self.elements.append(Element(here, tuple(features), prior, kind))
            here = len(self.elements) - 1
        if not edges:
            inline[-1].append((name, here))
            counts[-1][name] += 1
            if mark != "body":
                return
        else:
            at_of.setdefault(name, []).append(len(stack))
            stack.append(name)
            inline.append([]), counts.append(Counter()), around.append(here)
            self._regions_at.append(marks)
        if mark and mark not in marks and edges:
            self.regions.append((mark, 0))
            self._regions_at[-1] = {**marks, mark: len(self.regions) - 1}

    def _text(self, block, text, stack, inline, around, link) -> None:
        if "&" in text:
            text = html.unescape(text)
        n = len(text.split())
        block.parts.append(text)
        if not n:
            return
        here = inline[-1][-1][1] if inline[-1] else around[-1]
        if not block.words:
            block.around, block.tag, block.feature = here, "", stack[-1] if stack else "body"
            block.regions = self._regions_at[-1]
        elif here != block.around:  # words of another element within the block are scored on their own
            own = Block("", block.parts[:-1], block.words, block.linked, block.links, block.around)
            own.feature, own.regions, own.joined = block.feature, block.regions, True
            self._close(own)
            block.parts, block.words, block.linked, block.links, block.around = [text], 0, 0, set(), here
        block.words += n
        if link:
            block.linked += n
            block.links.add(link)

    def _close(self, block: Block) -> None:
        kind = "" if block.linked < 0.9 * block.words else " link" if len(block.links) == 1 else " links"
        block.feature += kind
        self.elements[block.around].words += block.words
        for r in block.regions.values():
            mark, n = self.regions[r]
            self.regions[r] = (mark, n + block.words)
        self.items.append(block)

    def _content(self) -> set[int]:
        """The regions taken as marked: articles, unless most words of a main element lie outside of them."""
        words = Counter()
        for mark, n in self.regions[1:]:
            words[mark] += n
        mark = "article" if words["article"] and 2 * words["article"] >= words["main"] else "main" if words["main"] else "body"
        return {i for i, (m, n) in enumerate(self.regions) if m == mark and n}

    def inside(self, block: Block) -> bool:
        return any(r in self.content for r in block.regions.values())

    def _hold_content(self) -> None:
        for b in self.items:
            if b.words and self.inside(b):
                self.elements[b.around].inside += b.words
        for e in reversed(self.elements[1:]):
            self.elements[e.parent].inside += e.inside

    def is_most(self, e: Element) -> bool:
        """Whether the element holds so much of the page that its names say nothing."""
        root = self.elements[0]
        if root.inside:
            return 2 * e.inside > root.inside and (e.inside == root.inside or e.kind != "furniture")
        return e.words > (NEARLY_ALL if e.kind == "furniture" else MOST) * root.words


def _after(page: str, at: int, name: str) -> int:
    """Where the raw element ends that was opened before ``at``; -1 if it is only a tag without an end."""
    if name in TO_THE_END:
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
        return m.end() if m else len(page)
    depth, first = 1, -1
    for m in re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<close>/?){name}(?=[\s/>])[^>]*>", re.I | re.S).finditer(page, at):
        if m["close"] is None:
            continue
        depth += -1 if m["close"] else 0 if m[0].endswith("/>") else 1
        if m["close"] and first < 0:
            first = m.end()
        if depth == 0:
            return m.end()
    return first


def default_weight(feature: str) -> float:
    """Weight of a word, block or tag without labelled pages."""
    if feature == "word":
        return WORD
    if feature.startswith(("tag ", "name ")):
        return TAG if feature.startswith("tag ") else 0.0
    name, _, links = feature.removeprefix("block ").partition(" ")
    if links:
        return 0.0 if name in PROSE and links == "link" else LINKED
    return PROSE_BLOCK if name in PROSE else PLAIN_BLOCK


def label_counts(page: str) -> Counter:
    """(feature, inside) counts of one page, empty unless it marks exactly one content region."""
    read = Page(page)
    out: Counter = Counter()
    if len(read.content) != 1:
        return out
    started, left = False, read.elements[0].inside
    for b in read.items:
        if b.words:
            inside = read.inside(b)
            out["word", inside] += b.words
            out["block " + b.feature, inside] += b.words
            started, left = started or inside, left - b.words * inside
        else:
            out["tag " + b.tag, started and left > 0] += 1
    for e in read.elements[1:]:
        for f in e.features:
            out[f, True] += e.inside
            out[f, False] += e.words - e.inside
    return +out


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds per feature against those of words at large; what is seldom seen stays near its default.

    Words stay positive and tags negative, blocks and names within the range of the defaults.
    """
    if not counts:
        return {}
    n_in, n_out = counts.get(("word", True), 0) + SMOOTH, counts.get(("word", False), 0) + SMOOTH
    tags = [sum(n for (f, i), n in counts.items() if f.startswith("tag ") and i is side) + SMOOTH for side in (True, False)]
    found = {"word": max(WORD_LEAST, min(WORD, math.log(n_in / n_out)))}
    for f in {f for f, _ in counts} - {"word"}:
        start = default_weight(f) if f.startswith(("block ", "tag ", "name ")) else FURNISHED
        base = tags[0] / tags[1] if f.startswith("tag ") else n_in / n_out
        a, b = counts.get((f, True), 0), counts.get((f, False), 0) * base
        odds = math.log((a + SMOOTH * math.exp(start / 2)) / (b + SMOOTH * math.exp(-start / 2)))
        if f.startswith("tag "):
            found[f] = min(max(odds, TAG_LEAST), TAG_MOST)
        elif f.startswith("block "):
            # a kind of block that labelled pages have on one side only is not known on the other
            found[f] = min(max(odds, LINKED if "link" in f else PLAIN_BLOCK), PROSE_BLOCK)
        else:
            found[f] = min(max(odds, FURNISHED), AROUND if f.startswith("name ") else start / 2)
    return found


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the first contiguous run with the largest positive sum; (0, 0) if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def scored(read: Page, weights: dict[str, float]) -> list[float]:
    """The score of every block (all its words) and tag of the page."""
    around = [0.0]
    for e in read.elements[1:]:
        own = 0.0
        if not read.is_most(e):
            named = [weights[f] for f in e.features if f in weights]
            low, high = min(named, default=0.0), max(named, default=0.0)
            own = min(low, e.prior) if min(low, e.prior) < 0 else high
        around.append(max(FURNISHED, min(AROUND, around[e.parent] + own)))
    seen: dict[str, float] = {}

    def weight(feature: str) -> float:
        if feature not in seen:
            seen[feature] = weights.get(feature, default_weight(feature))
        return seen[feature]

    out = []
    for b in read.items:
        inside = read.inside(b)
        furnished = around[b.around] <= FURNISHED / 2 and (inside or not read.content)
        if b.words:
            mark = 0.0 if not read.content else INSIDE if inside else OUTSIDE
            score = b.words * (weight("word") + weight("block " + b.feature) + around[b.around] + mark)
            out.append(max(score, -LIGHT if inside else -SKIPPED) if furnished or inside else score)
        else:
            out.append(max(weight("tag " + b.tag), -LIGHT) if furnished or inside else weight("tag " + b.tag))
    return out


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Text of the best region: character references decoded, white space squeezed, blocks joined by one blank.

    Null, empty and markup-only pages give the empty text.
    """
    if not page:
        return ""
    read = Page(page)
    scores = scored(read, weights)
    lo, hi = best_run(scores)
    texts, parts = [], []
    for b, s in zip(read.items[lo:hi], scores[lo:hi]):
        if b.words:
            parts += b.parts if s > 0 else ()
            if not b.joined:
                texts.append("".join(parts))
                parts = []
    texts.append("".join(parts))
    return " ".join(filter(None, (" ".join(t.split()) for t in texts)))


def learn(pages: DataFrame, text: str = "html") -> dict[str, float]:
    """Weights from all pages that mark their content; only one row per feature reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                if page:
                    total.update(label_counts(page))
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([f for (f, _), _ in rows], pa.string()), pa.array([i for (_, i), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], ["f", "i", "n"])

    counted = pages.select(F.col(text).alias("t")).mapInArrow(run, "f string, i boolean, n long").groupBy("f", "i").agg(F.sum("n").alias("n"))
    return weights_of({(r["f"], r["i"]): r["n"] for r in counted.collect()})  # bounded by the element names and NAMES


def extract(pages: DataFrame, weights: dict[str, float], page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``page``, plus its main text as ``out`` (replacing a column of that name) and ``n_chars``.

    A row each, also for null, empty, repeated and very long pages; an empty table stays empty.
    """
    @F.pandas_udf("string")
    def region(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda x: main_text(x if isinstance(x, str) else None, weights)).astype(object)

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (page, out, "n_chars")]
    done = pages.select(*kept, region(F.col(page)).alias(out))
    return done.withColumn("n_chars", F.length(out).cast("bigint"))


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"), learn(pages))
