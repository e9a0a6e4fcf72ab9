"""Main-text extraction from HTML by tree scoring.

A page becomes a tree of elements. A paragraph (p, pre, td, blockquote, or a block with text of its own and no block inside)
of enough characters is worth 1 point, 1 for each comma and 1 for each 100 characters up to 3. It passes all points to its
parent, half to its grandparent and a third of 1/level to those above. An element's score is discounted by its link density, the share
of its characters that lie in links; the best container is kept, with siblings that score near it or read like text.

Defined results: null html has null text, title, container and score; html without a scored paragraph has empty text,
null container and score 0; broken markup (unclosed or crossed tags, stray brackets, unended comments) is read as far as it goes; equal
scores go to the element that begins first; rows with null id and repeated rows give one row each; columns other than id and html are ignored
whatever their names. Ids must be whole numbers; other text raises an error. Reading takes time in proportion to the page, whatever its markup;
points take a step for each element with paragraphs and each of its ancestors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, text

MIN_PARAGRAPH, SIBLING_SHARE, SIBLING_LEAST, SIBLING_CHARS, SIBLING_LINKS = 25, 0.2, 10.0, 80, 0.25

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_EVENT = re.compile(r"""[>"']""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template textarea iframe object svg math select button".split())
_RAW = frozenset("script style textarea template noscript iframe title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_PARAGRAPH = frozenset("p pre td blockquote".split())
#: Which open elements an opening tag ends, and how far up they are looked for.
_ENDS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in _ENDS.items()}
_SPACE = re.compile(r"\s+")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}


@dataclass
class Tree:
    """Elements in document order; text lies in pieces of (element, characters)."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    pieces: list[tuple[int, str]] = field(default_factory=list)
    title: str | None = None


class _Ends:
    """Where tags end: at the first > outside quotes. Every place is searched once, however many tags ask, so a page of open quotes takes linear time."""

    def __init__(self, html: str):
        self.html = html
        self.asked, self.event = 0, -1
        self.closes: dict[int, int] = {}

    def _next(self, at: int) -> int:
        """The first > or quote from at on, or -1; at never falls below an earlier one outside a walk."""
        if not self.asked <= at <= self.event:
            found = _EVENT.search(self.html, at)
            self.asked, self.event = at, found.start() if found else len(self.html)
        return self.event if self.event < len(self.html) else -1

    def of(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at at, or -1."""
        walked = []
        spot = self._next(at)
        first = self.asked, self.event
        while spot >= 0 and self.html[spot] != ">":
            if spot in self.closes:
                spot = self.closes[spot]
                break
            walked.append(spot)
            quote = self.html.find(self.html[spot], spot + 1)
            if quote < 0:
                spot = -1
                break
            event = _EVENT.search(self.html, quote + 1)
            spot = event.start() if event else -1
        self.closes.update(dict.fromkeys(walked, spot))
        self.asked, self.event = first
        return spot


class _Stack:
    """Open elements, with the places of each tag among them."""

    def __init__(self, tags: list[str]):
        self.tags, self.open, self.places, self.blocks = tags, [0], {}, []

    def push(self, element: int) -> None:
        tag = self.tags[element]
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(element)

    def last(self, tags) -> int:
        """The place of the innermost open element with one of these tags, 0 where there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.tags[self.open.pop()]
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()


def parse(html: str) -> Tree:
    tree = Tree()
    tags, parents, pieces = tree.tags, tree.parents, tree.pieces
    stack, ends = _Stack(tags), _Ends(html)
    begin = at = 0
    unended = False
    while True:
        token = _OPEN.search(html, at)
        if token and token[2] is None:
            if token[0] == "<!--":
                end = html.find("-->", token.end())
                end = end + 3 if end >= 0 else len(html)
            else:
                end = -1 if unended else html.find(">", token.end()) + 1 or -1
                unended = end < 0
        elif token:
            end = ends.of(token.end()) + 1 or -1
        if token and end < 0:  # a bracket that nothing closes is text
            at = token.start() + 1
            continue
        chars = html[begin : token.start()] if token else html[begin:]
        if chars and not chars.isspace():
            pieces.append((stack.open[-1], unescape(chars)))
        elif chars:
            pieces.append((stack.open[-1], " "))
        if not token:
            return tree
        begin = at = end
        if token[2] is None:
            continue
        tag, alone = token[2].lower(), html[end - 2] == "/" and end - 2 >= token.end()
        if token[1]:
            place = stack.last((tag,))
            if place:
                stack.cut(place)
            continue
        if tag in _BLOCK and stack.blocks and tags[stack.open[stack.blocks[-1]]] == "p":
            stack.cut(stack.blocks[-1])
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            while (place := stack.last(ended)) > stack.last(within):
                stack.cut(place)
                if tag != "tr":
                    break
        if tag in _RAW and not alone:
            close = _CLOSE[tag].search(html, at)
            if tag == "title" and tree.title is None:
                tree.title = _SPACE.sub(" ", unescape(html[at : close.start() if close else len(html)])).strip()
            begin = at = close.end() if close else len(html)
            continue
        tags.append(tag)
        parents.append(stack.open[-1])
        if tag not in _VOID and not alone:
            stack.push(len(tags) - 1)


@dataclass
class Extract:
    title: str | None
    text: str
    container: str | None
    score: float
    link_density: float
    n_paragraphs: int


def extract(html: str, min_paragraph: int = MIN_PARAGRAPH) -> Extract:
    """The main text of a page; blocks are lines, and white space within them is single."""
    tree = parse(html)
    tags, parents = tree.tags, tree.parents
    n = len(tags)
    hidden, linked = [False] * n, [False] * n
    for k in range(1, n):
        hidden[k] = hidden[parents[k]] or tags[k] in _HIDDEN or tags[k] == "head"
        linked[k] = linked[parents[k]] or tags[k] == "a"
    chars, links, commas, own, inner = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for k, piece in tree.pieces:
        if not hidden[k]:
            size = len(_SPACE.sub(" ", piece).strip())
            chars[k] += size
            own[k] += size
            commas[k] += piece.count(",") + piece.count("，") + piece.count("、")
            links[k] += size * linked[k]
    for k in range(n - 1, 0, -1):
        up = parents[k]
        chars[up] += chars[k]
        links[up] += links[k]
        commas[up] += commas[k]
        if tags[k] in _BLOCK or inner[k]:
            inner[up] = True
        elif own[k]:
            own[up] += own[k]
    scores: dict[int, float] = {}
    passed: dict[int, int] = {}
    n_paragraphs = 0
    paragraph = [tags[k] in _PARAGRAPH or (tags[k] in _BLOCK and own[k] > 0 and not inner[k]) for k in range(n)]
    for k in range(1, n):
        if paragraph[k] and not hidden[k] and chars[k] >= min_paragraph:
            n_paragraphs += 1
            passed[parents[k]] = passed.get(parents[k], 0) + 1 + commas[k] + min(chars[k] // 100, 3)
    for up, points in passed.items():
        level = 0
        while up >= 0:
            scores[up] = scores.get(up, 0.0) + points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = parents[up], level + 1
    if not scores:
        return Extract(tree.title, "", None, 0.0, 0.0, 0)
    density = [links[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
    final = {k: s * (1 - density[k]) for k, s in scores.items()}
    best = min(final, key=lambda k: (-final[k], k))
    kept = {best}
    least = max(SIBLING_LEAST, SIBLING_SHARE * final[best])
    for k in range(1, n):
        if parents[k] == parents[best] and k != best and not hidden[k]:
            reads = paragraph[k] and chars[k] >= SIBLING_CHARS and density[k] < SIBLING_LINKS
            if final.get(k, 0.0) >= least or (tags[k] == "p" and reads):
                kept.add(k)
    inside = [False] * n
    block = [0] * n
    for k in range(n):
        up = parents[k]
        inside[k] = k in kept or (up >= 0 and inside[up])
        block[k] = k if tags[k] in _BLOCK or up < 0 else block[up]
    lines, last = [], None
    for k, piece in tree.pieces:
        if inside[k] and not hidden[k]:
            if block[k] != last:
                lines.append([])
                last = block[k]
            lines[-1].append(piece)
    body = "\n".join(x for x in (_SPACE.sub(" ", "".join(line)).strip() for line in lines) if x)
    path = []
    k = best
    while k > 0:
        path.append(tags[k])
        k = parents[k]
    return Extract(tree.title, body, "/".join(reversed(path)) or "#page", final[best], density[best], n_paragraphs)


_RESULT = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("text", pa.string()), ("container", pa.string()), ("score", pa.float64()), ("link_density", pa.float64()), ("n_paragraphs", pa.int32())])


def _run(min_paragraph: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches):
            rows = []
            for page, html in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if html is None:
                    rows.append((page, None, None, None, None, None, 0))
                else:
                    x = extract(html, min_paragraph)
                    rows.append((page, x.title, x.text, x.container, x.score, x.link_density, x.n_paragraphs))
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _RESULT, strict=True)], schema=_RESULT)

    return run


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_paragraph: int = MIN_PARAGRAPH) -> DataFrame:
    """(page_id, title, text, container, score, link_density, n_paragraphs) of every row."""
    source = common.tuned(pages).select(common.whole(pages, id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(common.lean(_run(min_paragraph)), "page_id long, title string, text string, container string, score double, link_density double, n_paragraphs int")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
