"""Tree scoring on pages whose main text is known."""

from __future__ import annotations

import re
import time
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmine.llm import html_extract

from ..compare import SF
from . import cases

STORY = ["Rivers, roads and rails met here, and so a town grew, slowly at first.", "Its markets drew farmers, smiths, weavers and, in the end, bankers.", "A fire, a flood, two wars: the town outlived them all, stone by stone."]
PAGE = f"""<!doctype html><html><head><title> Old &amp; New </title><style>p {{color: red}}</style></head><body>
<nav><ul><li><a href="/">Home</a><li><a href="/a">Archive, all of it, with everything</a></ul></nav>
<div id="main"><h1>Town</h1>{"".join(f"<p>{x}" for x in STORY)}<script>var x = "<p>not, this, text, at, all, ever</p>";</script></div>
<div class="side"><a href="/x">Links, links, and more links, to elsewhere, anywhere</a></div>
<footer>Imprint</footer></body></html>"""
PAGES = "page_id long, url string, html string"


def test_main_text():
    x = html_extract.extract(PAGE)
    assert x.title == "Old & New"
    assert x.text.split("\n") == ["Town", *STORY]
    assert x.container == "html/body/div" and x.n_paragraphs >= 3 and x.score > 0 and x.link_density == 0


def test_points_go_to_ancestors():
    body = "c," * 40
    x = html_extract.extract(f"<div><section><p>{body}</p></section></div>")
    # 1 + 40 commas + 80 // 100 characters, all of it for the parent
    assert (x.container, x.score) == ("div/section", 41.0)


def test_link_density_discounts():
    linked = f"<div><p><a href=x>{STORY[0]} {STORY[1]}</a></p></div>"
    plain = f"<section><p>{STORY[2]}</p></section>"
    x = html_extract.extract(f"<body>{linked}{plain}</body>")
    assert x.container == "body/section" and x.text == STORY[2]


def test_siblings_that_read_like_text_are_kept():
    page = f"<body><div>{''.join(f'<p>{s}</p>' for s in STORY * 3)}</div><p>{STORY[0]} {STORY[1]}</p><p>short</p></body>"
    x = html_extract.extract(page)
    assert x.text.split("\n")[-1] == f"{STORY[0]} {STORY[1]}" and "short" not in x.text


def test_ties_go_to_the_first():
    x = html_extract.extract(f"<p>{STORY[0]}</p>" + f"<body><div><p>{STORY[0]}</p></div><section><p>{STORY[0]}</p></section></body>")
    y = html_extract.extract(f"<div><p>{STORY[0]}</p></div><section><p>{STORY[0]}</p></section>")
    # half of each grandchild's points makes the page equal to either child, and it begins first
    assert x.container == y.container == "#page"


def test_broken_markup_is_read():
    for page in ("<", "<p", "<!--", "</div>", "<p>" + STORY[0], "<script>" + STORY[0], "<div><p>" + STORY[0] + "</div></p></b>", "a < b > c", "<a href='x", '<p class="' + "x" * 100, "<![CDATA[ x ]]>", "&#xFFFFFFFF; &bogus;"):
        assert isinstance(html_extract.extract(page).text, str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href=x>", "</a>", "<li>", "<table><tr><td>", "</table>", "<!-- ", " -->", "<script>", "</script>", "<", ">", '"', "text, with commas, and enough characters to count ", "&amp;"]), max_size=30))
def test_any_markup_gives_text_of_the_page(parts):
    x = html_extract.extract("".join(parts))
    assert x.score >= 0 and (x.container is None) == (x.n_paragraphs == 0)


def test_deep_and_long_pages():
    assert html_extract.extract("<div>" * 3000 + f"<p>{STORY[0]}</p>").text == STORY[0]
    long = html_extract.extract("<body>" + f"<p>{STORY[0]}</p>" * 20_000 + "</body>")
    assert long.text.count("\n") == 19_999


class Node:
    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up, self.inside = tag, up, []

    def above(self) -> list[Node]:
        return [self, *self.up.above()] if self.up else [self]

    def below(self) -> list[Node]:
        return [self, *(x for c in self.inside if isinstance(c, Node) for x in c.below())]


class Naive(HTMLParser):
    """A page's tree by the standard parser, and its main text by the definition, each value computed from the whole tree."""

    BLOCK, PARAGRAPH, VOID, HIDDEN = html_extract._BLOCK, html_extract._PARAGRAPH, html_extract._VOID, html_extract._HIDDEN | {"head", "title"}

    def __init__(self, page: str):
        super().__init__()
        self.at = self.root = Node("#page", None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            for x in self.at.above():
                if x.tag in self.BLOCK:
                    self.at = x.up if x.tag == "p" else self.at
                    break
        ends, within = {"li": ("li", "ul ol"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr td th", "table"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl")}.get(tag, ("", ""))
        for x in self.at.above():
            if x.tag in within.split():
                break
            if x.tag in ends.split():
                self.at = x.up
                if tag != "tr":
                    break
        node = Node(tag, self.at)
        self.at.inside.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_endtag(self, tag):
        for x in self.at.above():
            if x.tag == tag:
                self.at = x.up
                break

    def handle_data(self, data):
        self.at.inside.append(data)

    def visible(self, node: Node) -> list[tuple[Node, str]]:
        return [(x, c) for x in node.below() for c in x.inside if isinstance(c, str) and not any(y.tag in self.HIDDEN for y in x.above())]

    def chars(self, node: Node, linked: bool = False) -> int:
        return sum(len(" ".join(c.split())) for x, c in self.visible(node) if not linked or any(y.tag == "a" for y in x.above()))

    def paragraph(self, node: Node) -> bool:
        blocks = [x for x in node.below()[1:] if x.tag in self.BLOCK]
        return node.tag in self.PARAGRAPH or (node.tag in self.BLOCK and not blocks and self.chars(node) > 0)

    def container(self, least: int = 25) -> tuple[str | None, float, int]:
        nodes = self.root.below()
        scores = {}
        count = 0
        for x in nodes[1:]:
            if self.paragraph(x) and not any(y.tag in self.HIDDEN for y in x.above()) and self.chars(x) >= least:
                count += 1
                points = 1 + sum(c.count(",") for _, c in self.visible(x)) + min(3, self.chars(x) // 100)
                for level, y in enumerate(x.above()[1:]):
                    scores[y] = scores.get(y, 0) + points / (1, 2)[level] if level < 2 else scores.get(y, 0) + points / (3 * level)
        if not scores:
            return None, 0.0, 0
        final = {y: s * (1 - self.chars(y, True) / self.chars(y)) for y, s in scores.items()}
        best = max((y for y in nodes if y in final), key=lambda y: round(final[y], 9))
        return "/".join(x.tag for x in reversed(best.above()[:-1])) or "#page", final[best], count


def test_against_a_naive_scorer(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        x = html_extract.extract(r.html)
        container, score, count = Naive(r.html).container()
        assert (x.container, x.n_paragraphs) == (container, count) and x.score == pytest.approx(score), r.page_id
        visible = {re.sub(r"\s+", " ", c).strip() for _, c in Naive(r.html).visible(Naive(r.html).root)}
        assert all(any(piece in line for piece in visible) for line in x.text.split("\n"))


@pytest.mark.parametrize("page", ["<b>" * 30_000 + "</i>" * 30_000, '<a x="' * 60_000, "<a " * 100_000, "<!" * 100_000, "<b>" * 30_000 + "<div></div>" * 30_000, "<b>" * 30_000 + "<li>" * 30_000, "<a x='\">" * 60_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - began < 8


def test_all_pages(spark):
    rows = html_extract.op4_html_extraction(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    html = {r.page_id: r.html for r in pages}
    for r in rows:
        x = html_extract.extract(html[r.page_id])
        assert (r.title, r.text, r.container, r.score, r.link_density, r.n_paragraphs) == (x.title, x.text, x.container, x.score, x.link_density, x.n_paragraphs)
    assert sum(bool(r.text) for r in rows) > 0.9 * len(rows)


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    rows = [(None, "u", PAGE), (1, None, None), (2, "u", ""), (3, "u", PAGE), (3, "u", PAGE), (4, None, "plain words")]
    df = cases.table(spark, rows, PAGES).withColumns({c: F.lit("!") for c in ("title", "text", "container", "score", "id")})
    found = sorted((r.page_id or 0, r.text or "", r.score or 0.0) for r in html_extract.extract_pages(df).collect())
    text = "\n".join(["Town", *STORY])
    assert [f[:2] for f in found] == [(0, text), (1, ""), (2, ""), (3, text), (3, text), (4, "")]
    null = next(r for r in html_extract.extract_pages(df).collect() if r.page_id == 1)
    assert (null.title, null.text, null.container, null.score, null.n_paragraphs) == (None, None, None, None, 0)
    assert html_extract.extract_pages(cases.table(spark, [], PAGES)).count() == 0
