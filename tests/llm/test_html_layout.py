"""Layout of HTML pages: trees, visibility and lines."""

import time

import pytest

from topshare.llm import html_layout as H

CASES = {
    "implied paragraphs": ("<p>One<p>Two<div>Three</div>Four", "One\n\nTwo\n\nThree\nFour"),
    "text without tags": ("just  text\n here &amp; &eacute; &lt;b&gt;", "just text here & é <b>"),
    "inline spaces": ("a<b> b</b> <i>c</i>d <span> e</span>", "a b cd e"),
    "line breaks": ("a<br>b<br/><br>c", "a\nb\n\nc"),
    "no-break space stays": ("a&nbsp; b", "a  b"),
    "headings": ("<h1>T</h1>x<h2>U<h3>V</h3>", "T\n\nx\n\nU\n\nV"),
    "lists": ("<ul><li>a<li>b<ol start=3><li>x<li value=9>y<li>z</ol><li>c</ul>", "- a\n- b\n  3. x\n  9. y\n  10. z\n- c"),
    "item of several lines": ("<ol><li>one<p>two</ol>", "1. one\n\n   two"),
    "definitions": ("<dl><dt>T<dd>D<dt>U<dd>E</dl>", "T\n  D\nU\n  E"),
    "quote": ("x<blockquote>q<p>r</blockquote>y", "x\n\n  q\n\n  r\n\ny"),
    "preformatted": ("<pre>\n a\n   b </pre>", " a\n   b"),
    "table": (
        "<table><caption>C</caption><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td>fig<td>2</table>",
        "C\nName   Qty\napple  10\nfig    2",
    ),
    "table groups and spans": (
        "<table><tfoot><tr><td>end<td>z</tfoot><thead><tr><td colspan=2>wide<td>k</thead>"
        "<tr><td rowspan=2>tall<td>1<td>x<tr><td>2<td>y</table>",
        "wide     k\ntall  1  x\n      2  y\nend   z",
    ),
    "cell of two lines": ("<table><tr><td>a<br>bb<td>c</table>", "a   c\nbb"),
    "table in table": ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i  j  k"),
    "cells without row": ("<table><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    "hidden": (
        "<p hidden>no</p><div style='color:red; display : none'>no</div><template>no</template><script>'<p>'</script>"
        "<style>p{}</style><noscript>no</noscript><dialog>no</dialog><dialog open>yes</dialog>",
        "yes",
    ),
    "visibility": ("<div style=visibility:hidden>no<b style='visibility: visible'>yes</b></div>", "yes"),
    "details": ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    "comments and declarations": ("<!DOCTYPE html>a<!-- <p>no --->b<?php no ?>c<![CDATA[no]]>d", "abcd"),
    "head is not shown": ("<html><head><title>no</title><meta charset=x><body>yes", "yes"),
    "head left out": ("<title>no</title><link rel=x>yes", "yes"),
    "raw text": ("<textarea>\n<b>&amp;</textarea><script>if (a</b) </script>x", "<b>&x"),
    "stray end tags": ("</div>a</p>b</br>c</table>", "a\n\nb\nc"),
    "end tags out of order": ("<b><i>a</b>b</i>c", "abc"),
    "quotes in attributes": ("<a title='>' href=\"x>y\">t</a>", "t"),
    "unfinished": ("a <b>b</b> <a href='x", "a b"),
    "not a tag": ("1 < 2 and 3 > 2 <- x", "1 < 2 and 3 > 2 <- x"),
    "empty": ("", ""),
    "only white space": (" \n\t ", ""),
}


FOREIGN = {
    "text in a row group": ("<table><tbody>Note<tr><td>a<td>b</table>", "Note\na  b"),
    "text in row groups and table": ("<table>x<thead> y <tr><td>a</thead><tbody><tr><td>b</tr>z</table>", "x y z\na\nb"),
    "chart labels": (
        "a<svg viewBox='0 0 1 1'><title>no</title><desc>no</desc><defs><text>no</text></defs><rect x=1 /><text>Q1 <tspan>sales</tspan></text>"
        "<g><text x=1>10</text><text x=2>20</text></g><text display=none>no</text>no</svg>b",
        "a Q1 sales 10 20 b",
    ),
    "lines of a label": ("<svg><text><tspan x=0>one</tspan><tspan x=0 dy=1em>two</tspan></text></svg>", "one two"),
    "HTML in a drawing": ("<p>a<svg><foreignObject><div>box</div></foreignObject><text>t</text></svg>b", "a\nbox\nt b"),
    "empty parts of a drawing": ("<svg><defs/>" + "<path d='M0'/>" * 600 + "<text>after</text></svg>", "after"),
    "drawing that is not closed": ("<svg><path d='M0'/><g><p>para</p>", "para"),
    "hidden drawing": ("<svg hidden><text>no</text></svg><svg style='display:none'><text>no</text></svg><svg><text visibility=hidden>no</text></svg>y", "y"),
    "formula": (
        "so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>no</annotation></semantics></math>, fine",
        "so x=1, fine",
    ),
    "fraction": ("<math><mfrac><mn>1</mn><mn>2</mn></mfrac><mphantom><mn>no</mn></mphantom></math>", "1 2"),
    "text of elements that only drawings leave out": ("<desc>a</desc> <filter>b</filter>", "a b"),
}


@pytest.mark.parametrize("name", FOREIGN)
def test_row_groups_drawings_and_formulas(name):
    page, text = FOREIGN[name]
    assert H.visible_text(page) == text


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    page, text = CASES[name]
    assert H.visible_text(page) == text


def test_tree_has_implied_elements():
    tree = H.parse("<table><td>x</table>")
    assert [c.tag for c in tree.children] == ["head", "body"]
    table = tree.children[1].children[0]
    assert (table.tag, table.children[0].tag, table.children[0].children[0].tag) == ("table", "tr", "td")


PIECES = ["<", "<a ", "<div>", "<table><tr><td>", '<a href="', "<p>", "</p>", "<li>", "<b>", "<!--", "&amp", "<script>", "<td rowspan=999>"]


@pytest.mark.parametrize("piece", PIECES)
def test_hostile_pages_end_soon(piece):
    started = time.process_time()
    H.visible_text(piece * 4000 + "end")
    assert time.process_time() - started < 20


def test_wide_columns_are_not_filled_without_end():
    page = "<table>" + f"<tr><td>{'x' * 5000}<td>b" + "<tr><td>a<td>b" * 200 + "</table>"
    lines = H.visible_text(page).split("\n")
    assert lines[0] == "x" * 5000 + "  b" and lines[1] == "a" + " " * 81 + "b"


def test_rows(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (None, "b", "t"), (2, None, "t"), (3, "<p>long " * 20_000, "t")]
    found = H.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["text"][:5]) for r in found) == [(0, "b"), (1, "a"), (1, "a"), (2, ""), (3, "long\n")]
    assert H.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_all_words_of_the_tables_pages_are_kept(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in H.extract(pages).collect():
        page = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", sources[r["page_id"]])
        words = H.html.unescape(re.sub(r"<[^>]+>", " ", page)).split()
        assert [w for w in r["text"].split() if w not in ("-",)] == [w for w in words if w not in ("-",)]
