"""Tables by a grid filled cell by cell, odd spans, and pages that can't be laid out."""

import random

import pytest

from quillstone.llm import render

TABLES = {
    "<table><tr><td rowspan=2>A<td>b<tr><td>c</table>": "A  b\n   c",
    "<table><tr><td>a<td>b<tr><td colspan=2>a wide cell<tr><td>c<td>d</table>": "a  b\na wide cell\nc  d",
    "<table><tr><td colspan=2>a wide cell<td>x<tr><td>c<td>d<td>y</table>": "a wide cell  x\nc  d         y",
    "<table><tr><td colspan=1000>a<td>b</table>": "a  b",
    "<table><tr><td rowspan=0>A<td>b<tr><td>c<tbody><tr><td>d<td>e</table>": "A  b\n   c\nd  e",
    "<table><tr><td rowspan=2>a<br>b<br>c<td>x<tr><td>y</table>z": "a  x\nb  y\nc\n\nz",
    "<table><td>a<td>b<tr><td>c</table>": "a  b\nc",
    "<table><tr>loose<td>b</table>": "loose  b",
}


@pytest.mark.parametrize(("html", "text"), TABLES.items())
def test_spans(html, text):
    assert render.render(html) == text


@pytest.mark.parametrize("span", ["²", "-1", "", " 2x", "٣", "1e9", "99999999999999999999", "+2", "0"])
def test_odd_spans_are_read_as_browsers_do(span):
    for name in ("colspan", "rowspan"):
        assert render.render(f"<table><tr><td {name}='{span}'>a<td>b</table>") == "a  b"


def brute(rows):
    """Cells in a grid, square by square; each column as wide as its widest cell of one column."""
    taken, out = {}, {}
    for r, row in enumerate(rows):
        c = 0
        for text, high, wide in row:
            while any((r, j) in taken for j in range(c, c + wide)):
                c += 1
            for i in range(r, min(r + high, len(rows))):
                for j in range(c, c + wide):
                    taken[i, j] = text
            out[r, c] = (text, wide)
            c += wide
    return out


def test_cells_of_a_column_start_at_one_place():
    r = random.Random(3)
    for n in range(200):
        rows = [[(f"c{n}x{i}y{j}", r.choice((1, 1, 1, 2, 3)), r.choice((1, 1, 1, 2, 3))) for j in range(r.randint(1, 4))] for i in range(r.randint(1, 5))]
        html = "".join("<tr>" + "".join(f"<td rowspan={h} colspan={w}>{t}" for t, h, w in row) for row in rows)
        lines = render.render(f"<table>{html}</table>").split("\n")
        found = {}
        for (row, column), (text, _) in brute(rows).items():
            at = next(x.index(text) for x in lines if text in x.split())
            assert found.setdefault(column, at) == at
            assert text in lines[row].split()
        places = [found[c] for c in sorted(found)]
        assert places == sorted(places)


def test_a_bad_page_does_not_stop_the_others(spark, monkeypatch):
    assert render.rendered("<p>a &amp; b") == ("a & b", False)
    monkeypatch.setattr(render, "render", lambda html: 1 / 0)
    assert render.rendered("<p>a &amp;<br> b</p>\n\n<td>c") == ("a & b\nc", True)
    assert render.rendered(None) == ("", True)


def test_long_pages_through_spark(spark):
    pages = spark.createDataFrame([(1, "<p>word</p>" * 200_000), (2, "<table>" + "<tr><td>a<td rowspan=3>b" * 20_000), (3, "<td colspan='²'>x")], "page_id long, html string")
    got = {x.page_id: x for x in render.render_pages(pages, status=True).collect()}
    assert not any(x.degraded for x in got.values())
    assert got[1].text.count("word") == 200_000 and got[2].text.count("a") == 20_000 and got[3].text == "x"
