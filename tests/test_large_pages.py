"""Pages of large races: made and parsed one at a time, and once; no cell or aggregate holds many."""

import os
import random
from html.parser import HTMLParser

import pytest

from harrier.plans import queries
from harrier.sources import pages
from harrier.testing import league

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_pages_are_joined_one_race_at_a_time(spark):
    heads = spark.createDataFrame([("a", "<h1>A</h1>"), ("b", "B"), ("none", "C"), (None, "D")], "race_id string, text string")
    rows = spark.createDataFrame([(r, t) for r in ("a", "b", "headless", None) for t in ("z", "y", None, "é", "10", "9")], "race_id string, text string").repartition(5)
    made = league.pages(heads, rows)
    assert "collect_list" not in _plan(made)
    body = "\n".join(["10", "9", "y", "z", "é"])
    assert {r.race_id: r.html for r in made.collect()} == {"a": "<h1>A</h1>" + body, "b": "B" + body, "none": "C"}


@pytest.mark.parametrize("entries", [1, 3, 10_000])
def test_rows_are_handed_on_in_parts(spark, monkeypatch, entries):
    """Whether a page has more rows than are handed on at once, or many pages have fewer."""
    monkeypatch.setattr(pages, "ENTRIES", entries)
    row = '<a class="table-row" href="x?competitorid={0}"><div>{0}</div><div>34200{0:02}</div><div>BERG {0}</div></a>'
    html = [(f"r{n}", f'<div class="event-header__kind">Race {n}</div>' + "".join(row.format(k) for k in range(1, n + 1))) for n in (0, 1, 7, 20)] + [("null", None)]
    df = spark.createDataFrame(html, "race_id string, html string").coalesce(1)
    rows = pages.parse_race_pages(df)
    assert "Generate" not in _plan(rows)
    want = [(f"r{n}", f"Race {n}", k, f"34200{k:02}", f"BERG {k}", str(k)) for n in (1, 7, 20) for k in range(1, n + 1)]
    columns = ("race_id", "title", "rank", "fis_code", "name", "competitor_id")
    parsed = pages.parse_pages(df)
    assert sorted(map(tuple, rows.select(*columns).collect())) == sorted(want)
    assert sorted(map(tuple, pages.entries_of(parsed).select(*columns).collect())) == sorted(want) and rows.columns == pages.entries_of(parsed).columns
    assert {r.race_id: (r.title, len(r.entries), r.error) for r in parsed.collect()} == {f"r{n}": (f"Race {n}", n, None) for n in (0, 1, 7, 20)} | {"null": (None, 0, None)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pages_are_parsed_once(spark):
    """What tells results from start lists reads the parsed rows, and doesn't parse again."""
    assert "MapIn" not in _plan(queries.result_pages(spark, SF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_timed_pages_hold_no_race_in_an_aggregate(spark):
    plan = _plan(queries.timed_pages(spark, SF))
    assert "collect_list" not in plan and "Generate" not in plan


def test_plain_tags(spark):
    """Plain divs are read as by the library's patterns, also within scripts, comments and broken tags."""

    class Library(pages._Page):
        updatepos, parse_starttag, parse_endtag = HTMLParser.updatepos, HTMLParser.parse_starttag, HTMLParser.parse_endtag

    parts = ["<div>", "</div>", "<div", "</div", "<DIV>", "</div >", '<div class="event-header__name">', "<h1>", "</h1>", '<a class="table-row" href="x?competitorid=7">', "</a>", "<span>", "</span>", "text", "1", "3420001", "BERG Ola", "&amp;", "&", "<", ">", "<script>", "</script>", "<!--", "-->", "\n"]
    draw, some = random.Random(5), 0
    for _ in range(5000):
        html, got = "".join(draw.choice(parts) for _ in range(draw.randrange(30))), []
        for kind in (pages._Page, Library):
            p = kind()
            p.feed(html)
            p.close()
            got.append((p.rows, p.header, p.date))
        assert got[0] == got[1], html
        some += any(cells for _, cells in got[0][0])
    assert some > 100
