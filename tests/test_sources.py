from pyspark.sql import functions as F

from harrier import cli
from harrier.functions import fantasy, federations, titles
from harrier.sources import ingest, pages, store


def test_cells_by_content():
    r = pages.classify_cells(["1", "12", "3420001", "BERG Ola", "1994", "NOR", "25:10.3", "25:10.3", "0.00"])
    assert (r["rank"], r["bib"], r["fis_code"], r["name"], r["nation"], r["time_s"], r["fis_points"], r["status"]) == (1, 12, "3420001", "BERG Ola", "NOR", 1510.3, 0.0, "OK")
    assert pages.classify_cells(["DNF", "3420001", "BERG Ola"])["status"] == "DNF"
    assert pages.classify_cells(["3420001", "BERG Ola", "NOR"])["status"] == "ENTERED"
    assert pages.classify_cells(["1", "BERG Ola"]) is None


def test_ranks_of_large_fields():
    """Ranks from 1000 on, also such as look like a year or a code; a number of ten digits is none."""
    for rank in ("1000", "1994", "134017", "3420001"):
        r = pages.classify_cells([rank, "12", "3420002", "BERG Ola", "1995", "NOR", "25:10.3"])
        assert (r["rank"], r["bib"], r["fis_code"], r["birth_year"], r["status"]) == (int(rank), 12, "3420002", 1995, "OK")
    assert pages.classify_cells(["3420001", "12", "BERG Ola"])["rank"] is None and pages.classify_cells(["9999999999", "3420001", "BERG Ola"])["rank"] is None


def test_pages(spark):
    html = '<div class="event-header__kind">Men\'s 10km Classic</div><a class="table-row" href="x?competitorid=7"><div><div>1</div><div>3420001</div><div>BERG  Ola</div></div></a>'
    rows = pages.parse_race_pages(spark.createDataFrame([("r", html), ("n", None)], "race_id string, html string")).collect()
    assert [(r.race_id, r.title, r.rank, r.name, r.competitor_id) for r in rows] == [("r", "Men's 10km Classic", 1, "BERG Ola", "7")]


def test_titles(spark):
    df = spark.createDataFrame([("Women's 4x7.5km Relay Classic/Free",), ("Men's Sprint Free",), (None,), ("Mixed Team Sprint",)], "title string")
    got = [tuple(r)[1:] for r in titles.classify_title(df).collect()]
    assert got[0] == ("W", "distance", "CF", "relay", 7.5, True) and got[1] == ("M", "sprint", "F", "sprint", None, False)
    assert got[2] == (None, "distance", "?", None, None, False) and got[3] == ("X", "sprint", "?", "team_sprint", None, True)


def test_upserts(spark):
    old = spark.createDataFrame([("a", "A", "NOR", 1990, None)], "fis_code string, name string, nation string, birth_year int, competitor_id string")
    new = old.select("fis_code", F.lit("B").alias("name"), F.lit(None).cast("string").alias("nation"), "birth_year", F.lit("7").alias("competitor_id"), F.lit(1).alias("seq"))
    assert [tuple(r) for r in store.upsert_athletes(old, new).collect()] == [("a", "B", "NOR", 1990, "7")]


def test_csv_quotes(spark):
    assert store.quoted_csv(spark.createDataFrame([('a"b', None)], "x string, y int")).first().line == '"a""b",""'


def test_news_only_flags(spark):
    df = spark.createDataFrame([("news_rumour",), ("federation",)], "s string").select(federations.treat(F.col("s")))
    assert [r[0] for r in df.collect()] == ["flag_for_review", "authoritative"]


def test_best_team():
    import pandas as pd

    m = pd.DataFrame({"fis_code": list("abc"), "gender": ["M", "M", "W"], "points": [10, 9, 5], "price": [8, 6, 4]})
    assert fantasy.best_team(m, 10, 1, 1) == [1, 2] and fantasy.cost_of_forcing(m, "a", 10, 1, 1) == 4.0


def test_options_stand_on_both_sides():
    p = cli.parser()
    assert p.parse_args(["--store", "x", "rate"]).store == "x" and p.parse_args(["rate", "--store", "x"]).store == "x"


def test_statuses_in_any_case_and_repeated_cells():
    r = pages.classify_cells(["dnf", "3420001", "3420002", "BERG Ola", "NOR", "SWE", "+1:02.5", "+3.0", "12.50", "13.50"])
    assert (r["status"], r["rank"], r["fis_code"], r["name"], r["nation"], r["diff_s"], r["fis_points"]) == ("DNF", None, "3420001", "BERG Ola", "NOR", 62.5, 13.5)


PAGE = """<div class="event-header__name"><h1>Ruka</h1><div class="event-header__subtitle">World <b>Cup</b></div></div>
<div class="event-header__kind">Men's 10km Interval Start Classic</div>%s
<a class="table-row" href="x?competitorid=7"><div><span><div>1</div></span><div>12</div><div>3420001</div><div>BERG &amp; Ola</div><div>1994</div><div>NOR</div><div>25:10.3</div></div></a>
<a class="table-row" href="x"><div>dns</div><div>3420002</div><div>LIND Eva</div></a>"""


def test_headers(spark):
    rows = [("a", PAGE % '<div class="timezone-date" data-date="2024-11-29T10:00">Nov</div>'), ("b", PAGE % '<span class="event-header__date">November 30, 2024</span>'), ("c", PAGE % '<div class="timezone-date" data-date="soon"></div>'), ("d", "")]
    got = {r.race_id: r for r in pages.races_of(pages.parse_pages(spark.createDataFrame(rows, "race_id string, html string"))).collect()}
    assert [str(got[r].race_date) for r in "abcd"] == ["2024-11-29", "2024-11-30", "None", "None"]
    assert (got["a"].place, got["a"].series, got["a"].gender, got["a"].technique, got["a"].length_km) == ("Ruka", "World Cup", "M", "C", 10.0) and got["d"].title is None


def test_listed_races(spark):
    link = '<a href="/DB/%s.html?x=1&%s=%s">'
    c = spark.createDataFrame([(2024, "WC", link % ("event-details", "eventid", 5) * 2 + link % ("results", "eventid", 6)), (2024, "NC", link % ("event-details", "eventid", 7))], "season int, category string, html string")
    e = spark.createDataFrame([("5", link % ("results", "raceid", 1) + link % ("results", "raceid", 2)), ("7", link % ("results", "raceid", 2)), ("8", None)], "event_id string, html string")
    assert sorted(map(tuple, pages.listed_races(c, e).collect())) == [("1", 2024, "5"), ("2", 2024, "7")]


def test_ingest_of_whole_pages(spark, tmp_path):
    root = str(tmp_path / "store")
    date = '<div class="timezone-date" data-date="2024-11-29"></div>'
    tour = '<div class="event-header__kind">Overall Standings</div><a class="table-row"><div>1</div><div>3420009</div><div>TOUR Ann</div></a>'
    new = '<a class="table-row"><div>3420003</div><div>NEW Nils</div><div>7</div></a>'
    one = spark.createDataFrame([("r", PAGE % date), ("tour", tour), ("next", new), (None, new)], "race_id string, html string")
    listed = spark.createDataFrame([("r", 2025, "5")], "race_id string, season int, event_id string")
    ingest.ingest(spark, root, one, listed)
    ingest.ingest(spark, root, one.where("race_id = 'next'"))
    races, athletes, results, starts = (store.read(spark, root, t).collect() for t in ("races", "athletes", "results", "start_list"))
    assert {(r.race_id, r.season, r.event_id) for r in races} == {("r", 2025, "5"), ("next", None, None)}
    assert {(a.fis_code, a.name) for a in athletes} == {("3420001", "BERG & Ola"), ("3420002", "LIND Eva"), ("3420003", "NEW Nils")}
    assert {(r.race_id, r.fis_code, r.status) for r in results} == {("r", "3420001", "OK"), ("r", "3420002", "DNS")}
    assert {(s.race_id, s.fis_code, s.bib) for s in starts} == {("r", "3420001", 12), ("r", "3420002", None), ("next", "3420003", 7)}


def test_csv_files(spark):
    df = spark.createDataFrame([("a", 2, 1.0, 'x"y'), ("a", 1, 0.25, None)], "k string, i int, v double, t string")
    assert store.csv_files(df, "k", ["i"], ["i", "v", "t"]).first().text == '﻿"i","v","t"\r\n"1","0.25",""\r\n"2","1","x""y"\r\n'
    names = spark.createDataFrame([("Ål/Ruka 1.",), (None,), ("a--",)], "s string").select(store.safe_name(F.col("s")).alias("n"))
    assert [r.n for r in names.collect()] == ["l-Ruka-1.", "export", "a-"]


RACE_PAGE = '<div class="event-header__kind">Men\'s 10km Classic</div><span class="timezone-date" data-date="{day}"></span>' + "".join('<a class="table-row" href="x?competitorid={k}"><div>{k}</div><div>342000{k}</div><div>{who} {k}</div></a>'.replace("{k}", str(k)) for k in (1, 2, 3))


def _table(spark, root, name):
    return sorted(map(tuple, store.read(spark, root, name).drop("fetched_at").collect()), key=str)


def test_one_broken_page_of_many(spark, tmp_path):
    class Fussy(pages._Page):
        def feed(self, html):
            if "broken" in html:
                raise RuntimeError("no such page")
            super().feed(html)

    html = [(f"r{i}", RACE_PAGE.format(day=f"2024-01-{i + 1:02}", who="BERG")) for i in range(12)] + [("bad", "broken"), ("odd", RACE_PAGE.format(day="2024-13-40", who="LUND"))]
    assert ingest.ingest(spark, str(tmp_path), spark.createDataFrame(html, "race_id string, html string"), page=Fussy) == 1
    assert len(_table(spark, str(tmp_path), "races")) == 13 and len(_table(spark, str(tmp_path), "results")) == 39
    bad = dict(_table(spark, str(tmp_path), "bad_pages"))
    assert bad == {"bad": "RuntimeError: no such page"}
    again = spark.createDataFrame([("bad", RACE_PAGE.format(day="2024-02-01", who="BERG"))], "race_id string, html string")
    assert ingest.ingest(spark, str(tmp_path), again) == 0
    assert _table(spark, str(tmp_path), "bad_pages") == [] and len(_table(spark, str(tmp_path), "races")) == 14


def test_a_merge_touches_its_buckets_only_and_all_tables_at_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    html = [(f"r{i}", RACE_PAGE.format(day=f"2024-01-{i + 1:02}", who="BERG")) for i in range(20)]
    ingest.ingest(spark, root, spark.createDataFrame(html, "race_id string, html string"))
    before = store.manifest(spark, root)["tables"]
    tables = {n: _table(spark, root, n) for n in ("races", "athletes", "results", "start_list")}
    one = spark.createDataFrame([("r3", RACE_PAGE.format(day="2024-03-01", who="NY"))], "race_id string, html string")

    swap = store._swap
    monkeypatch.setattr(store, "_swap", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    try:
        ingest.ingest(spark, root, one)
        raise AssertionError("it should have failed")
    except OSError:
        pass
    assert {n: _table(spark, root, n) for n in tables} == tables  # written, but not the tables'
    monkeypatch.setattr(store, "_swap", swap)
    ingest.ingest(spark, root, one)
    after = store.manifest(spark, root)["tables"]
    assert all(sum(before[n][b] != v for b, v in after[n].items()) == 1 for n in ("races", "results", "start_list"))
    assert [r for r in _table(spark, root, "races") if r not in tables["races"]][0][3].isoformat() == "2024-03-01"
    assert {r[1] for r in _table(spark, root, "athletes")} == {"NY 1", "NY 2", "NY 3"}
    now = {n: _table(spark, root, n) for n in tables}
    assert store.vacuum(spark, root) > 3 and {n: _table(spark, root, n) for n in tables} == now
