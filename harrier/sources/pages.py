"""Pages: addresses, links, headers and rows of results. Fetching is not Spark's; pages are read as a table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titles import classify_title

# fixed values
BASE = "https://www.fis-ski.com/DB/general"
CATEGORIES = ("WC", "COC", "WSC", "OWG", "NC")
STATUSES = ("DNF", "DNS", "DSQ", "DQ", "LAP", "OOT", "RAL")


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 20)


def calendar_url(season: Column, category: Column) -> Column:
    return F.format_string(BASE + "/calendar-results.html?sectorcode=CC&seasoncode=%s&categorycode=%s", season.cast("string"), category)


def event_url(event_id: Column, season: Column) -> Column:
    return F.format_string(BASE + "/event-details.html?sectorcode=CC&eventid=%s&seasoncode=%s", event_id.cast("string"), season.cast("string"))


def race_url(race_id: Column) -> Column:
    return F.format_string(BASE + "/results.html?sectorcode=CC&raceid=%s", race_id.cast("string"))


def ids(html: Column, page: str, name: str) -> Column:
    """Distinct numbers of a parameter in links to a page, in the order of their first use."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(page.replace(".", r"\.") + r"\?[^\"']*" + name + r"=(\d+)"), 1))


def event_ids(html: Column) -> Column:
    return ids(html, "event-details.html", "eventid")


def race_ids(html: Column) -> Column:
    return ids(html, "results.html", "raceid")


def listed_races(calendars: DataFrame, events: DataFrame) -> DataFrame:
    """race_id, season, event_id of calendar pages (season, category, html) and event pages (event_id, html).

    A race that is listed more than once has its last listing: by season, category, event and place on the page. Events
    without a page, and pages without links, list nothing.
    """
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    c = calendars.select("season", place.alias("c"), F.posexplode(event_ids(F.col("html"))).alias("e", "event_id"))
    e = events.select(F.col("event_id").cast("string").alias("event_id"), F.posexplode(race_ids(F.col("html"))).alias("r", "race_id"))
    last = F.max(F.struct("season", "c", "e", "r", "event_id")).alias("x")
    return c.join(e, "event_id").groupBy("race_id").agg(last).select("race_id", "x.season", "x.event_id")


def _text_date(text: str, form: str) -> str | None:
    try:
        return datetime.strptime(text, form).date().isoformat()
    except ValueError:
        return None


class _Page(HTMLParser):
    """Cells of result rows (texts of innermost divs of a.table-row) and the header's texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.cells, self.stack, self.header, self.dates = [], None, [], {}, [None, None]

    @property
    def date(self) -> str | None:
        """The machine-readable date; else the first that the header spells out."""
        return self.dates[0] or self.dates[1]

    # a page is mostly plain divs, which need none of the library's patterns; and nobody asks for lines

    def updatepos(self, i, j):
        return j

    def parse_starttag(self, i):
        if not self.rawdata.startswith("<div>", i):
            return super().parse_starttag(i)
        self.handle_starttag("div", [])
        return i + 5

    def parse_endtag(self, i):
        if self.cdata_elem is not None or not self.rawdata.startswith("</div>", i):
            return super().parse_endtag(i)
        self.handle_endtag("div")
        return i + 6

    def handle_starttag(self, tag, attrs):
        if tag == "div" and not attrs:
            for s in self.stack:
                s["leaf"] = False
            self.stack.append({"tag": tag, "text": [], "leaf": True, "part": None, "head": False})
            return
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "a" and "table-row" in classes:
            m = re.search(r"competitorid=(\d+)", a.get("href") or "")
            self.cells = []
            self.rows.append((m and m[1], self.cells))
        if tag == "div":
            for s in self.stack:
                s["leaf"] = False
        if "timezone-date" in classes and a.get("data-date"):
            self.dates[0] = self.dates[0] or _text_date(a["data-date"][:10], "%Y-%m-%d")
        part = next((c.split("__")[1] for c in classes if c.startswith("event-header__")), None)
        head = any("event-header" in c for c in classes)
        if tag in ("div", "h1", "span") or head:
            self.stack.append({"tag": tag, "text": [], "leaf": True, "part": part, "head": head})

    def handle_data(self, data):
        for s in self.stack:
            s["text"].append(data)

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1]["tag"] == tag:
            self._closed(self.stack.pop())
        elif any(s["tag"] == tag for s in self.stack):
            while self._closed(self.stack.pop()) != tag:  # what was left open ends with what holds it
                pass
        if tag == "a":
            self.cells = None

    def _closed(self, s: dict) -> str:
        cell = self.cells is not None and s["tag"] == "div" and s["leaf"]
        if not (cell or s["part"] or s["head"] or s["tag"] == "h1"):
            return s["tag"]
        text = " ".join(" ".join(s["text"]).split())
        if s["part"] and text:
            self.header.setdefault(s["part"], text)
        if s["tag"] == "h1" and text and any(x["part"] == "name" for x in self.stack):
            self.header.setdefault("place", text)
        if s["head"] and re.fullmatch(r"[A-Z][a-z]+ \d{1,2}, \d{4}", text):
            self.dates[1] = self.dates[1] or _text_date(text, "%B %d, %Y")
        if cell and text:
            self.cells.append(text)
        return s["tag"]


def _seconds(text: str) -> float | None:
    try:
        out = 0.0
        for part in text.lstrip("+").split(":"):
            out = out * 60 + float(part)
        return out
    except ValueError:
        return None


# What a cell may be: its field, pattern and reader, and what a second such cell does: it may be something else ("ask"), is
# passed over ("first") or counts instead ("last"). The patterns are fixed values; the first rule that matches is taken.
RULES = tuple((field, re.compile(pattern), reader, second) for field, pattern, reader, second in (
    ("fis_code", r"\d{6,8}", str, "ask"),
    ("birth_year", r"(?:19|20)\d{2}", int, "ask"),
    ("nation", r"[A-Z]{3}", str, "ask"),
    ("bib", r"\d{1,3}", int, "ask"),
    ("diff_s", r"\+\d{1,3}:\d{2}(?:\.\d+)?|\+\d{1,3}(?:\.\d+)?", _seconds, "first"),
    ("time_s", r"\d{1,3}:\d{2}(?:\.\d+)?", _seconds, "first"),
    ("fis_points", r"\d+\.\d{2}", float, "last"),
    ("status", "(?i:" + "|".join(STATUSES) + ")", str.upper, "last"),
    ("name", r"(?=.{4}).*[A-Za-z].*", str, "ask"),
))
LEAD = (("rank", re.compile(r"\d{1,9}"), int), ("status", RULES[7][1], str.upper))


def classify_cells(cells: list[str]) -> dict | None:
    """What a row's cells hold, by their content; None without a code or a name.

    A number in the first cell is the rank, of up to nine digits; one that looks like a code only if another cell does too.
    """
    found: dict = {}
    lead = next(((f, read(cells[0])) for f, p, read in LEAD if cells and p.fullmatch(cells[0])), None)
    code = RULES[0][1].fullmatch
    if lead and code(cells[0]) and not any(map(code, cells[1:])):
        lead = None
    if lead:
        found[lead[0]] = lead[1]
    for c in cells[1 if lead else 0 :]:
        rule = next((r for r in RULES if r[1].fullmatch(c) and not (r[3] == "ask" and r[0] in found)), None)
        if rule and (rule[3] == "last" or rule[0] not in found):
            found[rule[0]] = rule[2](c)
    if "fis_code" not in found or "name" not in found:
        return None
    found.setdefault("status", "OK" if "rank" in found or "time_s" in found else "ENTERED")
    return {f: found.get(f) for f in ("rank", *(r[0] for r in RULES))}


HEADER = "race_id string, title string, place string, series string, race_date string"
ENTRY = "competitor_id string, rank int, status string, fis_code string, birth_year int, nation string, bib int, diff_s double, fis_points double, name string, time_s double"
_HEADER, _ENTRY = ([c.split(" ")[0] for c in x.split(", ")] for x in (HEADER, ENTRY))
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
_HEADER_FIELDS, _ENTRY_FIELDS = ([pa.field(n, _ARROW[t]) for n, t in (c.split(" ") for c in x.split(", "))] for x in (HEADER, ENTRY))
#: Entries that a task hands on at once.
ENTRIES = 10_000


def _read(batches: Iterable[pa.RecordBatch], page: type) -> Iterator[tuple[tuple, list[tuple], str | None]]:
    """Header, entries and error of each page, one page at a time."""
    for b in batches:
        race_ids, htmls = b.column("race_id"), b.column("html")
        for i in range(b.num_rows):
            race = race_ids[i].as_py()
            try:
                p = page()
                p.feed(htmls[i].as_py() or "")
                p.close()
                entries = []
                for competitor, cells in p.rows:
                    if found := classify_cells(cells):
                        entries.append((competitor, *(found[c] for c in _ENTRY[1:])))
                yield (race, p.header.get("kind"), p.header.get("place") or p.header.get("name"), p.header.get("subtitle"), p.date), entries, None
            except Exception as e:  # noqa: BLE001  whatever is wrong with one page is that page's
                yield (race, None, None, None, None), [], f"{type(e).__name__}: {e}"


def parse_pages(pages: DataFrame, page: type = _Page) -> DataFrame:
    """One row a race page (race_id, html): its header and ``entries``, the rows with a code and a name, and ``error``.

    A null page has neither. Pages are parsed leniently: what isn't a header or a row is passed over. A page on which the
    parser (``page``) fails gives the reason in ``error``, and the others aren't touched by it. A task holds a page at a time, and
    what of pages makes ``ENTRIES`` entries.
    """
    schema = pa.schema([*_HEADER_FIELDS, pa.field("entries", pa.list_(pa.struct(_ENTRY_FIELDS))), pa.field("error", pa.string())])

    def parse(batches):
        out, held = [], 0

        def made():
            return pa.RecordBatch.from_pylist([{**dict(zip(_HEADER, head, strict=True)), "entries": [dict(zip(_ENTRY, e, strict=True)) for e in entries], "error": error} for head, entries, error in out], schema)

        for parsed in _read(batches, page):
            out.append(parsed)
            held += 1 + len(parsed[1])
            if held >= ENTRIES:
                yield made()
                out, held = [], 0
        if out:
            yield made()

    return pages.select("race_id", "html").mapInArrow(parse, f"{HEADER}, entries array<struct<{ENTRY.replace(' ', ':')}>>, error string".replace(",:", ", "))


def bad_pages(parsed: DataFrame) -> DataFrame:
    """race_id, error of the pages that can't be parsed."""
    return parsed.where("error IS NOT NULL").select("race_id", "error")


def entries_of(parsed: DataFrame) -> DataFrame:
    """The rows of parsed pages, each with its page's header."""
    return parsed.select(*_HEADER, F.inline("entries"))


def parse_race_pages(pages: DataFrame) -> DataFrame:
    """Rows of race pages (race_id, html), each with its page's header. Rows without code or name go. No page's rows are ever one cell."""
    schema = pa.schema([*_HEADER_FIELDS, *_ENTRY_FIELDS])

    def parse(batches):
        out = []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for head, entries, _ in _read(batches, _Page):
            for e in entries:
                out.append(head + e)
                if len(out) >= ENTRIES:
                    yield made()
                    out = []
        if out:
            yield made()

    return pages.select("race_id", "html").mapInArrow(parse, f"{HEADER}, {ENTRY}")


def races_of(parsed: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """The races of parsed pages, as stored; season and event of those that are listed."""
    out = classify_title(parsed.drop("entries", "error")).withColumn("race_date", F.col("race_date").try_cast("date"))
    if listed is None:
        out = out.withColumns({"season": F.lit(None).cast("int"), "event_id": F.lit(None).cast("string")})
    else:
        out = out.join(listed.select("race_id", F.col("season").cast("int").alias("season"), "event_id"), "race_id", "left")
    return out.select("race_id", "event_id", "season", "race_date", "place", "series", "title", "gender", "kind", "technique", "start_type", "length_km", "is_team")


def results_of(rows: DataFrame) -> DataFrame:
    """Result rows of pages that have ranks; the others are start lists."""
    ranked = rows.groupBy("race_id").agg(F.max(F.col("rank").isNotNull()).alias("done")).where("done").select("race_id")
    return rows.join(ranked, "race_id", "left_semi")


class RacePage:
    """A table function for SQL: the rows of a page, with its header. A page that can't be parsed gives one row with the reason.

    ``SELECT p.race_id, r.* FROM pages p, LATERAL race_page(p.html) r`` once it is registered.
    """

    columns = ", ".join([*HEADER.split(", ")[1:], ENTRY, "error string"])

    def eval(self, html: str | None):
        try:
            p = _Page()
            p.feed(html or "")
            p.close()
            rows = [{"competitor_id": competitor} | r for competitor, cells in p.rows if (r := classify_cells(cells))]
        except Exception as e:  # noqa: BLE001
            yield (None,) * (4 + len(_ENTRY)) + (f"{type(e).__name__}: {e}",)
            return
        head = (p.header.get("kind"), p.header.get("place") or p.header.get("name"), p.header.get("subtitle"), p.date)
        for r in rows:
            yield (*head, *(r[c] for c in _ENTRY), None)


def register(spark: SparkSession) -> None:
    """Make ``race_page`` known to the session's SQL."""
    spark.udtf.register("race_page", F.udtf(RacePage, returnType=RacePage.columns))
