"""HTML without third-party parsers: articles, span-expanded tables, directories, timetables.

A page is parsed in one pass of the standard library's parser inside an Arrow UDF; nothing here
is executed or fetched. Tables become grids: a cell with spans fills every place it covers, and
cells that overlap are an error of the table.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "cite", "code", "em", "font", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u"}
_SILENT = {"script", "style", "noscript", "template"}
_HEADING = re.compile(r"h([1-6])$")
TIME = re.compile(r"\b(?:[01]?\d|2[0-9]):[0-5]\d\b")


class Page(HTMLParser):
    """Title, language, text by section, links and tables of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.links = "", None, []
        self.sections: list[dict] = [{"path": [], "text": []}]
        self.tables: list[list[list[dict]]] = []
        self._open: list[str] = []
        self._table: list[list[list[dict]]] = []
        self._cell: list[dict | None] = []
        self._heading: list[str] | None = None
        self._path: list[tuple[int, str]] = []
        self._quiet = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang")
        if tag in _SILENT:
            self._quiet += 1
        if tag == "a" and "href" in a:
            self.links.append(a["href"])
        if tag == "table":
            self._table.append([])
            self._cell.append(None)
        elif self._table and tag == "tr":
            self._table[-1].append([])
            self._cell[-1] = None
        elif self._table and tag in ("td", "th"):
            if not self._table[-1]:
                self._table[-1].append([])
            cell = {"text": "", "rows": span(a.get("rowspan")), "cols": span(a.get("colspan")), "head": tag == "th", "style": a.get("style", "")}
            self._table[-1][-1].append(cell)
            self._cell[-1] = cell
        if m := _HEADING.match(tag):
            self._heading = []
            self._level = int(m[1])
        if tag not in _INLINE and not self._quiet:
            self._part()
        if tag not in _VOID:
            self._open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self._quiet:
            self._quiet -= 1
        if tag == "table" and self._table:
            self.tables.append(self._table.pop())
            self._cell.pop()
        elif tag in ("td", "th") and self._cell:
            self._cell[-1] = None
        if _HEADING.match(tag) and self._heading is not None:
            name = " ".join("".join(self._heading).split())
            self._path = [p for p in self._path if p[0] < self._level] + [(self._level, name)]
            self.sections.append({"path": [p[1] for p in self._path], "text": []})
            self._heading = None
        if tag not in _INLINE and not self._quiet:
            self._part()
        if tag in self._open:
            while self._open.pop() != tag:
                pass

    def _part(self) -> None:
        """Blocks part words."""
        if self._heading is not None:
            self._heading.append(" ")
        elif self._cell and self._cell[-1] is not None:
            self._cell[-1]["text"] += " "
        else:
            self.sections[-1]["text"].append(" ")

    def handle_data(self, data: str) -> None:
        if self._quiet:
            return
        if self._open and self._open[-1] == "title":
            self.title += data
            return
        if self._heading is not None:
            self._heading.append(data)
            return
        if self._cell and self._cell[-1] is not None:
            self._cell[-1]["text"] += data
        elif not self._table:
            self.sections[-1]["text"].append(data)


def span(value: str | None) -> int:
    """First number of a span attribute, repaired: damaged or missing is 1, at most 999."""
    m = re.search(r"\d{1,3}", value or "")
    return max(1, int(m[0])) if m else 1


def grid(rows: list[list[dict]]) -> tuple[list[list[str]] | None, str | None]:
    """(grid of texts, error): every place of the table with the text of the cell that covers it."""
    out: list[dict[int, str]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while c in out[r]:
                c += 1
            text = " ".join(cell["text"].split())
            for dr in range(cell["rows"]):
                if r + dr >= len(out):
                    break
                for dc in range(cell["cols"]):
                    if c + dc in out[r + dr]:
                        return None, f"cells overlap at row {r + dr + 1}, column {c + dc + 1}"
                    out[r + dr][c + dc] = text
            c += cell["cols"]
    width = max((max(x) + 1 for x in out if x), default=0)
    return [[x.get(i, "") for i in range(width)] for x in out], None


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    while page._table:
        page.tables.append(page._table.pop())
    return page


_ARTICLE = "lang string, title string, n_html int, links array<string>, sections array<struct<path:array<string>,text:string>>, tables array<struct<grid:array<array<string>>,error:string>>, times array<string>"


def articles(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, lang, title, n_html, links, sections, tables, times) of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, raw in zip(frame[key], frame[html]):
                p = parse(raw)
                sections = [{"path": s["path"], "text": " ".join("".join(s["text"]).split())} for s in p.sections]
                tables = [dict(zip(("grid", "error"), grid(x))) for x in p.tables]
                body = " ".join(s["text"] for s in sections)
                rows.append({key: k, "lang": p.lang, "title": " ".join(p.title.split()), "n_html": len(raw or ""), "links": p.links, "sections": [s for s in sections if s["path"] or s["text"]], "tables": tables, "times": TIME.findall(body)})
            yield pd.DataFrame(rows, columns=[key, "lang", "title", "n_html", "links", "sections", "tables", "times"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, {_ARTICLE}")


def infobox(articles_: DataFrame, key: str) -> DataFrame:
    """(key, field, value) of two-column tables."""
    rows = articles_.select(key, F.explode("tables").alias("t")).where("t.error is null").select(key, F.explode("t.grid").alias("r"))
    return rows.where("size(r) = 2 and r[0] <> '' and r[0] <> r[1]").select(key, F.col("r")[0].alias("field"), F.col("r")[1].alias("value"))


def directory(articles_: DataFrame, key: str, header: str = "route") -> DataFrame:
    """(key, route, cells): rows of tables that have a column headed `header`, in any case."""
    tables = articles_.select(key, F.explode("tables").alias("t")).where("t.error is null and size(t.grid) > 1").select(key, F.col("t.grid").alias("g"))
    at = F.array_position(F.transform(F.col("g")[0], lambda x: F.lower(F.trim(x))), F.lit(header.lower()))
    located = tables.withColumn("at", at.cast("int")).where("at > 0")
    rows = located.select(key, "at", F.explode(F.slice("g", F.lit(2), F.size("g") - 1)).alias("r"))
    return rows.select(key, F.element_at("r", F.col("at")).alias("route"), F.col("r").alias("cells")).where("route <> ''")


def six_cell_headways(articles_: DataFrame, key: str) -> DataFrame:
    """(key, line, numbers): rows of six cells with the numbers of each."""
    rows = articles_.select(key, F.explode("tables").alias("t")).where("t.error is null").select(key, F.explode("t.grid").alias("r")).where("size(r) = 6")
    numbers = F.flatten(F.transform(F.slice("r", 2, 5), lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))))
    return rows.select(key, F.col("r")[0].alias("line"), numbers.alias("numbers")).where(F.size("numbers") > 0)


def first_last(rows: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, start_s, end_s): first and last trains, the last one past midnight when it is earlier."""
    from waymesh.functions.clock import DAY, seconds

    a, b = seconds(F.col(first), seconds_optional=True), seconds(F.col(last), seconds_optional=True)
    return rows.select(key, a.alias("start_s"), F.when(b < a, b + DAY).otherwise(b).alias("end_s"))


def timetable(grid_rows: list[list[str]]) -> list[dict]:
    """A bus timetable grid as groups (direction, day, minute list or bands) with an error of each group.

    Columns are headed by a direction, rows begin with a day rule; a cell holds clocks or an
    interval. Clocks that step back other than once over midnight refuse their group.
    """
    if len(grid_rows) < 2:
        return []
    heads, out = grid_rows[0][1:], []
    for row in grid_rows[1:]:
        for direction, cell in zip(heads, row[1:]):
            clocks = [int(h) * 3600 + int(m) * 60 for h, m in re.findall(r"(\d{1,2}):(\d{2})", cell)]
            shift, last, times, error = 0, None, [], None
            for v in clocks:
                if last is not None and v + shift < last:
                    if shift == 0 and last % 86_400 >= 64_800 and v < 21_600:
                        shift = 86_400
                    else:
                        error = "clocks run back"
                last = v + shift
                times.append(last)
            minutes = re.findall(r"\d+(?:\.\d+)?", cell) if not clocks else []
            if not clocks and not minutes and cell:
                error = "unread cell"
            if cell:
                out.append({"direction": direction, "day": row[0], "times": sorted(set(times)) if clocks and not error else None, "minutes": [float(m) for m in minutes] or None, "error": error})
    return out


def timetables(articles_: DataFrame, key: str) -> DataFrame:
    """(key, direction, day, times, minutes, error) of every table of every article."""
    grids = articles_.select(key, F.explode("tables").alias("t")).where("t.error is null").select(key, F.col("t.grid").alias("g"))
    kind = articles_.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{key: k, **x} for k, g in zip(frame[key], frame["g"]) for x in timetable([list(r) for r in g])]
            yield pd.DataFrame(rows, columns=[key, "direction", "day", "times", "minutes", "error"])

    return grids.mapInPandas(run, f"{key} {kind}, direction string, day string, times array<int>, minutes array<double>, error string")
