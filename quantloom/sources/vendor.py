"""Files of vendors and saved pages: one price file a ticker with a coverage report, and tables of HTML pages.

Files are listed and read by Spark, from any file system that it knows, and parsed where they are read: a file is a row of a
``binaryFile`` scan.  What can't be used becomes a row with an error, so one bad file fails no job.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import clean_ticker, valid_ticker

PRICES = ("open", "high", "low", "close", "volume")
_ROWS = "ticker string, date date, open double, high double, low double, close double, volume double, error string"
#: Failed tickers that a report lists.
LISTED = 80


def normalised(raw: pd.DataFrame) -> pd.DataFrame:
    """date and prices of one ticker's rows: names in lower case, adj_close for an absent close, the last row of a day, close above 0, volume at least 0; raises ValueError where nothing is left."""
    raw = raw.rename(columns={c: str(c).strip().lower().replace(" ", "_") for c in raw.columns})
    if "close" not in raw.columns and "adj_close" in raw.columns:
        raw = raw.assign(close=raw["adj_close"])
    lacking = sorted({"date", *PRICES} - set(raw.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    out = raw[["date", *PRICES]].copy()
    # A time zone is dropped, not converted: the vendor's day is the exchange's.
    out["date"] = pd.to_datetime(out["date"].astype(str).str.slice(0, 10), errors="coerce")
    for c in PRICES:
        out[c] = pd.to_numeric(out[c], errors="coerce")
    out = out.dropna(subset=["date"]).drop_duplicates("date", keep="last").dropna(subset=["close"])
    out = out[(out["close"] > 0) & (out["volume"] >= 0)].sort_values("date")
    if out.empty:
        raise ValueError("no usable rows")
    return out.assign(date=out["date"].dt.date)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            ticker = re.sub(r"\.[A-Za-z]+$", "", path.rsplit("/", 1)[-1])
            try:
                rows = normalised(pd.read_csv(io.BytesIO(content))).assign(ticker=ticker, error=None)
            except Exception as error:  # the file's row says why
                rows = pd.DataFrame([{"ticker": ticker, "error": f"{type(error).__name__}: {error}"}])
            rows = rows.reindex(columns=["ticker", "date", *PRICES, "error"])
            yield rows.astype({"date": object}).assign(date=lambda r: r["date"].where(r["date"].notna(), None))


def vendor_prices(spark: SparkSession, folder: str, requested: DataFrame, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(panel, report) of the requested tickers (column ticker) from ``<folder>/<ticker>.csv``.

    The report has a row a requested ticker: status (read, failed, absent), n_rows, first, last, error; a range that leaves nothing of a file
    is a failure; Spark lists no file without a byte, so that is absent.  Files that nobody asked for are not read.
    """
    wanted = requested.select("ticker").distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    files = files.withColumn("ticker", F.regexp_extract("path", r"([^/]+)\.csv$", 1)).join(wanted, "ticker", "left_semi").select("path", "content")
    rows = files.mapInPandas(_parsed, _ROWS)
    inside = F.lit(True)
    if start:
        inside = inside & (F.col("date") >= F.lit(start).cast("date"))
    if end:
        inside = inside & (F.col("date") <= F.lit(end).cast("date"))
    good = F.col("error").isNull() & inside
    panel = rows.where(good).select("ticker", "date", *PRICES)
    found = rows.groupBy("ticker").agg(F.count_if(good).alias("n_rows"), F.min(F.when(good, F.col("date"))).alias("first"), F.max(F.when(good, F.col("date"))).alias("last"), F.first("error", True).alias("error"))
    report = wanted.join(found, "ticker", "left")
    status = F.when(F.col("n_rows").isNull(), "absent").when(F.col("n_rows") > 0, "read").otherwise("failed")
    error = F.when(F.col("n_rows") == 0, F.coalesce("error", F.lit("no rows in the range")))
    return panel, report.select("ticker", status.alias("status"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "first", "last", error.alias("error"))


def coverage(report: DataFrame) -> DataFrame:
    """One row: n_requested, n_read, n_failed, coverage and the first failed tickers in order."""
    failed = F.col("status") != "read"
    names = F.slice(F.array_sort(F.collect_list(F.when(failed, F.col("ticker")))), 1, LISTED)
    n = F.count("*")
    return report.agg(n.alias("n_requested"), F.count_if(~failed).alias("n_read"), F.count_if(failed).alias("n_failed"), F.round(F.count_if(~failed) / F.greatest(n, F.lit(1)), 4).alias("coverage"), names.alias("failed_tickers"))


# --- tables of saved pages -------------------------------------------------------------------------


class _Tables(HTMLParser):
    """Tables of a page as rows of (text, is header, columns, rows) cells; an inner table is one of its own."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[tuple]]] = []
        self.open: list[int] = []
        self.cell: list | None = None
        self.cells: list = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.cells.append(self.cell)
            self.cell = None
            self.open.append(len(self.tables))
            self.tables.append([])
        elif self.open and tag == "tr":
            self._end()
            self.tables[self.open[-1]].append([])
        elif self.open and tag in ("td", "th"):
            self._end()
            if not self.tables[self.open[-1]]:
                self.tables[self.open[-1]].append([])
            span = lambda k: int(v) if (v := (dict(attrs).get(k) or "1").strip()).isdigit() else 1
            self.cell = [[], tag == "th", max(1, min(span("colspan"), 1000)), span("rowspan")]
        elif self.cell is not None and tag == "br":
            self.cell[0].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr"):
            self._end()
        elif self.open and tag == "table":
            self._end()
            self.open.pop()
            self.cell = self.cells.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell[0].append(data)

    def _end(self) -> None:
        if self.cell is not None and self.open:
            text, header, columns, rows = self.cell
            self.tables[self.open[-1]][-1].append((" ".join("".join(text).split()), header, columns, rows))
            self.cell = None


def table_grids(page: str) -> list[tuple[list[str], list[list[str | None]]]]:
    """(column names, rows) of every table: cells fill all rows and columns that they span; names of several header rows are joined by ``_``, repeated parts once."""
    parser = _Tables()
    parser.feed(page)
    parser.close()
    out = []
    for table in parser.tables:
        grid: list[list[str | None]] = []
        heads: list[bool] = []
        down: dict[int, tuple[int, str]] = {}  # column: rows that its cell still covers, text
        for row in table:
            line: list[str | None] = []
            after: dict[int, tuple[int, str]] = {}
            cells = iter(row)
            while True:
                at = len(line)
                if at in down:
                    left, text = down[at]
                    line.append(text)
                    if left > 1:
                        after[at] = left - 1, text
                    continue
                cell = next(cells, None)
                if cell is None:
                    if any(k > at for k in down):
                        line.append(None)
                        continue
                    break
                text, _, columns, rows = cell
                for _ in range(columns):
                    if rows > 1 or rows == 0:  # 0: to the table's end
                        after[len(line)] = (rows or len(table)) - 1, text
                    line.append(text)
            down = after
            grid.append(line)
            heads.append(bool(row) and all(c[1] for c in row))
        top = next((i for i, h in enumerate(heads) if not h), len(heads))
        width = max((len(r) for r in grid), default=0)
        grid = [r + [None] * (width - len(r)) for r in grid]
        names = []
        for k in range(width):
            parts = []
            for r in grid[:top]:
                if r[k] and (not parts or parts[-1] != r[k]):
                    parts.append(r[k])
            names.append("_".join(parts) or str(k))
        out.append((names, grid[top:]))
    return out


def page_tables(spark: SparkSession, path: str) -> DataFrame:
    """page, table, row and cells (column name to text) of the tables of saved pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(page, t, i, {n: c for n, c in zip(names, row, strict=True) if c is not None}) for t, (names, grid) in enumerate(table_grids(content.decode("utf-8", "replace"))) for i, row in enumerate(grid)]
                yield pd.DataFrame(rows, columns=["page", "table", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "page string, table int, row int, cells map<string,string>")


def _cell(*parts: str) -> F.Column:
    """The value of the first column (by name) whose name has all these parts."""
    names = F.array_sort(F.filter(F.map_keys("cells"), lambda k: F.forall(F.array(*map(F.lit, parts)), lambda p: F.contains(k, p))))
    return F.when(F.size(names) > 0, F.element_at(F.col("cells"), F.element_at(names, 1)))


#: Tickers that are written otherwise.
FIXES = {"BRK.B": "BRK-B", "BF.B": "BF-B", "BF.A": "BF-A", "LEN.B": "LEN-B"}


def constituents(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, changes) from a page whose first table lists members (Symbol, Security, GICS Sector) and whose second has changes (Date, Added and Removed tickers).

    Dates that can't be read drop their change; a change's ticker that is none is null.
    """
    current = tables.where("table = 0").select(clean_ticker("symbol").alias("ticker"), "name", "sector") if "symbol" in tables.columns else tables.where("table = 0").select(_cell("Symbol").alias("symbol"), _cell("Security").alias("name"), _cell("GICS Sector").alias("sector")).select(clean_ticker("symbol").alias("ticker"), "name", "sector")
    raw = tables.where("table = 1").select(_cell("Date").alias("day"), _cell("Added", "Ticker").alias("added"), _cell("Removed", "Ticker").alias("removed"))
    day = F.coalesce(*[F.try_to_timestamp("day", F.lit(form)).cast("date") for form in ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "d MMMM yyyy")])
    known = lambda c: F.when(valid_ticker("_t"), F.col("_t")).alias(c)
    rows = raw.select(day.alias("date"), "added", "removed").where("date is not null")
    for c in ("added", "removed"):
        rows = rows.withColumn("_t", clean_ticker(c)).withColumn(c, known(c)).drop("_t")
    return current.where("ticker is not null and ticker <> ''"), rows
