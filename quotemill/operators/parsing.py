"""Vendor payloads as columns: fundamentals, score responses, dated headline tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the payloads.
NEWS_TABLE, DATE_WIDTH, TITLE_CLASS, DATE_CHARS = "news-table", "130", "tab-link-news", 9

_TEXTS = {
    "type": "General.Type", "exchange": "General.Exchange", "country": "General.AddressData.Country", "city": "General.AddressData.City",
    "gic_industry": "General.GicIndustry", "gic_sector": "General.GicSector", "ipo_date": "General.IPODate",
}
_NUMBERS = {"insiders_ownership_perc": "SharesStats.PercentInsiders", "institutional_ownership_perc": "SharesStats.PercentInstitutions", "shares_float": "SharesStats.SharesFloat", "beta": "Technicals.Beta"}


def _first_with(officers: Column, role: str) -> Column:
    """Name of the first officer whose title contains ``role``."""
    return F.get(F.filter(officers, lambda o: F.upper(o["Title"]).contains(role)), F.lit(0))["Name"]


def fundamentals(raw: DataFrame, json_col: str = "raw", caps_col: str = "caps") -> DataFrame:
    """Fields of a fundamentals JSON and of its market caps (sorted ``array<struct<date, value>>``; of equal
    dates the last entry holds). Sections that are missing or ``"NA"`` give NULLs, as do malformed payloads."""
    doc = F.col(json_col)
    out = {n: F.get_json_object(doc, f"$.{p}") for n, p in _TEXTS.items()}
    out |= {n: F.get_json_object(doc, f"$.{p}").try_cast("double") for n, p in _NUMBERS.items()}
    officers = F.map_values(F.from_json(F.get_json_object(doc, "$.General.Officers"), "map<string, struct<Name string, Title string>>"))
    out |= {"ceo_name": _first_with(officers, "CEO"), "cfo_name": _first_with(officers, "CFO")}
    entries = F.map_values(F.from_json(F.col(caps_col), "map<string, struct<date string, value string>>"))
    dated = F.transform(entries, lambda e, i: F.struct(e["date"].try_cast("date").alias("date"), (-i).alias("late"), e["value"].try_cast("double").alias("value")))
    caps = F.array_sort(F.filter(dated, lambda e: e["date"].isNotNull() & e["value"].isNotNull()))
    last = raw.withColumns(out).withColumn("_caps", caps)
    first = F.filter("_caps", lambda e, i: (i == 0) | (F.get("_caps", i - 1)["date"] != e["date"]))
    return last.withColumn("historical_market_cap", F.transform(first, lambda e: F.struct(e["date"].alias("date"), e["value"].alias("value")))).drop("_caps")


def parse_scores(response: Column, headlines: Column) -> Column:
    """``array<struct<idx int, confidence int>>`` of what stands between the first bracket of a response and the one that closes
    it, read as JSON: entries whose index is one of ``headlines`` and whose confidence lies in 0 to 100. NULL where there is
    no array or no valid entry. Entries are flat: a bracket within one ends the array."""
    opened = F.substring_index(F.substring(response, F.locate("[", response), F.length(response)), "]", 1)
    found = F.from_json(F.when(F.contains(response, F.lit("[")), F.concat(opened, F.lit("]"))), "array<struct<idx int, confidence double>>")
    valid = F.filter(found, lambda e: e["idx"].between(0, headlines - 1) & e["confidence"].between(0, 100))
    return F.when(F.size(valid) > 0, F.transform(valid, lambda e: F.struct(e["idx"].alias("idx"), e["confidence"].cast("int").alias("confidence"))))


class _Rows(HTMLParser):
    """``[date cell, title]`` for each row of the news table."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth, self.into, self.ended = 0, None, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table" and not self.ended and (self.depth or a.get("id") == NEWS_TABLE):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append(["", ""])
        elif self.rows and self.depth and tag == "td" and a.get("width") == DATE_WIDTH:
            self.into = 0
        elif self.rows and self.depth and tag == "a" and TITLE_CLASS in (a.get("class") or "").split():
            self.into = 1

    def handle_endtag(self, tag):
        if tag == ("td", "a")[self.into or 0] or tag == "tr":
            self.into = None
        if tag == "table" and self.depth:
            self.depth -= 1
            self.ended = not self.depth

    def handle_data(self, data):
        if self.into is not None and self.depth:
            self.rows[-1][self.into] += data


def page_headlines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, pos, date, title``: headlines of each page's news table with the last date cell seen above them
    (text that starts with a letter, such as ``Jan-02-24``). Pages without the table or text give no rows."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page, html in zip(f[id_col], f[html_col], strict=True):
                p = _Rows()
                p.feed(html or "")
                out += [(page, i, d.strip(), t.strip()) for i, (d, t) in enumerate(p.rows)]
            yield pd.DataFrame(out, columns=["id", "pos", "cell", "title"])

    rows = pages.select(id_col, html_col).filter(F.col(html_col).contains(NEWS_TABLE) & F.col(id_col).isNotNull())
    rows = rows.mapInPandas(extract, "id long, pos int, cell string, title string")
    cell = F.when(F.col("cell").rlike(r"^\p{L}"), F.trim(F.substring("cell", 1, DATE_CHARS)))
    date = F.last(cell, ignorenulls=True).over(Window.partitionBy("id").orderBy("pos"))
    return rows.withColumn("date", date).filter("title <> ''").select(F.col("id").alias(id_col), "pos", "date", "title")
