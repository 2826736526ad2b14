"""Text of the div elements of given classes, coordinates and outcome rows of fetched pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dealscope.functions.text import latitude, longitude

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(("br", "p", "li", "tr", "div"))


class _Divs(HTMLParser):
    """Collects target divs; ``strict`` lets void tags inside a target hold it open."""

    def __init__(self, wanted: frozenset[str], strict: bool):
        super().__init__(convert_charrefs=True)
        self.wanted, self.strict = wanted, strict
        self.level, self.run, self.found = 0, [], []

    def handle_starttag(self, tag, attrs):
        if not self.level:
            if tag == "div" and self.wanted & set((dict(attrs).get("class") or "").split()):
                self.level, self.run = 1, []
            return
        if tag in _BREAKS:
            self.run.append(" ")
        if self.strict or tag == "div":
            self.level += 1

    def handle_startendtag(self, tag, attrs):
        if self.level and tag in _BREAKS:
            self.run.append(" ")

    def handle_endtag(self, tag):
        if not self.level:
            return
        if tag in _BREAKS:
            self.run.append(" ")
        if self.strict or tag == "div":
            self.level -= 1
            if not self.level:
                self._close()

    def handle_data(self, data):
        if self.level:
            self.run.append(data)

    def _close(self):
        if text := " ".join("".join(self.run).split()):
            self.found.append(text)

    def end(self) -> str:
        self.close()
        if self.level and not self.strict:
            self._close()
        return " | ".join(self.found)


def div_text(page: str | None, classes: Sequence[str], strict: bool = False) -> str:
    """Texts of the divs that have one of the classes, joined by " | ".

    With ``strict`` every tag inside a target counts, also void ones, which nothing
    closes; a target that is never closed then gives nothing.
    """
    parser = _Divs(frozenset(classes), strict)
    parser.feed(page or "")
    return parser.end()


def div_text_column(html: Column | str, classes: Sequence[str], fallback: Sequence[str] = (), strict: bool = False) -> Column:
    """div_text of a column; the fallback classes where the first give nothing."""
    first, second = tuple(classes), tuple(fallback)

    @pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: div_text(p, first, strict) or (div_text(p, second, strict) if second else ""))

    return run(html)


def listing_rows(pages: DataFrame, advert: Sequence[str], parameters: Sequence[str], fallback: Sequence[str] = (), url: str = "url", html: str = "html") -> DataFrame:
    """A row of text, parameters and coordinates for each fetched page."""
    return pages.select(F.col(url), div_text_column(html, advert).alias("advert_info"), div_text_column(html, parameters, fallback).alias("parameters"), latitude(html).alias("lat"), longitude(html).alias("lon"))


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str]], now: Callable[[], str], url: str = "url") -> DataFrame:
    """Outcome rows of a fetch function: status ok or error, code, page, time, message; it never raises for a page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u in pdf[url]:
                try:
                    code, page = fetch(u)
                    rows.append((u, "ok", code, page, now(), ""))
                except Exception as e:  # each page's failure is a row
                    rows.append((u, "error", getattr(e, "code", None), None, now(), str(e)))
            yield pd.DataFrame(rows, columns=["url", "status", "http_status", "html", "fetched_at", "error"]).astype({"http_status": "Int64"})

    return urls.select(url).mapInPandas(run, "url string, status string, http_status int, html string, fetched_at string, error string")
