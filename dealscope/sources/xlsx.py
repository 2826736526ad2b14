"""Links from XLSX workbooks: (path, row_number, url) of the first http cell of each row of the first sheet."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_NS = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _runs(node: ElementTree.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{{{_NS['s']}}}t"))


def sheet_links(data: bytes) -> list[tuple[int, str]]:
    """Row numbers and urls; the heading row is skipped, shared and inline texts are put together from their runs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_runs(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("s:si", _NS)] if "xl/sharedStrings.xml" in names else []
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    found = []
    for place, row in enumerate(sheet.iterfind(".//s:row", _NS), 1):
        number = int(row.get("r", place))
        if number == 1:
            continue
        for cell in row.findall("s:c", _NS):
            kind, value = cell.get("t"), cell.findtext("s:v", "", _NS)
            if kind == "inlineStr":
                text = _runs(cell.find("s:is", _NS))
            elif kind == "s":
                text = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
            else:
                text = value
            if text.strip().startswith(("http://", "https://")):
                found.append((number, text.strip()))
                break
    return found


def read_xlsx_links(spark: SparkSession, path: str) -> DataFrame:
    """One row a link; workbooks are read in parallel, one a task's row."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, u) for p, c in zip(pdf["path"], pdf["content"], strict=True) for n, u in sheet_links(c)]
            yield pd.DataFrame(rows, columns=["path", "row_number", "url"])

    return files.mapInPandas(run, "path string, row_number int, url string")
