"""``python -m dealscope parse|features|rank|links ...``: the stages from tables to tables."""

from __future__ import annotations

import argparse
import datetime

from dealscope.operators.sets import pending
from dealscope.plans import listings, reports
from dealscope.session import session
from dealscope.sources.sinks import append_new, write_table
from dealscope.sources.tables import read_raw, read_url_list
from dealscope.sources.xlsx import read_xlsx_links


def arguments() -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="dealscope", description=__doc__)
    stages = p.add_subparsers(dest="stage", required=True)
    for name, inputs in {"parse": ["raw"], "features": ["parsed", "raw"], "rank": ["features"], "links": ["list"]}.items():
        s = stages.add_parser(name)
        for i in inputs:
            s.add_argument(f"--{i}", required=True)
        s.add_argument("--output", required=True)
        s.add_argument("--report", action="store_true", help="print the stage's figures")
        if name == "parse":
            s.add_argument("--year", type=int, default=datetime.date.today().year)
        if name == "links":
            s.add_argument("--done", help="table of fetched pages; its ok urls are left out")
            s.add_argument("--start-row", type=int, default=0)
            s.add_argument("--limit", type=int)
    return p.parse_args()


def main() -> None:
    a = arguments()
    spark = session()
    if a.stage == "links":
        links = read_xlsx_links(spark, a.list).selectExpr("row_number as source_row", "url") if a.list.endswith(".xlsx") else read_url_list(spark, a.list)
        links = links.filter(links["source_row"] >= a.start_row)
        if a.done:
            done = spark.read.parquet(a.done)
            links = pending(links, done, "url", done["status"] == "ok")
        append_new(links.orderBy("source_row").limit(a.limit) if a.limit is not None else links, a.output, "url")
        return
    if a.stage == "parse":
        out, report = listings.parsed(read_raw(spark, a.raw), a.year), reports.parse_report
    elif a.stage == "features":
        out, report = listings.featured(spark.read.parquet(a.parsed), read_raw(spark, a.raw)), reports.feature_report
    else:
        out, report = listings.ranked(spark.read.parquet(a.features))[0], reports.ranking_report
    write_table(out, a.output)
    if a.report:
        print("\n".join(reports.as_lines(report(spark.read.parquet(a.output)))))


if __name__ == "__main__":
    main()
