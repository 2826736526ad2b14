import io
import zipfile

from pyspark.sql import functions as F

from dealscope.sources import html, sinks, tables, xlsx
from dealscope.streaming import ingest


def test_csv_with_bom_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿source_row,url,note\n1,http://x/1,"a, ""b""\nc"\n,http://x/2,\n3,,z\n', encoding="utf-8")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["source_row", "url", "note"] and df.first()["note"] == 'a, "b"\nc'
    assert sorted((r[0], r[1]) for r in tables.read_url_list(spark, str(tmp_path / "a.csv")).collect()) == [(1, "http://x/1"), (3, "http://x/2")]


def test_metadata_and_json_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("north: 51.5\nnote: a:b\nplain\n")
    got = {r["key"]: (r["value"], r["number"]) for r in tables.read_metadata(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {"north": ("51.5", 51.5), "note": ("a:b", None)}
    (tmp_path / "j.txt").write_text('{"a": 1}\n\nnot json\n')
    rows = sorted((r["line"], r["data"]["a"] if r["data"] else None) for r in tables.read_json_lines(spark, str(tmp_path / "j.txt"), "a int").collect())
    assert rows == [("not json", None), ('{"a": 1}', 1)]


def book(path, rows, shared=()):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")


def test_xlsx_links(spark, tmp_path):
    rows = (
        '<row r="1"><c t="inlineStr"><is><t>http://heading</t></is></c></row>'
        '<row r="2"><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row>'
        '<row r="4"><c t="inlineStr"><is><r><t>https://</t></r><r><t>y/2</t></r></is></c></row>'
        '<row r="5"><c><v>12</v></c></row>'
    )
    book(tmp_path / "b.xlsx", rows, ["<t>text</t>", "<r><t>http</t></r><r><t>://x/1</t></r>"])
    got = sorted((r[1], r[2]) for r in xlsx.read_xlsx_links(spark, str(tmp_path / "b.xlsx")).collect())
    assert got == [(2, "http://x/1"), (4, "https://y/2")]
    empty = io.BytesIO()
    book(empty, "")
    assert xlsx.sheet_links(empty.getvalue()) == []


def test_div_text_modes():
    page = '<div class="a b">one<br>two <div>in</div> &amp; x</div><p>no</p><div class="b">last'
    assert html.div_text(page, ["b"]) == "one two in & x | last"
    # the void tag holds the first div open, and nothing closes it
    assert html.div_text(page, ["b"], strict=True) == ""
    assert html.div_text('<div class="b">one<br/>two</div>', ["b"], strict=True) == "one two"
    assert html.div_text(None, ["b"]) == ""


def test_fallback_class_and_fetch_rows(spark):
    df = spark.createDataFrame([("u1", '<div class="y">two</div>'), ("u2", None)], "url string, html string")
    assert [r[0] for r in df.select(html.div_text_column("html", ["x"], ["y"])).collect()] == ["two", ""]

    def fetch(u):
        if u == "u2":
            raise OSError("gone")
        return 200, "<html>"

    got = {r["url"]: r for r in html.fetched(df, fetch, lambda: "2026-01-01").collect()}
    assert got["u1"]["status"] == "ok" and got["u1"]["http_status"] == 200
    assert got["u2"]["status"] == "error" and got["u2"]["error"] == "gone" and got["u2"]["http_status"] is None


def test_json_rows_and_payload(spark):
    df = spark.createDataFrame([(1, 'a"b\n', 2.5, None), (2, None, None, True)], "i int, s string, d double, b boolean")
    assert [r[0] for r in sinks.json_rows(df, ["i", "s", "d", "b"]).collect()] == ['[1,"a\\"b\\n",2.5,null]', "[2,null,null,true]"]
    text = sinks.json_payload({"n": 2}, {"k": ["a"]}, sinks.json_rows(df, ["i"]))
    assert text == '{"meta":{"n":2},"k":["a"],"rows":[[1],[2]]}'
    page = sinks.merged_template("__DATA__|__IMAGE__|__BOUNDS__", '"</x"', b"\x01", [1, 2])
    assert page == '"<\\/x"|data:image/png;base64,AQ==|[1, 2]'


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sinks.append_new(df, path, "k") == 2 and sinks.append_new(df, path, "k") == 0
    assert sinks.append_new(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), path, "k") == 1
    assert spark.read.parquet(path).count() == 3


def test_stream_takes_up_where_it_stopped(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([("a",), ("b",), ("a",)], "url string").write.parquet(src)

    def once():
        q = ingest.append_stream(ingest.new_rows(ingest.link_stream(spark, src, "url string"), "url"), out, mark)
        q.awaitTermination(120)

    once()
    spark.createDataFrame([("b",), ("c",)], "url string").write.mode("append").parquet(src)
    once()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    batch = spark.createDataFrame([("2026-01-01 00:10:00", "x"), ("2026-01-01 00:20:00", "x")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert ingest.windowed_counts(batch, "t", "k").first()["n"] == 2


def test_tables_are_overwritten_in_the_order_of_columns(spark, tmp_path):
    from dealscope.session import drop_stored, stored
    from dealscope.sources.sinks import write_table

    df = spark.createDataFrame([(1, ["a", "b"], "x,\"y\"")], "n int, items array<string>, t string")
    for kind in ("parquet", "csv"):
        for _ in range(2):
            write_table(df, f"{tmp_path}/{kind}", ["t", "items", "n"], kind)
    assert spark.read.parquet(f"{tmp_path}/parquet").columns == ["t", "items", "n"]
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv")
    assert [tuple(r) for r in back.collect()] == [('x,"y"', '["a","b"]', "1")]
    drop_stored(spark)
    kept = stored(df, "some")
    assert kept.count() == 1 and drop_stored(spark) == 1 and drop_stored(spark) == 0
