import io
import zipfile

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyspark.operators import tagging as t
from tallyspark.sources import files, sinks
from tallyspark.streaming.upsert import Buckets, Snapshots, stream_into, stream_snapshots, upsert, upsert_counts


def workbook(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {n} xmlns:r="{r}"><sheets>' + "".join(f'<sheet name="{s}" sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{c}</t></is></c>' for j, c in enumerate(row) if c is not None) + "</row>" for i, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {n}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks_and_vocabulary(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"Data": [["x", None, "y"]], "My Lookup": [["id", "Tag"], ["1", "Fuel"], ["2", "Fuel"], ["3", None]]}))
    g = files.read_workbooks(spark, str(tmp_path))
    assert [(r.sheet_idx, r.sheet, r.row_idx, r.cells) for r in g.orderBy("sheet_idx", "row_idx").collect()][0] == (0, "Data", 0, ["x", None, "y"])
    assert [r[0] for r in files.vocabulary_tab(g, ["category", "tag"]).collect()] == ["Fuel"]


def test_texts(spark, tmp_path):
    (tmp_path / "page-10.txt").write_bytes("z".encode("utf-16"))
    (tmp_path / "page-2.txt").write_text("﻿a\nb")
    rows = files.read_lines(spark, str(tmp_path)).orderBy("order_key", "line_idx").collect()
    assert [(r.file, r.text) for r in rows] == [("page-2.txt", "a"), ("page-2.txt", "b"), ("page-10.txt", "z")]
    d = spark.createDataFrame([("20250131-x.txt",)], "file string")
    assert files.with_file_period(d).first()[1:] == ("Jan 2025", 2025)
    (tmp_path / "g.csv").write_text('a,"b, ""c""",\n1,2\n"x\ny","""q"""\n\nlast')
    assert [r.cells for r in files.read_grid_csv(spark, str(tmp_path / "g.csv")).orderBy("row_idx").collect()] == [["a", 'b, "c"', ""], ["1", "2"], ["x\ny", '"q"'], [""], ["last"]]


def test_tabs_and_memory(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Vendor_Name ,TAG,source\nacme,Fuel,auto\n,,\n")
    got = files.read_memory(spark, str(tmp_path / "m.csv")).collect()
    assert [(r.vendor_name, r.tag, r.source, r.client_id) for r in got] == [("acme", "Fuel", "claude", None)]
    assert files.read_tab(spark, str(tmp_path / "none.csv"), ["a", "b"]).collect() == []


def test_tax_table(spark):
    lots = spark.createDataFrame([("ACME", "1/2/31", "Various", "$1,168.86 ", "(100.50)", "--", "2,184.79 W", "Long-term")], "description string, date_acquired string, date_sold string, proceeds string, cost string, accrued_market_discount string, wash_sale_loss string, type string")
    r = sinks.tax_table(lots).first()
    assert list(r.asDict()) == sinks.TAX_COLUMNS
    assert (r["Date Acquired"], r["Date Sold"], str(r["Proceeds"]), str(r["Cost"]), r["Accrued Discount"], str(r["Wash Sale Loss"]), r["Type"]) == ("01/02/1931", "Various", "1168.86", "-100.50", None, "2184.79", "L")


def test_upsert_and_stream(spark, tmp_path):
    schema = "client string, metric string, value double, recorded_at int"
    current = spark.createDataFrame([("a", "m", 1.0, 1), ("a", "n", 2.0, 1)], schema)
    batch = spark.createDataFrame([("a", "m", 9.0, 2), ("a", "m", 5.0, 3), ("a", "n", None, 2), ("b", "m", 7.0, 2), ("b", "n", None, 2), ("b", "zzz", 1.0, 2)], schema)
    known = spark.createDataFrame([("m",), ("n",)], "metric string")
    out = upsert(current, batch, ["client", "metric"], "value", "recorded_at", ["recorded_at"], known)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "m", 5.0, 3), ("b", "m", 7.0, 2)]
    assert tuple(upsert_counts(current, batch, ["client", "metric"], "value", ["recorded_at"], known).first()) == (2, 1)
    batch.select("client", "metric", "value", "recorded_at").write.parquet(f"{tmp_path}/in")
    state = Buckets(spark, f"file://{tmp_path}/state", schema, ["client", "metric"], buckets=4)
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream_into(stream, state, lambda c, b: upsert(c, b, ["client", "metric"], "value", "recorded_at", ["recorded_at"], known), f"{tmp_path}/cp").start().awaitTermination()
    assert sorted(tuple(r) for r in state.read().collect()) == [("a", "m", 5.0, 3), ("b", "m", 7.0, 2)]


def test_buckets_are_rewritten_where_they_are_touched(spark, tmp_path):
    schema = "k bigint, v double, at int"
    state = Buckets(spark, f"file://{tmp_path}/state", schema, ["k"], buckets=64)
    step = lambda seen: lambda c, b: upsert(c, b, ["k"], "v", "at", ["at"], seen=seen)
    state.apply(step(None), spark.range(1000).selectExpr("id AS k", "1.0D AS v", "0 AS at"), 0)
    before = state.held()
    assert len(before) == 64 and set(before.values()) == {0}
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("data/v=0/**/*.parquet")}
    batch = spark.createDataFrame([(5, 2.0, 1), (6, None, 1), (2000, 3.0, 1), (3000, None, 1)], schema)
    for _ in range(2):  # a replay does the same again
        seen = Observation()
        state.apply(step(seen), batch, 1)
        assert seen.get == {"saved": 2, "removed": 1}
        assert sum(v == 1 for v in state.held().values()) <= 4
        got = {r.k: r.v for r in state.read().collect()}
        assert len(got) == 1000 and got[5] == 2.0 and got[2000] == 3.0 and 6 not in got
    assert all(p.stat().st_mtime_ns == t for p, t in files.items() if p.exists())
    for n in range(2, 7):  # files of buckets that were replaced go
        state.apply(step(None), batch.withColumn("v", F.lit(float(n))), n)
    held = {(v, b) for b, v in state.held().items()}
    there = {(int(p.parent.name[2:]), int(p.name[8:])) for p in tmp_path.glob("state/data/v=*/_bucket=*")}
    assert held <= there and len(there) <= len(held) + 2 * 4 and state.read().count() == 1002
    state.apply(lambda c, b: c.where("false"), spark.range(1000).selectExpr("id AS k", "1.0D AS v", "0 AS at"), 7)
    assert {r.k for r in state.read().collect()} <= {2000, 3000}


def test_snapshots_come_in_several_batches(spark, tmp_path):
    schema = "name string, snapshot_date string"
    rows = [(f"n{i}", f"2025-01-0{1 + i % 2}") for i in range(100)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for feed, checkpoint in (("a", "one"), ("a", "one"), ("b", "two"), ("a", "three")):  # a's batches again, and another feed's
        state = Snapshots(spark, f"file://{tmp_path}/state", schema, feed)
        stream_snapshots(stream, state, f"{tmp_path}/{checkpoint}").start().awaitTermination()
        assert sorted(tuple(r) for r in state.read().collect()) == sorted(rows)
    assert state.dates().count() == 8 and {r.feed for r in state.dates().collect()} == {state.feed}
    later = Snapshots(spark, f"file://{tmp_path}/state", schema, "b")
    later.apply(spark.createDataFrame([("x", "2025-01-02"), ("y", "2025-01-03")], schema), 9)
    assert later.read().count() == 101
    assert Snapshots(spark, f"file://{tmp_path}/none", schema, "a").read().count() == 0


def test_columns_by_hints():
    assert t.find_columns(["Txn Date", "DESCRIPTION", "Withdrawal Amt"], {"date": ["date"], "text": ["description"], "debit": ["debit", "withdrawal"]}) == {"date": "Txn Date", "text": "DESCRIPTION", "debit": "Withdrawal Amt"}
    try:
        t.find_columns(["zz"], {"date": ["date"]})
        raise AssertionError
    except ValueError as e:
        assert "date" in str(e)


def test_vendor_names(spark):
    from tallyspark.functions.vendor import personal_tag, vendor_name

    cases = {"Card Purchase - STARBUCKS SEATTLE WA": "STARBUCKS SEATTLE WA", "Card Purchase 01/15 12:34 #1234 | TARGET STORE | Retail": "TARGET STORE", "ZELLE PAYMENT TO JOHN SMITH REF123456": "Zelle: JOHN SMITH", "ATM WITHDRAWAL AT MAIN ST": "ATM Withdrawal", "CHECK #1042": "Check", "ACH: American Express": "American Express", "OT Crpj ACME TOOLS": "ACME TOOLS", "SERVICE CHARGE 12": "Bank Service Charge"}
    df = spark.createDataFrame([(k,) for k in cases], "d string").select("d", vendor_name(F.col("d")).alias("v"), personal_tag(F.col("d")).alias("p"))
    assert {r.d: r.v for r in df.collect()} == cases


def test_sheets_are_streams_of_bounded_memory(spark, tmp_path):
    import tracemalloc

    rows = [[f"k{i}", None, "a <b> & c", str(i)] for i in range(200_000)]
    content = sinks.workbook_bytes([("small", [["x"]]), ('long "one"', rows)])
    (tmp_path / "b.xlsx").write_bytes(content)
    sheets = list(files.workbook_sheets(content))
    assert [s[:2] for s in sheets] == [(0, "small"), (1, 'long "one"')] and len(sheets[1][2]) < len(content)
    tracemalloc.start()
    n = sum(1 for _ in files.sheet_rows(*sheets[1][2:]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and peak < 8_000_000
    grid = files.read_workbooks(spark, str(tmp_path))
    assert grid.where("sheet_idx = 1").agg(F.count("*"), F.sum("row_idx"), F.sum(F.get("cells", F.lit(3)).cast("bigint"))).first()[:] == (200_000, 19_999_900_000, 19_999_900_000)
    assert grid.where("row_idx = 7 AND sheet_idx = 1").first().cells == ["k7", None, "a <b> & c", "7"]


def test_shared_texts_and_rows_without_places(spark):
    out = io.BytesIO()
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(io.BytesIO(workbook({"S": []}))) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
            z.writestr(name, old.read(name))
        z.writestr("xl/sharedStrings.xml", f"<sst {n}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        z.writestr("xl/worksheets/s0.xml", f'<worksheet {n}><sheetData><row><c t="s"><v>1</v></c><c><v>2.5</v></c></row><row/><row r="9"><c r="AB9" t="s"><v>0</v></c></row><row><c/></row></sheetData></worksheet>')
    books = spark.createDataFrame([("a", bytearray(out.getvalue())), ("b", None)], "file string, content binary")
    got = {r.row_idx: r.cells for r in files.workbook_grid(books).collect()}
    assert got == {0: ["two", "2.5"], 1: [], 8: [None] * 27 + ["one"], 9: [None]}
    assert files.workbook_grid(books.where("false")).count() == 0


def test_small_workbooks_share_a_task_and_its_batches(spark):
    # A call of Python and a frame for each small workbook take longer than making it.
    rows = [(f"f{k}", j, f"s{j}", i, [f"{k}", None, f"{i}"]) for k in range(50) for j in (1, 0) for i in (1, 0)]
    grid = spark.createDataFrame(rows, files.GRID)
    books = sinks.workbooks(grid)
    assert "FlatMapGroups" not in books._jdf.queryExecution().executedPlan().toString()
    got = files.workbook_grid(books).select("file", "sheet_idx", "sheet", "row_idx", "cells").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
