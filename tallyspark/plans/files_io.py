"""Queries of sources, sinks and streams: tables written as the files that users have, and read back by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyspark.operators import tagging as t
from tallyspark.operators.shared import shared_folder
from tallyspark.plans.common import dbl, money, query, table
from tallyspark.sources import files, sinks
from tallyspark.streaming.upsert import Buckets, Snapshots, memory_step, stream_into, stream_snapshots, upsert, upsert_counts


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM customer WHERE c_custkey % 4 <> 0""")
def csv_rows(spark, sf):
    """A headed CSV with every column text; rows whose required column is blank go."""
    path = shared_folder(spark, "csv")
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, " -- ").otherwise(F.col("c_name")).alias("c_name"), money("c_acctbal").alias("balance"))
    c.write.option("header", True).csv(path)
    out = files.read_csv(spark, path, required="c_name")
    if {f.dataType.simpleString() for f in out.schema} != {"string"}:
        raise ValueError("columns must be text")
    return out.withColumn("balance", dbl("balance"))


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS a FROM lineitem)
SELECT CAST(i AS INTEGER) AS row_idx, CAST(l_orderkey AS VARCHAR) AS k, 'part "' || l_partkey || '",' || chr(10) || 'next line' AS name, CAST(a AS DOUBLE) AS amount, '' AS last FROM l""")
def grid_csv_rows(spark, sf):
    """Headless CSV files with quotes, separators and line breaks inside cells, one file for each order."""
    path = shared_folder(spark, "grid")
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(',"part ""'), F.col("l_partkey").cast("string"), F.lit('"",\nnext line",'), money("l_extendedprice").cast("string"), F.lit(","))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice", line.alias("line")).alias("r"))
    text = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("value"))
    text.select("value").repartition(8).write.option("lineSep", "\x00").text(path)  # several orders in a file, each to its end mark
    whole = spark.read.text(path, lineSep="\x00").withColumn("f", F.monotonically_increasing_id())
    cells = files.grid_cells(whole.select(F.col("f").alias("file"), "value"))
    c = lambda k: F.get("cells", F.lit(k))
    return cells.select("row_idx", c(0).alias("k"), c(1).alias("name"), dbl(c(2)).alias("amount"), c(3).alias("last"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) - 1 AS s, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS i FROM orders)
SELECT 'customer ' || o_custkey || '.xlsx' AS file, CAST(s AS INTEGER) AS sheet_idx, 'status <' || o_orderstatus || '>' AS sheet, CAST(i AS INTEGER) AS row_idx, CAST(o_orderkey AS VARCHAR) AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM x
UNION ALL SELECT DISTINCT 'customer ' || o_custkey || '.xlsx', CAST(s AS INTEGER), 'status <' || o_orderstatus || '>', 0, 'Key & "name"', NULL FROM x""")
def workbook_sheets(spark, sf):
    """A workbook for each customer with a sheet for each status, written as archives and read back sheet by sheet."""
    o = table(spark, sf, "orders")
    by = Window.partitionBy("o_custkey")
    rows = o.select("o_custkey", "o_orderstatus", (F.dense_rank().over(by.orderBy("o_orderstatus")) - 1).alias("sheet_idx"), F.row_number().over(Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")).alias("row_idx"), F.array(F.col("o_orderkey").cast("string"), F.lit(None), money("o_totalprice").cast("string")).alias("cells"))
    heads = rows.where("row_idx = 1").withColumns({"row_idx": F.lit(0), "cells": F.array(F.lit('Key & "name"'), F.lit(None), F.lit(None))})
    grid = rows.unionByName(heads).select(F.concat(F.lit("customer "), "o_custkey", F.lit(".xlsx")).alias("file"), "sheet_idx", F.concat(F.lit("status <"), "o_orderstatus", F.lit(">")).alias("sheet"), "row_idx", "cells")
    path = shared_folder(spark, "books")
    sinks.workbooks(grid).write.parquet(path)
    c = lambda k: F.get("cells", F.lit(k))
    return files.workbook_grid(spark.read.parquet(path)).select("file", "sheet_idx", "sheet", "row_idx", c(0).alias("k"), dbl(c(2)).alias("amount"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%b %Y') AS period, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderkey % 3 <> 0""")
def file_periods(spark, sf):
    """Periods of file names that begin with a day; names that don't have none."""
    name = F.when(F.col("o_orderkey") % 3 == 0, "statement.pdf").otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-x.txt")))
    out = files.with_file_period(table(spark, sf, "orders").select("o_orderkey", name.alias("file")))
    return out.where("period is not null").select("o_orderkey", "period", "year")


@query("""SELECT 'period=' || o_orderpriority AS period, count(*) AS n, CAST(sum(o_orderkey) AS DOUBLE) AS keys FROM orders GROUP BY 1""")
def folder_periods(spark, sf):
    """Text lines below folders, with the folder's name as period."""
    path = shared_folder(spark, "folders")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderpriority").alias("period"))
    o.write.partitionBy("period").text(path)
    out = files.read_folders(spark, path).where("text <> ''")
    return out.groupBy(F.url_decode("period").alias("period")).agg(F.count("*").alias("n"), F.sum(F.col("text").cast("double")).alias("keys"))


@query("""SELECT o_orderpriority AS list_id, count(*) AS cards, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders GROUP BY 1""")
def board_cards(spark, sf):
    """Boards as JSON documents: a board's lists and cards come out as tables."""
    path = shared_folder(spark, "boards")
    o = table(spark, sf, "orders")
    cards = o.groupBy((F.col("o_orderkey") % 50).alias("b")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("idList"), (F.col("o_orderstatus") == "F").alias("closed"))).alias("cards"), F.transform(F.collect_set("o_orderpriority"), lambda x: F.struct(x.alias("id"), x.alias("name"), F.lit(1.0).alias("pos"))).alias("lists"))
    cards.select("lists", "cards").repartition(50, "cards").write.option("maxRecordsPerFile", 1).json(path)
    _, got = files.read_board(spark, path)
    return got.groupBy("list_id").agg(F.count("*").alias("cards"), F.count_if("closed").alias("closed"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS vendor_name, 'Fuel' AS tag, CASE WHEN s_suppkey % 2 = 0 THEN 'claude' ELSE 'preparer' END AS source FROM supplier WHERE s_suppkey % 5 <> 0""")
def memory_rows(spark, sf):
    """A vendor memory with headers in other cases and spaces; blank rows go; the old source name is read as the new one."""
    path = shared_folder(spark, "memory")
    s = table(spark, sf, "supplier")
    blank = F.col("s_suppkey") % 5 == 0
    rows = s.select(F.when(~blank, F.col("s_suppkey").cast("string")).alias("Vendor_Name "), F.when(~blank, "Fuel").alias("TAG"), F.when(~blank, F.when(F.col("s_suppkey") % 2 == 0, "auto").otherwise("preparer")).alias(" source"))
    rows.write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    return files.read_memory(spark, path).select("vendor_name", "tag", "source")


@query("""SELECT 'lookup' AS kind, 'tag ' || (s_suppkey % 13) AS value, CASE WHEN s_suppkey % 13 % 2 = 0 THEN 'sub' END AS subcategory FROM supplier GROUP BY ALL UNION ALL SELECT 'warning', 'no known header', 'bad' UNION ALL SELECT 'warning', 'no sheet named like lookup', 'none'""")
def vocabulary_tabs(spark, sf):
    """The vocabulary of the first sheet named lookup; workbooks without one or without a known header give a warning."""
    s = table(spark, sf, "supplier").select(F.lit("good").alias("file"), F.lit(1).alias("sheet_idx"), F.lit("My Lookup").alias("sheet"), F.col("s_suppkey").cast("int").alias("row_idx"), F.array(F.lit("x"), F.concat(F.lit(" tag "), (F.col("s_suppkey") % 13).cast("string")), F.when(F.col("s_suppkey") % 13 % 2 == 0, "sub").otherwise("--")).alias("cells")).withColumn("row_idx", F.col("row_idx") + 1)
    other = spark.createDataFrame([("good", 0, "Data", 0, ["tag"]), ("good", 0, "Data", 1, ["no"]), ("good", 1, "My Lookup", 0, ["id", " Tag", "Sub Category"]), ("good", 2, "lookup 2", 0, ["tag"]), ("good", 2, "lookup 2", 1, ["no"]), ("bad", 0, "lookup", 0, ["q"]), ("none", 0, "Data", 0, ["tag"])], s.schema)
    grid = s.unionByName(other)
    values = files.vocabulary_tab(grid, ["category", "tag"], sub_synonyms=["subcategory", "sub category"])
    warnings = files.vocabulary_warnings(grid, ["category", "tag"])
    return values.select(F.lit("lookup").alias("kind"), "value", "subcategory").unionByName(warnings.select(F.lit("warning").alias("kind"), F.col("warning").alias("value"), F.col("file").alias("subcategory")))


@query("""SELECT n_nationkey AS priority, n_name AS pattern FROM nation WHERE n_regionkey = 2""")
def locale_rules(spark, sf):
    """The rules of one locale of a table of JSON lines."""
    path = shared_folder(spark, "rules")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("priority"), F.col("n_name").alias("pattern"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("locale")).write.json(path)
    return files.read_rules(spark, path, "r2").select("priority", "pattern")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 7 < 3 AND o_orderkey > 5""")
def report_rows(spark, sf):
    """Rows below a report's head with a real date, a category and an amount; the others go."""
    k = F.col("o_orderkey")
    cells = F.array(F.lit(""), F.when(k % 7 == 3, "soon").otherwise("01/02/2025"), F.when(k % 7 == 4, " -- ").otherwise("cat"), F.when(k % 7 == 5, "n/a").when(k % 7 == 6, "abc").otherwise("$5.00"))
    grid = table(spark, sf, "orders").select("o_orderkey", F.least(k, F.lit(1000)).cast("int").alias("row_idx"), cells.alias("cells"))
    return files.report_rows(grid, 1, 2, 3, skip=6).select("o_orderkey")


@query("""SELECT 'ORDER ' || o_orderkey AS "Desc", CASE WHEN o_orderkey % 5 = 0 THEN 'Various' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS "Date Acquired", strftime(o_orderdate, '%m/%d/%Y') AS "Date Sold", CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'S' END AS "Type", CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS "Proceeds", -100.5 AS "Cost", CAST(2184.79 AS DOUBLE) AS "Fed Tax Withheld" FROM orders""")
def tax_import(spark, sf):
    """Lots written as the tax-import table with its fixed columns, and read back."""
    path = shared_folder(spark, "tax")
    o = table(spark, sf, "orders")
    lots = o.select(F.concat(F.lit(" ORDER "), F.col("o_orderkey").cast("string")).alias("description"), F.when(F.col("o_orderkey") % 5 == 0, "VARIOUS").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_acquired"), F.date_format("o_orderdate", "M/d/yyyy").alias("date_sold"), F.concat(F.lit("$"), F.format_number(money("o_totalprice"), 2), F.lit(" ")).alias("proceeds"), F.lit("(100.50)").alias("cost"), F.when(F.col("o_orderkey") % 2 == 0, "Long-term").otherwise("short").alias("type"), F.lit("2,184.79 W").alias("fed_tax_withheld"))
    sinks.write_tax_table(sinks.tax_table(lots), path)
    back = files.read_csv(spark, path)
    if back.columns != [*sinks.TAX_COLUMNS, "Fed Tax Withheld"]:
        raise ValueError("the columns of the tax table have changed")
    return back.select("Desc", "Date Acquired", "Date Sold", "Type", *[dbl(F.col(f"`{c}`")).alias(c) for c in ("Proceeds", "Cost", "Fed Tax Withheld")])


@query("""SELECT CAST(year(o_orderdate) AS VARCHAR) AS folder, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def outputs_by_period(spark, sf):
    """One folder for each period, with its first day as a sort key."""
    path = shared_folder(spark, "by-period")
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "MMM yyyy").alias("period"), money("o_totalprice").alias("a"))
    sinks.write_by(o, path, "period", period=True)
    back = spark.read.parquet(path)
    return back.groupBy(F.year("period_start").cast("string").alias("folder")).agg(F.count("*").alias("n"), dbl(F.sum("a")).alias("total"))


@query("""WITH r AS (SELECT o_orderkey % 4 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders) SELECT 'Matches' AS output, count(*) FILTER (k < 2) + 2 AS n, CAST(2 * sum(a) FILTER (k < 2) AS DOUBLE) AS total FROM r UNION ALL SELECT 'Near', count(*) FILTER (k = 2), CAST(sum(a) FILTER (k = 2) AS DOUBLE) FROM r""")
def category_files(spark, sf):
    """Matches with a total row for each category, and near misses, as outputs of their own; an empty one isn't written."""
    path = shared_folder(spark, "categories")
    o = table(spark, sf, "orders").select(F.concat(F.lit("c"), (F.col("o_orderkey") % 4).cast("string")).alias("category"), money("o_totalprice").alias("a"))
    made = sinks.category_outputs(o.where("category < 'c2'"), o.where("category = 'c2'"), "a") | {"Empty": o.where("category = 'zz'")}
    done = sinks.write_outputs(made, path, skip_empty=("Empty",))
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("output"), "a") for name in done]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("output").agg(F.count("*").alias("n"), dbl(F.sum("a")).alias("total"))


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Personal - ATM' WHEN o_orderkey % 3 = 1 THEN 'Fuel' ELSE 'Review with Client' END AS tag, CASE WHEN o_orderkey % 3 = 2 THEN 'rwc' ELSE 'preparer' END AS s FROM orders)
SELECT 'Tagged' AS output, count(*) AS n FROM a UNION ALL SELECT 'Personal', count(*) FILTER (starts_with(tag, 'Personal -')) FROM a UNION ALL SELECT 'Review with Client', count(*) FILTER (s = 'rwc') FROM a UNION ALL SELECT 'Summary', count(DISTINCT tag) FROM a""")
def tagged_files(spark, sf):
    """The named outputs of a tagged file."""
    path = shared_folder(spark, "tagged")
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k == 0, "Personal - ATM").when(k == 1, "Fuel").otherwise(t.REVIEW).alias("tag"), F.when(k == 2, "rwc").otherwise("preparer").alias("tag_source"))
    done = sinks.write_outputs(t.split_outputs(rows, rows.groupBy("tag").count()), path)
    out = None
    for name in done:
        part = spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("output"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE 'old' END AS tag FROM supplier""")
def memory_merge(spark, sf):
    """Old and new entries of a memory: of a vendor the last entry of the later batch stays."""
    s = table(spark, sf, "supplier").select("s_suppkey")
    old = s.withColumn("tag", F.lit("old")).withColumn("at", F.lit(9))
    new = s.where("s_suppkey % 2 = 0").withColumn("tag", F.explode(F.array(F.lit("older"), F.lit("new")))).withColumn("at", F.when(F.col("tag") == "new", 2).otherwise(1))
    return sinks.merged_memory(old, new, ["s_suppkey"], ["at"]).select("s_suppkey", "tag")


@query("""WITH r AS (SELECT s_suppkey AS k, unnest(['a', 'b', 'c']) AS m FROM supplier), o AS (SELECT k, m, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 5.0 ELSE 1.0 END AS v FROM r WHERE m <> 'c' OR k % 2 = 0)
SELECT k, m, v FROM (SELECT k, m, CASE WHEN m = 'a' THEN v ELSE CASE WHEN k % 3 = 1 AND m = 'b' THEN 7.0 WHEN m = 'b' THEN 1.0 ELSE NULL END END AS v FROM o) WHERE v IS NOT NULL""")
def reading_upserts(spark, sf):
    """A batch over a table of readings: values update and insert, nulls delete, unknown metrics are ignored, the last of a key counts."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    current = s.select("k", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("m")).where("m = 'a' or k % 3 <> 1").withColumn("v", F.lit(1.0)).withColumn("at", F.lit(0))
    a = s.where("k % 3 < 2").select("k", F.lit("a").alias("m"), F.when(F.col("k") % 3 == 1, 5.0).alias("v"), F.lit(2).alias("at"))
    first = a.withColumn("v", F.lit(99.0)).withColumn("at", F.lit(1))
    b = s.where("k % 3 = 1").select("k", F.lit("b").alias("m"), F.lit(7.0).alias("v"), F.lit(1).alias("at"))
    c = s.where("k % 2 = 0").select("k", F.lit("c").alias("m"), F.lit(3.0).alias("v"), F.lit(1).alias("at"))
    known = spark.createDataFrame([("a",), ("b",)], "m string")
    return upsert(current, a.unionByName(first).unionByName(b).unionByName(c), ["k", "m"], "v", "at", ["at"], known).select("k", "m", "v")


@query("""SELECT count(*) FILTER (s_suppkey % 3 = 1) AS saved, count(*) FILTER (s_suppkey % 3 = 0 AND s_suppkey % 2 = 0) AS removed FROM supplier""")
def upsert_report(spark, sf):
    """What a batch saves and removes; deleting what isn't there removes nothing, unknown metrics count for nothing."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    current = s.where("k % 2 = 0").select("k", F.lit("a").alias("m"), F.lit(1.0).alias("v"))
    batch = s.select("k", F.when(F.col("k") % 3 == 2, "zzz").otherwise("a").alias("m"), F.when(F.col("k") % 3 != 0, 5.0).alias("v"), F.lit(1).alias("at"))
    return upsert_counts(current, batch, ["k", "m"], "v", ["at"], spark.createDataFrame([("a",)], "m string"))


def _streamed(rows: DataFrame, state: Buckets, step, path: str) -> DataFrame:
    """The state after a stream of rows, one file a batch, has run twice: the second run finds nothing new."""
    stream = rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for _ in range(2):
        stream_into(stream, state, step, f"{path}/checkpoint").start().awaitTermination()
    return state.read()


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def streamed_upserts(spark, sf):
    """Readings upserted from a stream of eight batches: the last value of each key, whatever the files and batches it came in."""
    path = shared_folder(spark, "stream")
    e = table(spark, sf, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    e.repartition(8).write.parquet(f"{path}/in")
    last = lambda current, batch: upsert(current, batch.join(current.select("user_id", "event_type", F.col("at").alias("_had")), ["user_id", "event_type"], "left").where("_had is null or at > _had").drop("_had"), ["user_id", "event_type"], "value", "at", ["at"])
    state = Buckets(spark, f"{path}/state", "user_id bigint, event_type string, value double, at struct<ts:timestamp,event_id:bigint>", ["user_id", "event_type"], buckets=16)
    return _streamed(e, state, last, path).select("user_id", "event_type", "value")


@query("""SELECT count(*) FILTER (c_custkey % 100 = 0) AS saved, count(*) FILTER (c_custkey % 100 = 50) AS removed, count(*) FILTER (c_custkey % 100 <> 50) AS n, sum(CASE WHEN c_custkey % 100 = 0 THEN 2.0 ELSE 1.0 END) FILTER (c_custkey % 100 <> 50) AS total, true AS only_touched FROM customer""")
def bucketed_upserts(spark, sf):
    """A batch of few keys on a table in buckets: counts observed while it is written, and only buckets with a key of it are new."""
    path = shared_folder(spark, "buckets")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    state = Buckets(spark, f"{path}/state", "k bigint, v double, at int", ["k"], buckets=256)
    state.apply(lambda current, batch: batch, c.select("k", F.lit(1.0).alias("v"), F.lit(0).alias("at")), 0)
    batch = c.where("k % 50 = 0").select("k", F.when(F.col("k") % 100 == 0, 2.0).alias("v"), F.lit(1).alias("at"))
    seen = Observation()
    state.apply(lambda current, b: upsert(current, b, ["k"], "v", "at", ["at"], seen=seen), batch, 1)
    new = spark.createDataFrame([(b,) for b, v in state.held().items() if v == 1], "b int")
    touched = batch.select(state._bucket().alias("b")).distinct()
    more = new.join(touched, "b", "left_anti").agg((F.count("*") == 0).alias("only_touched"))
    out = state.read().agg(F.count("*").alias("n"), F.sum("v").alias("total")).crossJoin(F.broadcast(more))
    return out.select(F.lit(seen.get["saved"]).cast("bigint").alias("saved"), F.lit(seen.get["removed"]).cast("bigint").alias("removed"), "n", "total", "only_touched")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS snapshot_date, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders GROUP BY 1""")
def streamed_snapshots(spark, sf):
    """Snapshots over eight batches, each date in all of them: every file of a date counts. Read again from the start, from
    other files and by another feed they add nothing."""
    path = shared_folder(spark, "snapshots")
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("snapshot_date"))
    o.repartition(8).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for feed in ("first", "first", "second"):
        state = Snapshots(spark, f"{path}/state", "o_orderkey bigint, snapshot_date string", feed)
        stream_snapshots(stream, state, f"{path}/checkpoint-{feed}").start().awaitTermination()
    return state.read().groupBy("snapshot_date").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


@query("""SELECT s_suppkey AS vendor, arg_max('t' || x, x) AS tag FROM (SELECT s_suppkey, unnest([1, 2, 3]) AS x FROM supplier) WHERE x < 3 OR s_suppkey % 2 = 0 GROUP BY 1""")
def streamed_memory(spark, sf):
    """A memory that grows over three runs of four batches: entries of the model and the preparer, the last of each vendor."""
    path = shared_folder(spark, "growing")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("vendor"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("x"))
    rows = s.select("vendor", F.concat(F.lit("t"), F.col("x").cast("string")).alias("tag"), F.when((F.col("x") == 3) & (F.col("vendor") % 2 == 1), "lookup").when(F.col("x") == 1, "claude").otherwise("preparer").alias("source"), "x")
    state = Buckets(spark, f"{path}/state", "vendor bigint, tag string, source string, x int", ["vendor"], buckets=16)
    for run in (1, 2, 3):
        rows.where(F.col("x") == run).repartition(4).write.mode("append").parquet(f"{path}/in")
        out = _streamed(rows, state, memory_step(["vendor"], ["x"]), path)
    return out.select("vendor", "tag")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'given' WHEN 1 THEN 'ACME STOCK ' || p_partkey WHEN 2 THEN 'Some Corp ' || p_partkey END AS description FROM part""")
def inferred_descriptions(spark, sf):
    """A missing description is the first longer text that names a security."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k, F.when(k % 4 == 0, "given").alias("description"), F.when(k % 4 == 1, F.concat(F.lit("ACME STOCK "), k.cast("string"))).when(k % 4 == 3, "a long text of no kind").otherwise("INC").alias("a"), F.when(k % 4 == 2, F.concat(F.lit("Some Corp "), k.cast("string"))).alias("b"))
    return t.infer_description(p, "description", ["a", "b"]).select("p_partkey", "description")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN -5.0 WHEN 1 THEN 7.0 ELSE 0.0 END AS amount, o_orderkey % 2 = 0 AS open FROM orders""")
def signed_and_pending(spark, sf):
    """Debit and credit columns as one signed amount; rows still without a tag."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", F.when(k % 3 == 0, 5.0).alias("d"), F.when(k % 3 == 1, 7.0).alias("c"), F.when(k % 4 == 0, "").when(k % 2 == 1, "Fuel").alias("tag"))
    open_ = t.pending(o).select("o_orderkey", F.lit(True).alias("open"))
    return o.join(open_, "o_orderkey", "left").select("o_orderkey", t.signed_amount(F.col("d"), F.col("c")).alias("amount"), F.coalesce("open", F.lit(False)).alias("open"))
