"""Queries that damage clean tables as messy sources do and read them back, and queries of the grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as x
from tallyspark.operators import grid as g
from tallyspark.operators import order as o
from tallyspark.operators import summary as s
from tallyspark.operators import tagging as t
from tallyspark.plans.common import dbl, money, query, table


def _dollars(c):
    """$1,234.56 for even keys, (1234.56) for negative amounts, 1234.56 W for every seventh."""
    return F.when(c < 0, F.concat(F.lit("("), F.abs(c).cast("string"), F.lit(")"))).when(F.col("o_orderkey") % 7 == 0, F.concat(c.cast("string"), F.lit(" W"))).otherwise(F.concat(F.lit("$"), F.format_number(c, 2)))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END AS DOUBLE) END AS amount FROM orders""")
def money_roundtrip(spark, sf):
    """Amounts as texts of several kinds; texts that are no amount give null."""
    o_ = table(spark, sf, "orders").withColumn("a", F.expr("cast(cast(o_totalprice as decimal(18,2)) * if(o_orderkey % 5 = 0, -1, 1) as decimal(18,2))"))
    odd = F.get(F.array(*map(F.lit, ["abc", "12/34", "--", " nan ", "1.2.3", "$", "12-34", "(1", "x1"])), (F.col("o_orderkey") % 9).cast("int"))
    texts = o_.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, odd).otherwise(_dollars(F.col("a"))).alias("t"))
    return texts.select("o_orderkey", dbl(x.parse_money(F.col("t"))).alias("amount"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%m/%d/%Y') AS text FROM orders""")
def date_roundtrip(spark, sf):
    o_ = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    kinds = [F.date_format("d", f) for f in ("M/d/yyyy", "MM-dd-yyyy", "yyyy-MM-dd", "MMM d, yyyy", "M/d/yy")] + [F.datediff("d", F.lit("1899-12-30").cast("date")).cast("string")]
    texts = o_.select("o_orderkey", F.get(F.array(*kinds), (F.col("o_orderkey") % len(kinds)).cast("int")).alias("t"))
    return texts.select("o_orderkey", x.parse_date(F.col("t")).cast("string").alias("day"), x.date_text(F.col("t")).alias("text"))


def _grid(spark, sf):
    """Line items as rows of cells: part, '', '', date acquired, date sold, proceeds, cost, '', '', gain."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", money("l_extendedprice").alias("p"), money("l_quantity").alias("c"))
    day = F.date_format("l_shipdate", "MM/dd/yyyy")
    text = lambda c: F.col(c).cast("string")
    return li.withColumn("cells", F.array(text("l_partkey"), F.lit(""), day, day, text("p"), text("c"), F.lit(""), F.lit(""), (F.col("p") - F.col("c")).cast("string")))


KEYS = "l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS part"


@query(f"""SELECT {KEYS}, strftime(l_shipdate, '%m/%d/%Y') AS sold, CAST(l_extendedprice AS DOUBLE) AS proceeds, CAST(l_partkey % 3 AS INTEGER) AS "offset" FROM lineitem""")
def grid_right_shift(spark, sf):
    """Cells moved right by the key modulo 3 come back."""
    off = (F.col("l_partkey") % 3).cast("int")
    shifted = _grid(spark, sf).withColumn("cells", F.concat(F.slice("cells", 1, 2), F.array_repeat(F.lit(""), off), F.slice("cells", 3, 20)))
    fixed = g.shift_left(shifted, 2)
    return fixed.select("l_orderkey", "l_linenumber", F.trim(g.cell("cells", 0)).alias("part"), g.cell("cells", 3).alias("sold"), dbl(g.cell("cells", 4)).alias("proceeds"), "offset")


@query(f"""SELECT {KEYS}, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) AS gain, l_partkey % 2 = 0 AS collapsed FROM lineitem""")
def grid_collapse(spark, sf):
    """Gains that slid left behind the cost come back."""
    gain = g.cell("cells", 8)
    damaged = _grid(spark, sf).withColumn("cells", F.when(F.col("l_partkey") % 2 == 0, F.concat(F.slice("cells", 1, 6), F.array(gain, F.lit(""), F.lit("")))).otherwise(F.col("cells")))
    fixed = g.collapse_gain(damaged, 5, 8)
    return fixed.select("l_orderkey", "l_linenumber", g.cell("cells", 0).alias("part"), dbl(g.cell("cells", 8)).alias("gain"), "collapsed")


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS part, strftime(l_shipdate, '%m/%d/%Y') AS sold, CAST(l_extendedprice AS DOUBLE) AS proceeds FROM lineitem) SELECT l_orderkey, CAST(part AS INTEGER) AS part, sold, proceeds FROM l""")
def multi_value_explode(spark, sf):
    """Line items of an order merged to one row of newline-joined cells come apart."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").alias("r"))
    merged = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    cells = merged.select("l_orderkey", F.size("rs").alias("n"), F.array_join(F.transform("rs", lambda r: F.date_format(r["l_shipdate"], "MM/dd/yyyy")), "\n").alias("sold"), F.array_join(F.transform("rs", lambda r: money(r["l_extendedprice"]).cast("string")), "\n").alias("proceeds"))
    out = g.explode_multi(cells, ["sold", "proceeds"], F.col("n"))
    return out.select("l_orderkey", "part", "sold", dbl("proceeds").alias("proceeds"))


@query("""WITH c AS (SELECT c_custkey % 5 AS sheet, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)]) AS v, unnest([0, 1, 2, 3]) AS col FROM customer)
SELECT sheet, col, round(avg(CASE WHEN regexp_full_match(v, '-?[0-9.]+') THEN 1.0 ELSE 0 END), 4) AS "numeric", CASE WHEN col IN (0, 3) THEN 'numeric' ELSE 'text' END AS dominant FROM c GROUP BY ALL""")
def profile_columns(spark, sf):
    c = table(spark, sf, "customer")
    grid = c.select((F.col("c_custkey") % 5).alias("sheet"), F.col("c_custkey").alias("row_idx"), F.array(F.concat(F.lit("$"), F.col("c_custkey").cast("string")), "c_name", "c_mktsegment", money("c_acctbal").cast("string")).alias("cells"))
    return g.profile_columns(grid, ["sheet"]).select("sheet", "col", "numeric", "dominant")


@query("""SELECT CASE l_partkey % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'single' WHEN 2 THEN 'header' WHEN 3 THEN 'other' ELSE 'transaction' END AS kind, count(*) AS n FROM lineitem GROUP BY 1""")
def row_classes(spark, sf):
    """Rows of every class, among them a date with one number and headers with two words only."""
    none, k = F.lit(None).cast("string"), F.col("l_partkey") % 6
    made = F.when(k == 0, F.array(F.lit(" "), none, F.lit("nan"))).when(k == 1, F.array(F.lit(""), F.col("cells")[0])).when(k == 2, F.array(F.lit("Description"), F.lit("Date Acquired"), F.lit("PROCEEDS"), F.lit("x"))).when(k == 3, F.array(F.lit("Description"), F.lit("proceeds"), F.col("cells")[2], F.col("cells")[4])).when(k == 4, F.array(F.col("cells")[2], F.col("cells")[4], F.col("cells")[5])).otherwise(F.col("cells"))
    rows = _grid(spark, sf).withColumn("cells", made).select(g.row_class("cells", ["proceeds", "cost", "acquired", "description"]).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT unnest(['c_custkey', 'c_name', 'c_acctbal', 'day']) AS "column", unnest(['number', 'text', 'number', 'date']) AS type""")
def infer_types(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("#"), F.col("c_custkey").cast("string")).alias("c_custkey"), "c_name", money("c_acctbal").cast("string").alias("c_acctbal"), F.concat(F.lit("1/2/"), (1990 + F.col("c_custkey") % 30).cast("string")).alias("day"))
    c = c.withColumn("c_custkey", F.regexp_replace("c_custkey", "#", ""))
    cols = c.columns
    slashed = {k: F.when(F.col(k).contains("/"), x.parse_date(F.col(k))) for k in cols}
    return s.infer_types(c, cols, {k: x.parse_money(F.col(k)) for k in cols}, slashed)


@query("""SELECT c_custkey, c_name AS "Desc", c_mktsegment AS "Type", CAST(c_acctbal AS DOUBLE) AS "Proceeds" FROM customer""")
def map_columns(spark, sf):
    """Headers with line breaks and other cases, one target named twice."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("ACTION\nName"), F.lit("--").alias("Type "), F.col("c_mktsegment").alias("kind"), money("c_acctbal").cast("string").alias("1d Proceeds"))
    out = t.map_columns(c, [("Action Name", "Desc"), ("kind", "Type"), ("type", "Type"), ("1D proceeds", "Proceeds")], ["Desc", "Type", "Proceeds"], keep=["c_custkey"])
    return out.withColumn("Proceeds", dbl("Proceeds"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT c_custkey, 'Acme ' || c_mktsegment AS vendor, 0.9 AS confidence FROM customer""")
def model_answers(spark, sf):
    """Model answers in fenced JSON, read to rows."""
    c = table(spark, sf, "customer")
    fenced = F.concat(F.lit("```json\n["), F.to_json(F.struct(F.concat(F.lit("Acme "), F.col("c_mktsegment")).alias("vendor"), F.lit("T").alias("tag"), F.lit(0.9).alias("confidence"))), F.lit("]\n```"))
    return c.select("c_custkey", F.explode(x.parse_answers(fenced)).alias("a")).select("c_custkey", "a.vendor", "a.confidence")


@query("""SELECT page_id, CASE WHEN contains(lower(html), '<table') AND contains(lower(html), '<article') THEN 'table' WHEN contains(lower(html), '<article') AND contains(lower(html), 'lang="de"') THEN 'german' WHEN contains(lower(html), '<article') THEN 'article' ELSE 'unknown' END AS format FROM pages""")
def format_detect(spark, sf):
    rules = spark.createDataFrame([(1, "table", ["<table", "<article"]), (2, "german", ["<article", 'lang="de"']), (3, "article", ["<article"])], "priority int, format string, keywords array<string>")
    return t.detect_format(table(spark, sf, "pages"), rules, "page_id", "html")


@query("""WITH n AS (SELECT p_partkey, 'file-' || CAST(p_partkey AS VARCHAR) || '.png' AS name FROM part) SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM n""")
def natural_order(spark, sf):
    """page-2 before page-10: the natural key orders names as their numbers."""
    n = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("file-"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"))
    return o.places(n, x.natural_key(F.col("name")), "place").select("p_partkey", "place")


@query("""WITH l AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS d FROM orders) SELECT o_orderkey, strftime(d, '%b %Y') AS period, strftime(d, '%Y-%m-01') AS first_day FROM l""")
def period_labels(spark, sf):
    o_ = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Statement of "), F.date_format("o_orderdate", "MMMM d, yyyy")).alias("t"))
    label = x.period_label(F.col("t"))
    return o_.select("o_orderkey", label.alias("period"), x.period_order(label).cast("string").alias("first_day"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
n AS (SELECT doc_id, i, CAST(i // 3 + 1 AS INTEGER) AS num, trim(t) = '' AS b FROM l), last AS (SELECT doc_id, num, max(i) AS m FROM n WHERE NOT b OR i % 3 = 0 GROUP BY ALL)
SELECT doc_id, i AS line, num FROM n JOIN last USING (doc_id, num) WHERE i <= m""")
def number_segments(spark, sf):
    """Every third line of a text starts a numbered section."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    lines = lines.withColumn("text", F.when(F.col("line") % 3 == 0, F.concat((F.floor(F.col("line") / 3) + 1).cast("string"), F.lit(". x "), "t")).otherwise(F.regexp_replace("t", r"^(\s*\d)", "x$1")))
    return o.number_segments(lines, "doc_id", "line").select("doc_id", F.col("line").cast("bigint").alias("line"), "num")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS proceeds, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_custkey AS DOUBLE) END AS cost FROM orders""")
def split_pairs(spark, sf):
    """"$ X $ Y" cells, read to two amounts; cells of one amount, and texts."""
    c = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("$ "), money("o_totalprice").cast("string"), F.lit(" $ "), F.col("o_custkey").cast("string"), F.lit(".00")).alias("c"), money("o_totalprice").cast("string").alias("one"))
    c = c.withColumn("c", F.when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("$"), "one")).when(F.col("o_orderkey") % 4 == 3, "text $ more").otherwise(F.col("c")))
    a, b = g.split_pair(F.col("c"))
    return c.select("o_orderkey", dbl(a).alias("proceeds"), dbl(b).alias("cost"))
