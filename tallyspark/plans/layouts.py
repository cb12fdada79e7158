"""Queries of the broker layouts: line items written as each layout's cell grid, with rows that must be refused, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import grid as g
from tallyspark.operators import lots as lt
from tallyspark.plans.common import dbl, dealt, money, query, table

ITEMS = """l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS k, l_partkey AS part, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_quantity AS DECIMAL(18,2)) AS c, CAST(l_tax AS DECIMAL(18,2)) AS w, strftime(l_shipdate, '%m/%d/%Y') AS acquired, strftime(l_shipdate + INTERVAL 30 DAY, '%m/%d/%Y') AS sold FROM lineitem)"""


def _items(spark, sf) -> DataFrame:
    """(o, rs): the line items of an order in their order, with texts of dates and amounts."""
    li = dealt(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_tax"), "o")
    r = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", F.date_format("l_shipdate", "MM/dd/yyyy").alias("a"), F.date_format(F.date_add("l_shipdate", 30), "MM/dd/yyyy").alias("s"), money("l_extendedprice").cast("string").alias("p"), money("l_quantity").cast("string").alias("c"), money("l_tax").cast("string").alias("w"), (money("l_extendedprice") - money("l_quantity")).cast("string").alias("g"))
    return li.groupBy("o").agg(F.array_sort(F.collect_list(r)).alias("rs")).withColumn("name", F.concat(F.lit("ORDER "), F.col("o").cast("string")))


def _row(*cells: str | Column | None) -> Column:
    return F.array(*[c if isinstance(c, Column) else F.lit(c).cast("string") for c in cells])


def _grid(items: DataFrame, rows: Column) -> DataFrame:
    return items.select(F.col("o").alias("file"), F.lit(0).alias("sheet_idx"), F.lit("s").alias("sheet"), F.posexplode(rows).alias("row_idx", "cells"))


def _read(grid: DataFrame, layout: str) -> DataFrame:
    out = lt.lots(grid, layout)
    return out.select("file", "description", "date_acquired", "date_sold", *[dbl(c).alias(c) for c in ("proceeds", "cost", "wash_sale_loss")])


def _lots_sql(description: str = "'ORDER ' || o", wash: str = "CAST(w AS DOUBLE)", acquired: str = "acquired", cost: str = "CAST(c AS DOUBLE)") -> str:
    return f"WITH {ITEMS} SELECT o AS file, {description} AS description, {acquired} AS date_acquired, sold AS date_sold, CAST(p AS DOUBLE) AS proceeds, {cost} AS cost, {wash} AS wash_sale_loss FROM l"


TOTAL = ("Total", "", "01/01/2020", "01/02/2020", "1", "1", "", "", "1")


@query(_lots_sql("'ORDER ' || o || ' CUSIP: 1'", acquired="CASE WHEN k % 4 = 0 THEN 'Various' ELSE acquired END"))
def lots_morgan_stanley(spark, sf):
    """Amounts in dollars, brackets and with letters; a total row; the description row of an order."""
    items = _items(spark, sf)
    rows = F.transform("rs", lambda r, i: _row("", "10", F.when((i + 1) % 4 == 0, "Various").otherwise(r["a"]), r["s"], F.concat(F.lit("$"), r["p"]), r["c"], "", F.concat(r["w"], F.lit(" W")), r["g"]))
    return _read(_grid(items, F.concat(F.array(_row(F.concat("name", F.lit(" CUSIP: 1")))), rows, F.array(_row(*TOTAL)))), "morgan_stanley")


@query(_lots_sql())
def lots_fidelity(spark, sf):
    """Rows before the first description go; gains that slid left come back before the lots are read."""
    items = _items(spark, sf)
    rows = F.transform("rs", lambda r, i: F.when(i % 2 == 0, _row("Sale", "3", r["a"], r["s"], r["p"], r["c"], "", r["w"], r["g"], "")).otherwise(_row("Sale", "3", "", r["a"], r["s"], r["p"], r["c"], "", r["w"], r["g"])))
    shifted = F.transform(rows, lambda c: F.when(F.get(c, F.lit(2)) == "", F.concat(F.slice(c, 1, 2), F.slice(c, 4, 7), F.array(F.lit("")))).otherwise(c))
    before, total = _row("", "", "01/01/2020", "01/02/2020", "1", "2", "", "", "", ""), _row("Subtotal", "", "01/01/2020", "01/02/2020", "1", "1", "", "", "1", "")
    return _read(_grid(items, F.concat(F.array(before, _row(F.col("name"))), shifted, F.array(total))), "fidelity")


@query(_lots_sql())
def lots_apex_clearing(spark, sf):
    items = _items(spark, sf)
    rows = F.transform("rs", lambda r: _row(r["s"], "1", r["p"], "", r["a"], r["c"], r["w"], r["g"]))
    return _read(_grid(items, F.concat(F.array(_row(F.col("name"), "")), rows, F.array(_row("Totals", "", "10", "", "", "", "", "1"), _row("01/01/2020", "1", "9", "", "", "", "", "no number")))), "apex_clearing")


@query(_lots_sql("'ACME INC COMMON STOCK / CUSIP: ' || o") + " WHERE o % 4 <> 3")
def lots_robinhood(spark, sf):
    """Sheets with three shapes of header: over several rows with columns moved, in one row, with the usual columns; of a fourth kind
    without one nothing is read. Rows before the first name, totals and footers go."""
    items = _items(spark, sf)
    kind = F.col("o") % 4
    moved = lambda r: _row("1", r["s"], "", r["a"], r["p"], r["c"], "x", F.concat(r["w"], F.lit(" W")))
    usual = lambda r: _row(r["s"], "1", F.concat(F.lit("$"), r["p"]), r["a"], r["c"], r["w"], r["g"], "")
    heads = F.when(kind == 0, F.array(_row("1a- Description of property"), _row("", "1c- Date", "", "1b- Date", "1d- Proceeds", "1e- Cost or", "", "1g- Wash"), _row("Quantity", "sold or disposed", "", "acquired", "", "other basis", "", "sale loss"))).when(kind == 1, F.array(_row("1c- Date", "Quantity", "1d- Proceeds", "1b- acquired", "1e- cost basis", "1g- wash sale", "gain", "info"))).when(kind == 2, F.array(_row("title"), _row("date", "quantity", "proceeds reported", "acquired", "cost basis", "", "", "1e-"))).otherwise(F.array(_row("Statement of the year")))
    name = F.concat(F.lit("ACME INC COMMON STOCK / CUSIP: "), F.col("o").cast("string"), F.when(kind == 0, " / Symbol:").otherwise(""))
    one = F.get("rs", F.lit(0))
    last = F.when(kind == 2, F.array(_row("", "", "", "", "", "", "", "5.00"))).otherwise(F.array().cast("array<array<string>>"))
    lots = F.when(kind == 0, F.transform("rs", moved)).when(kind == 2, F.transform("rs", lambda r: _row(r["s"], "1", r["p"], r["a"], "", r["w"], r["g"], r["c"]))).otherwise(F.transform("rs", usual))
    before = F.array(F.when(kind == 0, moved(one)).otherwise(usual(one)))
    rows = F.concat(heads, before, F.array(_row(name)), lots, last, F.array(_row("Security total", "01/01/2020", "5", "01/01/2020", "5", "5"), _row("Totals :", "01/01/2020", "1", "01/01/2020", "5"), _row("01/01/2020", "the IRS determines", "5", "01/01/2020", "5")))
    return _read(_grid(items, rows), "robinhood")


@query(f"""WITH {ITEMS}, f AS (SELECT o, arg_min(sold, k) AS sold1, count(*) AS n FROM l GROUP BY o), d AS (SELECT o, acquired AS acquired2 FROM l WHERE k = 2)
SELECT o AS file, 'ORDER ' || o AS description, CASE WHEN k > 2 THEN acquired2 ELSE acquired END AS date_acquired, sold1 AS date_sold, CAST(p AS DOUBLE) AS proceeds, CASE WHEN k <= 2 THEN CAST(c AS DOUBLE) END AS cost, CAST(NULL AS DOUBLE) AS wash_sale_loss FROM l JOIN f USING (o) LEFT JOIN d USING (o)""")
def lots_pershing(spark, sf):
    """An order's lines in one row: all proceeds, one sale date for all, two dates acquired of which the last repeats, two costs
    of which none does; a description is carried over a sheet's end; rows of other kinds go."""
    items = _items(spark, sf)
    joined = lambda f, n=100: F.array_join(F.transform(F.slice("rs", 1, n), lambda r: r[f]), "\n")
    verb = F.when(F.col("o") % 3 == 0, "LIQUIDATION").when(F.col("o") % 3 == 1, "SELL").otherwise("")
    named = items.select(F.col("o").alias("file"), F.lit(0).alias("sheet_idx"), F.lit("a").alias("sheet"), F.posexplode(F.array(_row("BUY", "2", "01/01/2020", "01/01/2020", "1", "1"), _row(F.concat(F.lit("Description (Box 1a): "), F.col("name"))))).alias("row_idx", "cells"))
    rows = F.array(_row(verb, "2", joined("a", 2), joined("s", 1), joined("p"), joined("c", 2)), _row("Other text", "", "01/01/2020", "01/01/2020", "1.00", ""), _row("", "", "Subtotal", "", "5.00", ""))
    sold = items.select(F.col("o").alias("file"), F.lit(1).alias("sheet_idx"), F.lit("b").alias("sheet"), F.posexplode(rows).alias("row_idx", "cells"))
    return _read(named.unionByName(sold), "pershing")


@query(f"""WITH {ITEMS}, f AS (SELECT o, arg_min(c, k) AS c1, arg_min(sold, k) AS sold1, arg_min(acquired, k) AS acquired1, o % 2 = 0 OR (o % 3 = 0 AND count(*) = 1) AS plain FROM l GROUP BY o),
r AS (SELECT o AS file, CASE WHEN plain THEN 'ORDER ' || o || ' CLASS A' ELSE 'OWN ' || o END AS description, CASE WHEN o % 3 < 2 OR k = 1 THEN acquired END AS date_acquired, CASE WHEN o % 3 <> 1 OR k = 1 THEN sold END AS date_sold, p AS proceeds, c1 AS cost, w AS wash_sale_loss FROM l JOIN f USING (o)
UNION ALL SELECT o, CASE WHEN plain THEN 'ORDER ' || o || ' CLASS A' ELSE 'OWN ' || o END || ' NOTE', acquired1, sold1, 12.50, c1, NULL FROM f)
SELECT file, description, date_acquired, date_sold, CAST(proceeds AS DOUBLE) AS proceeds, CAST(cost AS DOUBLE) AS cost, CAST(wash_sale_loss AS DOUBLE) AS wash_sale_loss FROM r""")
def lots_merrill(spark, sf):
    """A description and its continuation; an order's lines in one row of newline-joined cells, which names the security itself
    in odd orders, with all dates acquired, all dates sold or both (a row without joined dates names none); a plain lot after a text that continues the name; furniture."""
    items = _items(spark, sf)
    joined = lambda f, n=100: F.array_join(F.transform(F.slice("rs", 1, n), lambda r: r[f]), "\n")
    one = lambda f: F.get("rs", F.lit(0))[f]
    few = lambda f, some: F.when(some, joined(f)).otherwise(F.concat(joined(f, 1), F.lit("\n(W)")))
    own = F.when(F.col("o") % 2 == 0, "1.0000\nSale").otherwise(F.concat(F.lit("OWN "), F.col("o").cast("string"), F.lit("\n1.0000 Sale")))
    merged = _row(own, "Sale", few("a", F.col("o") % 3 < 2), few("s", F.col("o") % 3 != 1), joined("p"), joined("c", 1), "", joined("w"))
    rows = F.array(_row("2024 Form 1099-B", "", "x"), _row(F.col("name"), "Sale", "100"), _row("CLASS A", ""), merged, _row("NOTE"), _row("1.0", one("a"), one("s"), "$12.50", one("c"), "", ""), _row("", "Security Subtotal", "01/01/2020", "01/02/2020", "1.00", "1.00"), _row("Page 3 of 9", "", "1.00"))
    return _read(_grid(items, rows), "merrill")


@query(_lots_sql("'ORDER ' || o || ' INC'"))
def lots_charles_schwab(spark, sf):
    """Pairs of rows; both amounts in one cell in every second pair; a total row with a date goes."""
    items = _items(spark, sf)
    pair = lambda r, i: F.array(F.when(i % 2 == 0, _row(F.col("name"), "1", r["a"], F.concat(F.lit("$ "), r["p"], F.lit(" $ "), r["c"]), "", "", "1.00")).otherwise(_row(F.col("name"), "1", r["a"], F.concat(F.lit("$"), r["p"]), r["c"], "", "1.00")), _row("INC", "", r["s"], "", "", r["w"], ""))
    return _read(_grid(items, F.concat(F.flatten(F.transform("rs", pair)), F.array(_row("Total", "1", "01/01/2020", "1", "1", "", "")))), "charles_schwab")


@query(f"""WITH {ITEMS}, n AS (SELECT *, max(k) OVER (PARTITION BY o) AS m FROM l)
SELECT o AS file, CASE k % 4 WHEN 1 THEN CASE WHEN k = 1 THEN 'ORDER ' || o ELSE 'NAME ' || (k - 2) || ' CL A' END
  WHEN 2 THEN 'CALL 50 ' || CASE WHEN k = 2 THEN 'ORDER ' || o ELSE 'NAME ' || (k - 3) || ' CL A' END || ' LOT ' || k || CASE WHEN m > k THEN ' NAME ' || (k + 1) || ' CL A' ELSE '' END
  WHEN 3 THEN 'NAME ' || k || ' CL A' ELSE 'PUT 9 NAME ' || (k - 1) || ' CL A' END AS description,
  acquired AS date_acquired, sold AS date_sold, CAST(p AS DOUBLE) AS proceeds, CAST(c AS DOUBLE) AS cost, CAST(w AS DOUBLE) AS wash_sale_loss FROM n""")
def lots_jpmorgan(spark, sf):
    """By its number a lot has no text, is an option followed by a row of text, names a company over three cells, or is an option
    without more; wash sales are displaced in every third lot; headers, subtotals and totals go."""
    items = _items(spark, sf)

    def lot(r, i):
        k, there = i + 1, i % 3 == 0
        rest = (_row("", "1", r["a"], r["s"], r["p"], r["c"], "", F.when(there, "").otherwise(r["w"]), r["g"], "", "", F.when(there, r["w"]).otherwise("")))
        text = F.when(k % 4 == 1, _row("", "", "")).when(k % 4 == 2, _row("", "CALL 50", "")).when(k % 4 == 3, _row("NAME", k.cast("string"), "CL A")).otherwise(_row("PUT", "9", ""))
        row = F.array(F.concat(text, rest))
        return F.when(k % 4 == 2, F.concat(row, F.array(_row("LOT", k.cast("string"), "", "", "")))).otherwise(row)

    head = F.array(_row("Description", "CUSIP", "", "", "(Box 1a)"), _row("ORDER", F.col("o").cast("string"), "", ""), _row("Column1", "x", "", ""))
    tail = F.array(_row("", "", "", "Subtotals", "", "01/01/2020", "01/02/2020"), _row("Grand total", "", "", "", "", "01/01/2020", "01/02/2020", "1", "1"))
    return _read(_grid(items, F.concat(head, F.flatten(F.transform("rs", lot)), tail)), "jpmorgan")


@query(_lots_sql())
def lots_csv_betterment(spark, sf):
    """A header row and rows without an acquisition date go."""
    items = _items(spark, sf)
    rows = F.transform("rs", lambda r: _row(F.col("name"), "F", "C", r["a"], r["s"], F.concat(F.lit("$"), r["p"], F.lit(" ")), r["c"], "", r["w"], "$0.00 ", "Long-term"))
    return _read(_grid(items, F.concat(F.array(_row("Description", "", "", "Date Acquired", "Date Sold", "Proceeds")), rows, F.array(_row("Fund", "F", "C", "", "01/01/2020", "1", "1", "", "", "", "")))), "csv_betterment")


def _damaged(spark, sf) -> DataFrame:
    """Grids (acquired 2, sold 3, proceeds 4, cost 5, optional 6 and 7, gain 8, tax 9) with one damage in each row by its number:
    1 date acquired one cell left, 2 gain slid left, 3 gain slid left and tax one cell left, 4 the whole row to the right."""
    items = _items(spark, sf)

    def row(r, i):
        kind, gain = i % 5, r["g"]
        one = _row("x", r["a"], "", r["s"], r["p"], r["c"], "", "", gain, "", "5.00")
        two = _row("x", "", r["a"], r["s"], r["p"], r["c"], "", gain, "", "", "5.00")
        three = _row("x", "", r["a"], r["s"], r["p"], r["c"], gain, "", "", "5.00", "")
        four = _row("x", "", r["a"], "", r["s"], r["p"], r["c"], "", "", gain, "", "5.00")
        plain = _row("x", "", r["a"], r["s"], r["p"], r["c"], "", r["w"], gain, "", "5.00")
        return F.when(kind == 1, one).when(kind == 2, two).when(kind == 3, three).when(kind == 4, four).otherwise(plain)

    return _grid(items, F.transform("rs", row))


@query(f"WITH {ITEMS} SELECT o AS file, k - 1 AS row_idx, acquired, sold, CAST(p AS DOUBLE) AS proceeds, CAST(p - c AS DOUBLE) AS gain, 5.0 AS tax, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS \"offset\", k % 5 = 2 AS moved_right, k % 5 IN (3, 4) AS collapsed, k % 5 = 1 AND w <> 0 AS review FROM l")
def grid_realign(spark, sf):
    """Every repair of a grid in one pass, with what it did to each row."""
    fixed, _ = g.realign(_damaged(spark, sf), 3, 5, 8, [6, 7], acquired=2, fed=10)
    c = lambda k: g.cell("cells", k)
    return fixed.select("file", F.col("row_idx").cast("bigint").alias("row_idx"), c(2).alias("acquired"), c(3).alias("sold"), dbl(c(4)).alias("proceeds"), dbl(c(8)).alias("gain"), dbl(c(10)).alias("tax"), "offset", "moved_right", "collapsed", "review")


@query(f"WITH {ITEMS} SELECT o AS file, 's' AS sheet, count(*) FILTER (k % 5 = 0) AS shifted, count(*) FILTER (k % 5 = 2) AS moved_right, count(*) FILTER (k % 5 IN (3, 4)) AS collapsed, count(*) FILTER (k % 5 = 4) AS fed_moved, count(*) FILTER (k % 5 = 1 AND w <> 0) AS review FROM l GROUP BY o")
def grid_realign_log(spark, sf):
    return g.realign(_damaged(spark, sf), 3, 5, 8, [6, 7], acquired=2, fed=10)[1]


FORMATS = [("a", 2, 3, 5, 8, [6, 7], 10), ("b", 5, 6, 8, 11, [9, 10], None), ("c", 1, 2, 4, 6, [5], None)]
DETECTED = "CASE o % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END"


def _mixed(spark, sf) -> DataFrame:
    """Files of three formats: a whole first sheet and a second with one damage in each row by its number (as _damaged has them)."""
    items = _items(spark, sf)

    def row(r, i, lead, optional, damaged):
        kind = i % 5 if damaged else F.lit(0)
        none, text = [F.lit("")] * optional, [F.lit("x")] * (lead - 1)
        cells = lambda *middle: F.array(*text, *middle, *[F.lit("")] * 2)
        plain = cells(F.lit(""), r["a"], r["s"], r["p"], r["c"], *none[1:], r["w"], r["g"])
        one = cells(r["a"], F.lit(""), r["s"], r["p"], r["c"], *none, r["g"])
        two = cells(F.lit(""), r["a"], r["s"], r["p"], r["c"], *none[1:], r["g"], F.lit(""))
        four = cells(F.lit(""), r["a"], F.lit(""), r["s"], r["p"], r["c"], *none, r["g"])
        return F.when(kind == 1, one).when(kind == 2, two).when(kind == 4, four).otherwise(plain)

    def sheet(damaged):
        shape = lambda lead, optional: F.transform("rs", lambda r, i: row(r, i, lead, optional, damaged))
        shapes = [shape(2, 2), shape(5, 2), shape(1, 1)]
        return F.when(F.col("o") % 3 == 0, shapes[0]).when(F.col("o") % 3 == 1, shapes[1]).otherwise(shapes[2])

    part = lambda k, rows: items.select(F.col("o").alias("file"), F.lit(k).alias("sheet_idx"), F.lit(f"s{k}").alias("sheet"), F.posexplode(rows).alias("row_idx", "cells"))
    return part(0, sheet(False)).unionByName(part(1, sheet(True)))


def _formats(spark) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, acquired int, sold int, cost int, gain int, optional array<int>, fed int")


@query(f"WITH {ITEMS} SELECT o AS file, {DETECTED} AS format, k - 1 AS row_idx, acquired, sold, CAST(p AS DOUBLE) AS proceeds, CAST(c AS DOUBLE) AS cost, CAST(p - c AS DOUBLE) AS gain, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS \"offset\", k % 5 = 2 AS moved_right, k % 5 = 3 AS collapsed FROM l")
def grid_realign_detected(spark, sf):
    """One table of files of several formats, each repaired by the positions that its first sheet shows."""
    fixed, _ = g.realign_detected(_mixed(spark, sf), _formats(spark))
    c = lambda n: F.get("cells", F.col(n))
    return fixed.where("sheet_idx = 1").select("file", "format", F.col("row_idx").cast("bigint").alias("row_idx"), c("acquired").alias("acquired"), c("sold").alias("sold"), dbl(F.get("cells", F.col("cost") - 1)).alias("proceeds"), dbl(c("cost")).alias("cost"), dbl(c("gain")).alias("gain"), "offset", "moved_right", "collapsed")


@query(f"WITH {ITEMS} SELECT o AS file, {DETECTED} AS format, CASE o % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 1 END AS date_col, CASE o % 3 WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 4 END AS cost_col, 80 AS score FROM l GROUP BY o")
def detected_anchors(spark, sf):
    """The date and cost columns of each file's first sheet by its cells, and the format that they fit."""
    return g.detected_positions(_mixed(spark, sf), _formats(spark)).select("file", "format", "date_col", "cost_col", "score")


@query(f"""WITH {ITEMS}, x AS (SELECT o, 8 + 1 AS col, count(*) FILTER (k % 5 IN (1, 2, 3)) AS empty, count(*) FILTER (k % 5 = 4) AS "numeric", count(*) AS n, CAST(5 * count(*) FILTER (k % 5 = 4) AS DOUBLE) AS t, CAST(coalesce(sum(abs(p - c)) FILTER (k % 5 = 0), 0) AS DOUBLE) AS g, count(*) FILTER (k % 5 = 0) AS n0 FROM l GROUP BY o)
SELECT o AS file, CAST(col AS INTEGER) AS col, empty, "numeric" + n0 AS "numeric", CAST(0 AS BIGINT) AS text, t + g AS total, CASE WHEN "numeric" + n0 = n THEN 'FULL COL' WHEN "numeric" + n0 > 0 THEN 'PARTIAL SHIFT?' ELSE '' END AS flag FROM x WHERE "numeric" + n0 > 0""")
def right_of_anchor(spark, sf):
    """The column behind the gain, which holds what slid there."""
    out = g.right_of_anchor(_damaged(spark, sf), ["file"], 8, fed=10)
    return out.where("col = 9").select("file", "col", "empty", "numeric", "text", dbl("total").alias("total"), "flag")


@query(f"""WITH {ITEMS}, x AS (SELECT o, k, p, c, w, k % 3 AS m FROM l) SELECT o AS file, count(*) FILTER (m <> 2) AS normal_rows, count(*) FILTER (m = 2) AS shifted_rows, CAST(coalesce(sum(w) FILTER (m = 1), 0) AS DOUBLE) AS normal_wash, CAST(coalesce(sum(p) FILTER (m = 2), 0) AS DOUBLE) AS shifted_accrued, CAST(coalesce(sum(w) FILTER (m = 2), 0) AS DOUBLE) AS shifted_wash, CAST(sum(p) AS DOUBLE) AS proceeds, CAST(sum(c) AS DOUBLE) AS cost, CAST(sum(p - c) AS DOUBLE) AS gain FROM x GROUP BY o""")
def shift_totals(spark, sf):
    """Optional amounts in their place, absent, or displaced behind the gain; the totals of the configured columns."""
    items = _items(spark, sf)

    def row(r, i):
        m = (i + 1) % 3
        return F.when(m == 1, _row("x", r["p"], r["c"], "", r["w"], r["g"], "", "")).when(m == 2, _row("x", r["p"], r["c"], "", "", r["g"], r["p"], F.concat(F.lit("("), r["w"], F.lit(")")))).otherwise(_row("x", r["p"], r["c"], "", "", r["g"], "text", ""))

    grid = _grid(items, F.transform("rs", row))
    shifts = g.shift_totals(grid, ["file"], 2, 5, ["accrued", "wash"])
    money_ = g.financial_totals(grid, ["file"], 2, 5, ["accrued", "wash"])
    both = shifts.drop("normal_accrued").join(money_.select("file", "proceeds", "cost", "gain"), "file")
    return both.select("file", "normal_rows", "shifted_rows", *[dbl(c).alias(c) for c in ("normal_wash", "shifted_accrued", "shifted_wash", "proceeds", "cost", "gain")])


@query(f"""WITH {ITEMS} SELECT o AS file, count(*) AS n_rows, count(*) FILTER (k % 4 = 0) AS empty_acquired, count(*) FILTER (k % 3 = 0) AS empty_sold, count(*) FILTER (k % 5 = 0) AS empty_proceeds FROM l GROUP BY o""")
def null_rates(spark, sf):
    r = _items(spark, sf).select(F.col("o").alias("file"), F.posexplode("rs").alias("i", "r")).withColumn("k", F.col("i") + 1)
    lots = r.select("file", F.when(F.col("k") % 4 == 0, " nan ").otherwise(F.col("r.a")).alias("acquired"), F.when(F.col("k") % 3 != 0, F.col("r.s")).alias("sold"), F.when(F.col("k") % 5 == 0, "None").otherwise(F.col("r.p")).alias("proceeds"))
    return g.null_rates(lots, ["file"], ["acquired", "sold", "proceeds"])


@query(f"""WITH {ITEMS} SELECT o AS file, 'ORDER ' || o AS "Description", acquired AS "Date Acquired", CAST(p AS DOUBLE) AS "Proceeds", CAST(c AS DOUBLE) AS "Cost" FROM l""")
def headed_by_position(spark, sf):
    """Sheets with an exact header row, with one found by its words, and without any, whose columns get default names."""
    items = _items(spark, sf)
    rows = F.transform("rs", lambda r: F.when(F.col("o") % 3 == 0, _row(r["p"], F.col("name"), r["a"], r["c"])).otherwise(_row(F.col("name"), r["a"], r["p"], r["c"])))
    header = F.when(F.col("o") % 3 == 0, F.array(_row("junk"), _row("Proceeds", "Description", " Date Acquired", "Cost"))).when(F.col("o") % 3 == 1, F.array(_row("Description", "Date acquired", "Proceeds", "Cost"))).otherwise(F.array().cast("array<array<string>>"))
    out = g.named_columns(_grid(items, F.concat(header, rows)), ["file", "sheet_idx"], ["description", "date acquired"], ["proceeds", "description", "date acquired", "cost"], ["Description", "Date Acquired", "Proceeds", "Cost"])
    return out.select("file", "Description", "`Date Acquired`", dbl("Proceeds").alias("Proceeds"), dbl("Cost").alias("Cost"))


@query(f"""WITH {ITEMS}, s AS (SELECT o % 20 AS f, o, k, p, c FROM l) SELECT f AS file, coalesce(CAST(o AS VARCHAR), 'Grand Total') AS "Month", count(*) AS n_rows, CAST(sum(p) AS DOUBLE) AS "Amount", CAST(sum(c) AS DOUBLE) AS "Col3" FROM s GROUP BY f, ROLLUP (o)""")
def collation_recon(spark, sf):
    """Sheets of one file collated under the first header found: rows and sums of each sheet and in all."""
    items = _items(spark, sf)
    first = F.array(_row("Name", "Amount", "Col3"))
    rows = F.concat(F.when(F.col("o") % 2 == 0, first).otherwise(F.array().cast("array<array<string>>")), F.transform("rs", lambda r: _row("x1", F.concat(F.lit("$"), r["p"]), r["c"])))
    grid = items.select((F.col("o") % 20).alias("file"), F.col("o").alias("sheet_idx"), F.col("o").cast("string").alias("sheet"), F.posexplode(rows).alias("row_idx", "cells"))
    body = g.collate_headed(grid, ["file"], 3)
    out = g.collation_recon(body, ["file"], {"c1": "Amount", "c2": "Col3"})
    return out.select("file", "Month", "n_rows", dbl("Amount").alias("Amount"), dbl("Col3").alias("Col3"))


@query("""SELECT c_custkey, c_custkey % 3 = 0 AS is_header FROM customer""")
def header_rows(spark, sf):
    """Rows without a number are headers; blank rows and rows with one number aren't."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, _row("Name", "", "Balance ($)", "7th")).when(F.col("c_custkey") % 3 == 1, _row("Name", "$1,000.50", "x")).otherwise(_row("", None, " ")).alias("cells"))
    return c.select("c_custkey", g.is_header(F.col("cells")).alias("is_header"))
