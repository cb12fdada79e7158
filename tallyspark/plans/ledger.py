"""Queries of the summaries and reconciliations over orders, lineitem and the dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import measures as fm
from tallyspark.operators import recon as r
from tallyspark.operators import summary as s
from tallyspark.operators import tagging as t
from tallyspark.plans.common import dbl, money, query, table

MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SUMS = ", ".join(f"CAST(sum(CASE WHEN m = {k} THEN a END) AS DOUBLE) AS {m}" for k, m in enumerate(MONTHS, 1))


@query(f"""WITH d AS (SELECT o_orderpriority AS p, o_orderstatus AS st, month(o_orderdate) AS m, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders),
r AS (SELECT p, st, grouping(p, st) AS g, count(DISTINCT st) AS n, {SUMS}, CAST(sum(a) AS DOUBLE) AS total FROM d GROUP BY ROLLUP (p, st))
SELECT CASE WHEN g = 3 THEN 'GRAND TOTAL' ELSE p END AS o_orderpriority, CASE WHEN g = 0 THEN st ELSE '' END AS o_orderstatus, CASE g WHEN 0 THEN 'row' WHEN 1 THEN 'subtotal' ELSE 'total' END AS level, {", ".join(MONTHS)}, total FROM r WHERE g <> 1 OR n > 1""")
def period_rollup(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "MMM").alias("month"), money("o_totalprice").alias("amount"))
    out = s.rollup_by_period(o, "o_orderpriority", "o_orderstatus", "month", MONTHS, "amount")
    return out.select("o_orderpriority", "o_orderstatus", "level", *[dbl(c).alias(c) for c in [*MONTHS, "total"]])


@query("""SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_descriptions, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS proceeds, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS cost, count(*) FILTER (l_discount > 0) AS n_wash FROM lineitem GROUP BY 1""")
def lot_summary(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", money("l_extendedprice").alias("p"), money("l_quantity").alias("c"), "l_discount")
    return s.lot_summary(li, "l_partkey", "p", "c", "l_discount", by=["l_returnflag"]).withColumns({"proceeds": dbl("proceeds"), "cost": dbl("cost")})


@query("""SELECT 'missing column Wash Sale Loss' AS rule, 'error' AS severity, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'rows without values', 'warning', count(*) FILTER (l_discount = 0 AND l_tax = 0) FROM lineitem""")
def lot_validate(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("Desc"), F.expr("if(l_discount = 0, null, l_discount)").alias("Proceeds"), F.expr("if(l_tax = 0, null, l_tax)").alias("Cost"))
    return r.validate(li, ["Desc", "Proceeds", "Cost", "Wash Sale Loss"], ["Desc", "Proceeds"], ["Proceeds", "Cost"]).withColumn("n", F.col("n").cast("bigint"))


FLAGS = ", ".join(f"CAST(sum(CASE WHEN l_returnflag = '{f}' THEN a END) AS DOUBLE) AS {f}" for f in "ANR")
NET = " + ".join(f"coalesce(sum(CASE WHEN l_returnflag = '{f}' THEN a END), 0)" for f in "ANR")


@query(f"""WITH d AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS year, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS a FROM lineitem)
SELECT year, {FLAGS}, CAST({NET} AS DOUBLE) AS Net FROM d GROUP BY year UNION ALL SELECT 'TOTAL', {FLAGS}, CAST({NET} AS DOUBLE) FROM d""")
def section_pivot(spark, sf):
    li = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), "l_returnflag", money("l_extendedprice").alias("a"))
    out = s.section_pivot(li, "year", "l_returnflag", ["A", "N", "R"], "a")
    return out.select("year", *[dbl(c).alias(c) for c in ("A", "N", "R", "Net")])


@query("""WITH d AS (SELECT n_name, c_mktsegment AS g, CAST(c_acctbal AS DECIMAL(18,2)) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT n_name, coalesce(sum(a) FILTER (g = 'BUILDING'), 0) AS b, coalesce(sum(a) FILTER (g = 'MACHINERY'), 0) AS c, coalesce(sum(a) FILTER (g NOT IN ('BUILDING', 'MACHINERY')), 0) AS o FROM d GROUP BY n_name),
x AS (SELECT * FROM m UNION ALL SELECT 'TOTAL', sum(b), sum(c), sum(o) FROM m)
SELECT n_name, CAST(b AS DOUBLE) AS BUILDING, CAST(c AS DOUBLE) AS MACHINERY, CAST(o AS DOUBLE) AS OTHER, CAST(b + c + o AS DOUBLE) AS TOTAL FROM x""")
def matrix(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment", money("c_acctbal").alias("a"))
    out = s.matrix(c, "n_name", "c_mktsegment", ["BUILDING", "MACHINERY"], "a")
    return out.select("n_name", *[dbl(x).alias(x) for x in ("BUILDING", "MACHINERY", "OTHER", "TOTAL")])


@query("""SELECT unnest(['income', 'returns', 'net']) AS figure, unnest([a, -b, a - b]) AS value FROM (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag <> 'R') AS DOUBLE) AS a, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R') AS DOUBLE) AS b FROM lineitem)""")
def key_figures(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("a", F.expr("cast(l_extendedprice as decimal(18,2)) * if(l_returnflag = 'R', -1, 1)"))
    out = s.key_figures(li, {"income": F.col("l_returnflag") != "R", "returns": F.col("l_returnflag") == "R", "net": F.lit(True)}, "a")
    return out.select("figure", dbl("value").alias("value"))


@query("""SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = n_nationkey WHERE n_nationkey NOT IN (3, 7) GROUP BY ALL""")
def counts_with_zero(spark, sf):
    sup = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return s.counts_with_zero(table(spark, sf, "nation").select("n_nationkey", "n_name"), sup, "n_nationkey", [3, 7])


def _parsed_stated(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", money("l_extendedprice").alias("amount"))
    stated = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), money("o_totalprice").alias("total"))
    return li, stated


@query("""WITH p AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS parsed, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey AS l_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS stated FROM orders)
SELECT l_orderkey, CAST(parsed AS DOUBLE) AS parsed, coalesce(n, 0) AS n_rows, CAST(stated AS DOUBLE) AS stated, CAST(stated - coalesce(parsed, 0) AS DOUBLE) AS gap, CASE WHEN stated IS NULL THEN 'N/A' WHEN abs(stated - coalesce(parsed, 0)) > 0.01 THEN 'GAP' ELSE 'MATCH' END AS status FROM p FULL JOIN s USING (l_orderkey)""")
def stated_vs_parsed(spark, sf):
    li, stated = _parsed_stated(spark, sf)
    out = r.stated_vs_parsed(li, stated, ["l_orderkey"], "amount", "total")
    return out.withColumns({c: dbl(c) for c in ("parsed", "stated", "gap")} | {"n_rows": F.coalesce("n_rows", F.lit(0))})


@query("""WITH p AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS parsed FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey AS l_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS stated FROM orders)
SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS description, CAST(l_extendedprice AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS flag FROM lineitem
UNION ALL SELECT l_orderkey, 'MISSING ROWS', CAST(stated - coalesce(parsed, 0) AS DOUBLE), 'VERIFY' FROM p FULL JOIN s USING (l_orderkey) WHERE abs(stated - coalesce(parsed, 0)) > 0.01""")
def sentinel_rows(spark, sf):
    li, stated = _parsed_stated(spark, sf)
    rec = r.stated_vs_parsed(li, stated, ["l_orderkey"], "amount", "total")
    rows = li.select("l_orderkey", F.col("l_linenumber").cast("string").alias("description"), "amount")
    return r.sentinel_rows(rows, rec, ["l_orderkey"], "amount", "description").withColumn("amount", dbl("amount"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS amount FROM lineitem""")
def phantom_row(spark, sf):
    """Every order of an even key gets a copy of its first line as a phantom total row; removing it restores the table."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money("l_extendedprice").alias("amount"))
    first = li.where("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.min_by("amount", F.struct("l_linenumber", "l_partkey", "amount")).alias("amount"))
    damaged = first.select("l_orderkey", F.lit(-1).alias("l_linenumber"), F.lit(-1).cast("bigint").alias("l_partkey"), "amount").unionByName(li)
    stated = li.groupBy("l_orderkey").agg(F.sum("amount").cast("decimal(18,2)").alias("total"))
    rec = r.stated_vs_parsed(damaged, stated, ["l_orderkey"], "amount", "total")
    return r.drop_phantom(damaged, rec, ["l_orderkey"], ["l_linenumber", "l_partkey", "amount"], "amount").select("l_orderkey", "l_linenumber", dbl("amount").alias("amount"))


@query("""SELECT year(l_shipdate) AS year, count(*) AS n, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS parsed_subtracted, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS parsed_added, CAST(sum(CAST(l_tax AS DECIMAL(18,2))) - sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS net, CAST(max(m) AS BIGINT) AS last_month
FROM (SELECT *, month(l_shipdate) AS m FROM lineitem) GROUP BY 1""")
def period_summary(spark, sf):
    li = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"), F.month("l_shipdate").alias("m"), money("l_discount").alias("sub"), money("l_tax").alias("added"))
    stated = li.select("year", "m", F.col("m").alias("stated_subtracted"), F.col("m").alias("stated_added"))
    out = s.period_summary(li, stated, ["year"], "m", "sub", "added")
    return out.select("year", "n", dbl("parsed_subtracted").alias("parsed_subtracted"), dbl("parsed_added").alias("parsed_added"), dbl("net").alias("net"), F.col("stated_added").cast("bigint").alias("last_month"))


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 5 <> 0)
SELECT k, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'matched' WHEN a.k IS NOT NULL THEN 'only_left' ELSE 'only_right' END AS status FROM a FULL JOIN b USING (k)""")
def outer_status(spark, sf):
    a = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"))
    b = table(spark, sf, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("k"))
    return r.outer_status(a, b, ["k"])


@query("""WITH p AS (SELECT DISTINCT l_suppkey % 10 AS g, l_orderkey AS k FROM lineitem), m AS (SELECT g, min(k) AS a, max(k) AS b FROM p GROUP BY g)
SELECT g, k FROM (SELECT g, unnest(range(a, b)) AS k FROM m) ANTI JOIN p USING (g, k)""")
def number_gaps(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_orderkey").alias("k"))
    return r.number_gaps(li, ["g"], "k")


@query("""SELECT * FROM (SELECT c_custkey, 1 AS occurrence, 'c_acctbal' AS "column", CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS left_value, CAST(CAST(c_acctbal + 1 AS DECIMAL(18,2)) AS VARCHAR) AS right_value FROM customer WHERE c_custkey % 5 = 1 AND c_custkey % 100 <> 0 ORDER BY c_custkey LIMIT 20)
UNION ALL SELECT c_custkey, 1, NULL, 'present', NULL FROM customer WHERE c_custkey % 100 = 0""")
def table_diff(spark, sf):
    """Customers against a copy with some balances changed and some rows absent; the first 20 cells of a column are reported."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", money("c_acctbal").alias("c_acctbal"))
    other = c.where("c_custkey % 100 <> 0").withColumn("c_acctbal", F.expr("cast(if(c_custkey % 5 = 1, c_acctbal + 1, c_acctbal) as decimal(18,2))"))
    return r.table_diff(c, other, ["c_custkey"])


@query("""WITH d AS (SELECT o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS a FROM orders), g AS (SELECT o_custkey, coalesce(sum(a) FILTER (a > 0), 0) AS cr, coalesce(-sum(a) FILTER (a < 0), 0) AS de FROM d GROUP BY 1),
j AS (SELECT g.*, CAST(c_acctbal AS DECIMAL(18,2)) AS op FROM g LEFT JOIN customer ON c_custkey = o_custkey)
SELECT o_custkey, CAST(cr AS DOUBLE) AS credits, CAST(de AS DOUBLE) AS debits, CAST(cr - de AS DOUBLE) AS net, CAST(op + cr - de AS DOUBLE) AS computed_closing, CASE WHEN op IS NULL THEN 'N/A' WHEN abs(op - (op + cr - de)) > 0.01 THEN 'GAP' ELSE 'MATCH' END AS status FROM j""")
def account_recon(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.expr("cast(o_totalprice as decimal(18,2)) * if(o_orderstatus = 'F', -1, 1)").alias("a"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), money("c_acctbal").alias("opening"), money("c_acctbal").alias("closing"))
    out = r.account_recon(o, ["o_custkey"], "a", c)
    return out.select("o_custkey", *[dbl(x).alias(x) for x in ("credits", "debits", "net", "computed_closing")], "status")


YEARS = ["1996", "1997", "1998"]


@query("""WITH l AS (SELECT o_orderpriority AS name, CAST(ascii(o_orderpriority) AS DOUBLE) AS pos FROM orders GROUP BY 1), x AS (SELECT name, pos, y FROM l LEFT JOIN (SELECT o_orderpriority AS p, year(o_orderdate) AS y FROM orders WHERE o_orderstatus <> 'F') ON p = name),
g AS (SELECT name, pos, count(*) FILTER (y = 1996) AS a, count(*) FILTER (y = 1997) AS b, count(*) FILTER (y = 1998) AS c FROM x GROUP BY ALL)
SELECT name, a AS "1996", b AS "1997", c AS "1998" FROM g UNION ALL SELECT 'TOTAL', CAST(sum(a) AS BIGINT), CAST(sum(b) AS BIGINT), CAST(sum(c) AS BIGINT) FROM g""")
def snapshot_pivot(spark, sf):
    o = table(spark, sf, "orders")
    lists = o.select(F.col("o_orderpriority").alias("id")).distinct().withColumn("name", F.col("id")).withColumn("pos", F.ascii("id").cast("double"))
    cards = o.select(F.col("o_orderpriority").alias("list_id"), (F.col("o_orderstatus") == "F").alias("closed"), F.year("o_orderdate").alias("snapshot_date"))
    return s.snapshot_pivot(lists, cards, YEARS).select("name", *YEARS)


@query("""WITH q AS (SELECT c_custkey, CAST(round(abs(c_acctbal) + 1000, 2) AS DOUBLE) AS p FROM customer)
SELECT c_custkey, round((p + p * 7.0 / 100 * 60 / 12) / 60, 6) AS flat_emi, round(p * (9.0 / 1200) * pow(1 + 9.0 / 1200, 60) / (pow(1 + 9.0 / 1200, 60) - 1), 6) AS emi,
  CASE WHEN (p + p * 7.0 / 100 * 60 / 12) <= p * (9.0 / 1200) * pow(1 + 9.0 / 1200, 60) / (pow(1 + 9.0 / 1200, 60) - 1) * 60 THEN 'flat' ELSE 'reducing' END AS cheaper FROM q""")
def loan_compare(spark, sf):
    q = table(spark, sf, "customer").select("c_custkey", F.round(F.abs("c_acctbal") + 1000, 2).alias("p"))
    flat, red = fm.flat_emi(F.col("p"), F.lit(7.0), F.lit(60)), fm.emi(F.col("p"), F.lit(9.0), F.lit(60))
    return q.select("c_custkey", F.round(flat, 6).alias("flat_emi"), F.round(red, 6).alias("emi"), F.when(flat * 60 <= red * 60, "flat").otherwise("reducing").alias("cheaper"))


@query("""WITH RECURSIVE b AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(100 AS DOUBLE) AS hi UNION ALL SELECT i + 1, CASE WHEN o THEN lo ELSE (lo + hi) / 2 END, CASE WHEN o THEN (lo + hi) / 2 ELSE hi END
FROM (SELECT *, r * pow(1 + r, 60) / (pow(1 + r, 60) - 1) > (1 + 0.07 * 5) / 60 AS o FROM (SELECT *, (lo + hi) / 2400 AS r FROM b WHERE i < 200)))
SELECT c_custkey, (SELECT round((lo + hi) / 2, 4) FROM b WHERE i = 200) AS rate FROM customer""")
def effective_rates(spark, sf):
    """The rate at which flat payments pay a loan off, by bisection."""
    q = table(spark, sf, "customer").select("c_custkey", F.round(F.abs("c_acctbal") + 1000, 2).alias("p")).repartition("c_custkey")  # a step of rows that are few bytes and much work
    return q.select("c_custkey", fm.effective_rate(F.col("p"), fm.flat_emi(F.col("p"), F.lit(7.0), F.lit(60)), F.lit(60)).alias("rate"))


@query("""WITH q AS (SELECT c_custkey, round(abs(c_acctbal) + 1000, 2) AS p, 12 + c_custkey % 3 * 12 AS n FROM customer), m AS (SELECT *, CAST(unnest(range(1, n + 1)) AS INTEGER) AS month, 9.0 / 1200 AS r FROM q),
b AS (SELECT c_custkey, month, n, p, p * r * pow(1 + r, n) / (pow(1 + r, n) - 1) AS pay, p * pow(1 + r, month) AS grown, r FROM m)
SELECT c_custkey, month, CASE WHEN round(grown - pay * (pow(1 + r, month) - 1) / r, 2) <= 0 THEN 0.0 ELSE round(grown - pay * (pow(1 + r, month) - 1) / r, 2) END AS balance FROM b WHERE month % greatest(1, n // 24) = 0 OR month = n""")
def amortise(spark, sf):
    q = table(spark, sf, "customer").select("c_custkey", F.round(F.abs("c_acctbal") + 1000, 2).alias("p"), F.lit(9.0).alias("rate"), (12 + F.col("c_custkey") % 3 * 12).cast("int").alias("n"))
    return s.amortise(q, ["c_custkey"], "p", "rate", "n").select("c_custkey", "month", F.col("balance"))


@query("""WITH c AS (SELECT o_orderkey, unnest(['A', 'B', 'C']) AS quote, unnest([o_totalprice, o_totalprice + 0.5, o_totalprice + 5]) AS cost FROM orders)
SELECT o_orderkey, quote, cost <= min(cost) OVER (PARTITION BY o_orderkey) + 1 AS cheapest FROM c""")
def cheapest(spark, sf):
    q = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(n).alias("quote"), (F.col("o_totalprice") + x).alias("cost")) for n, x in (("A", 0.0), ("B", 0.5), ("C", 5.0))])).alias("q")).select("o_orderkey", "q.*")
    return s.cheapest(q, ["o_orderkey"], "cost").select("o_orderkey", "quote", "cheapest")


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, arg_max(value, ts) AS v FROM events GROUP BY ALL), w AS (SELECT user_id, day, max(v) FILTER (event_type = 'view') AS a, max(v) FILTER (event_type = 'click') AS b FROM r GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, round(a / b, 3) AS ratio FROM w WHERE a IS NOT NULL AND b > 0""")
def derived_same_day(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("client_id"), F.to_date("ts").alias("date"), F.when(F.col("event_type") == "view", "waist").when(F.col("event_type") == "click", "hips").alias("metric"), "value", F.col("ts").alias("recorded_at")).where("metric is not null")
    p = e.select("client_id").distinct().select("client_id", F.lit("m").alias("gender"), F.lit(None).cast("date").alias("dob"), F.lit(None).cast("double").alias("height_cm"))
    return t.derived_measures(e, p).where("metric = 'whr'").select(F.col("client_id").alias("user_id"), F.col("date").cast("string").alias("day"), F.col("value").alias("ratio"))
