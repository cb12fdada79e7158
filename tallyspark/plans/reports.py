"""Queries of ledgers and reports: overrides, labels, matrices, totals, names, statuses, typed columns, loans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import measures as fm
from tallyspark.functions import text as x
from tallyspark.operators import grid as g
from tallyspark.operators import order as o
from tallyspark.operators import recon as r
from tallyspark.operators import summary as s
from tallyspark.operators import tagging as t
from tallyspark.plans.common import dbl, money, query, table
from tallyspark.plans.ledger import MONTHS


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'TRANSFER' WHEN starts_with(lower(p_type), 'economy') AND p_size > 25 THEN 'LAND_SALE' WHEN starts_with(lower(p_type), 'economy') THEN 'RULE' ELSE 'NON_DEDUCTIBLE' END AS section FROM part""")
def ledger_overrides(spark, sf):
    """Overrides by description, memo and amount before the rules; the first that holds wins."""
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("category"), F.when(F.col("p_partkey") % 7 == 0, "Opening Balance 1").otherwise("x").alias("description"), F.when(F.col("p_size") > 25, "Land Sale").otherwise("").alias("memo"))
    rules = spark.createDataFrame([(1, "prefix", "economy", "RULE")], "priority int, kind string, pattern string, section string")
    ruled = t.match_rules(p, rules, ["p_partkey"], "category")
    overrides = [(F.contains(F.lower("description"), F.lit("opening balance")), "TRANSFER"), (F.col("category").startswith("economy") & F.contains(F.lower("memo"), F.lit("land sale")), "LAND_SALE")]
    return t.with_overrides(ruled, overrides, "section", F.coalesce("section", F.lit("NON_DEDUCTIBLE"))).select("p_partkey", "section")


@query("""SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'Low Cost' WHEN 'promo' THEN 'Campaign' ELSE upper(p_type[1]) || lower(p_type[2:]) END AS label FROM part""")
def label_names(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.upper("p_type")), F.lit(" ")).alias("c"))
    return p.select("p_partkey", x.label(F.col("c"), {"economy": "Low Cost", "promo": "Campaign"}).alias("label"))


COLUMNS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
_D = ", ".join(f"CAST(c{k} AS DOUBLE) AS \"{c}\"" for k, c in enumerate(COLUMNS))
_S = ", ".join(f"sum(a) FILTER (p = '{c}') AS c{k}" for k, c in enumerate(COLUMNS))


@query(f"""WITH d AS (SELECT o_orderpriority AS p, 'kind ' || (o_custkey % 6) AS kind, CAST(o_totalprice AS DECIMAL(18,2)) AS a, o_orderstatus AS st FROM orders),
i AS (SELECT {_S} FROM d WHERE st = 'O'), e AS (SELECT kind, {_S} FROM (SELECT * REPLACE (-a AS a) FROM d WHERE st <> 'O' AND p IN ({", ".join(f"'{c}'" for c in COLUMNS)})) GROUP BY kind), w AS (SELECT sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2 FROM e),
u AS (SELECT 0 AS q, 'Rental Income' AS kind, c0, c1, c2 FROM i UNION ALL SELECT CASE kind WHEN 'kind 4' THEN 1 WHEN 'kind 1' THEN 2 ELSE 3 END, kind, c0, c1, c2 FROM e UNION ALL SELECT 8, 'Total Expenses', c0, c1, c2 FROM w UNION ALL SELECT 9, 'Net Rental Income', coalesce(i.c0, 0) + coalesce(w.c0, 0), coalesce(i.c1, 0) + coalesce(w.c1, 0), coalesce(i.c2, 0) + coalesce(w.c2, 0) FROM i, w)
SELECT CAST(row_number() OVER (ORDER BY q, kind) AS INTEGER) AS place, kind, {_D}, CAST(coalesce(c0, 0) + coalesce(c1, 0) + coalesce(c2, 0) AS DOUBLE) AS "TOTAL" FROM u""")
def expense_matrix(spark, sf):
    """Income, kinds of expense in a preferred order, total and net, over fixed columns; other columns are left out."""
    d = table(spark, sf, "orders").select("o_orderpriority", F.concat(F.lit("kind "), (F.col("o_custkey") % 6).cast("string")).alias("kind"), money("o_totalprice").alias("a"), "o_orderstatus")
    income, expenses = d.where("o_orderstatus = 'O'"), d.where("o_orderstatus <> 'O'").withColumn("a", (-F.col("a")).cast("decimal(18,2)"))
    out = s.expense_matrix(income, expenses, "kind", "o_orderpriority", COLUMNS, "a", ["kind 4", "kind 1"])
    return out.select("place", "kind", *[dbl(F.col(f"`{c}`")).alias(c) for c in [*COLUMNS, "TOTAL"]])


_M = ", ".join(f"CAST(sum(a) FILTER (m = {k}) AS DOUBLE) AS {m}" for k, m in enumerate(MONTHS, 1))


@query(f"""WITH d AS (SELECT month(o_orderdate) AS m, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders WHERE o_orderstatus = 'O') SELECT 'Income' AS o_orderpriority, 'income' AS level, {_M}, CAST(sum(a) AS DOUBLE) AS total FROM d""")
def income_row(spark, sf):
    """The income row of a summary by months; the summary's other rows are tested by period_rollup."""
    d = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "MMM").alias("month"), money("o_totalprice").alias("amount"))
    rolled = s.rollup_by_period(d.where("o_orderstatus <> 'O'"), "o_orderpriority", "o_orderstatus", "month", MONTHS, "amount")
    out = s.with_income(rolled, d.where("o_orderstatus = 'O'"), "o_orderpriority", "o_orderstatus", "month", MONTHS, "amount")
    return out.where("level = 'income'").select("o_orderpriority", "level", *[dbl(c).alias(c) for c in [*MONTHS, "total"]])


@query("""WITH d AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS y, l_shipdate AS t, l_orderkey AS k, l_linenumber AS n, CAST(l_discount AS DECIMAL(18,2)) AS b, CAST(l_tax AS DECIMAL(18,2)) AS c FROM lineitem), q AS (SELECT y, count(*) AS n, sum(b) AS b, sum(c) AS c, max(month(t)) AS m FROM d GROUP BY y),
u AS (SELECT y, n, b, c, CAST(m AS DECIMAL(18,2)) AS s FROM q UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), sum(b), sum(c), CAST(sum(m) AS DECIMAL(18,2)) FROM q) SELECT y AS year, n, CAST(b AS DOUBLE) AS parsed_subtracted, CAST(c AS DOUBLE) AS parsed_added, CAST(c - b AS DOUBLE) AS net, CAST(s AS DOUBLE) AS stated_added, CAST(s - c AS DOUBLE) AS gap_added FROM u""")
def period_totals(spark, sf):
    """Periods with their last stated totals and gaps, and the TOTAL row under them."""
    li = table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("string").alias("year"), F.month("l_shipdate").alias("m"), money("l_discount").alias("sub"), money("l_tax").alias("added"))
    stated = li.select("year", "m", F.col("m").cast("decimal(18,2)").alias("stated_subtracted"), F.col("m").cast("decimal(18,2)").alias("stated_added"))
    out = s.with_total(s.period_summary(li, stated, ["year"], "m", "sub", "added"), "year")
    return out.select("year", "n", *[dbl(c).alias(c) for c in ("parsed_subtracted", "parsed_added", "net", "stated_added", "gap_added")])


@query("""WITH d AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS m, o_orderdate AS t, o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders), b AS (SELECT *, sum(a) OVER (PARTITION BY o_custkey ORDER BY t, k) AS bal FROM d),
g AS (SELECT o_custkey, m, sum(a) FILTER (k % 10 <> 0) AS net, arg_min(bal - a, (t, k)) AS opening, arg_max(bal, (t, k)) AS closing FROM b GROUP BY ALL)
SELECT o_custkey, m AS month, CAST(net AS DOUBLE) AS net, CAST(opening AS DOUBLE) AS opening, CAST(closing AS DOUBLE) AS closing, CAST(opening + net AS DOUBLE) AS computed_closing, CAST(closing - opening - net AS DOUBLE) AS gap, CASE WHEN abs(closing - opening - net) > 0.01 THEN 'GAP' ELSE 'MATCH' END AS status FROM g WHERE net IS NOT NULL""")
def account_months(spark, sf):
    """Opening and closing of each account and month by the rows' balances; rows that the parser lost leave a gap."""
    from pyspark.sql import Window

    d = table(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey", money("o_totalprice").alias("a"))
    d = d.withColumn("balance", F.sum("a").over(Window.partitionBy("o_custkey").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,2)"))
    ends = o.open_close(d, ["o_custkey", "month"], "at", "a", "balance")
    out = r.account_recon(d.where("o_orderkey % 10 <> 0"), ["o_custkey", "month"], "a", ends)
    return out.select("o_custkey", "month", *[dbl(c).alias(c) for c in ("net", "opening", "closing", "computed_closing", "gap")], "status")


@query("""SELECT c_custkey, CASE WHEN n_nationkey % 5 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE n_name END AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def display_names(spark, sf):
    """Nations by name, by id where the dimension lacks them; a doubled entry of the dimension doubles no row."""
    names = table(spark, sf, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return s.with_names(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), names.unionByName(names), "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN n > 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN n = 0 THEN 'no readings in range' END AS message FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey WHERE c_custkey > 0 GROUP BY 1)
UNION ALL SELECT NULL, 'error', 'no components selected'""")
def result_statuses(spark, sf):
    """A result without rows is a status; so is a question without keys."""
    found = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    asked = table(spark, sf, "customer").where("c_custkey > 0").select("c_custkey")
    full = s.result_status(found, asked, ["c_custkey"], "no components selected", "no readings in range")
    none = s.result_status(found, asked.where("c_custkey < 0"), ["c_custkey"], "no components selected", "no readings in range")
    return full.unionByName(none).withColumn("c_custkey", F.col("c_custkey").cast("string"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_partkey % 5 <> 0 THEN l_returnflag END NULLS LAST, l_shipdate NULLS LAST, l_extendedprice NULLS LAST, l_linenumber, l_partkey) AS place FROM lineitem""")
def compare_order(spark, sf):
    """The order in which lots are compared: description, date and proceeds, nulls last."""
    li = table(spark, sf, "lineitem").withColumn("d", F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag")))
    return s.in_order(li, ["l_orderkey"], ["d", "l_shipdate", "l_extendedprice", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "place")


@query("""SELECT user_id, event_type, string_agg(strftime(ts, '%Y-%m-%d'), ',' ORDER BY ts, value) AS days, count(*) AS n FROM events GROUP BY ALL""")
def sorted_readings(spark, sf):
    out = s.sorted_readings(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "value")
    days = F.array_join(F.transform("readings", lambda v: F.date_format(v["ts"], "yyyy-MM-dd")), ",")
    return out.select("user_id", "event_type", days.alias("days"), F.size("readings").cast("bigint").alias("n"))


@query("""SELECT c_custkey AS k, c_name AS name, CAST(c_acctbal AS DOUBLE) AS balance, CAST(NULL AS DOUBLE) AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, CAST(p_size AS DOUBLE) FROM part UNION ALL SELECT s_suppkey, NULL, CAST(s_acctbal AS DOUBLE), NULL FROM supplier""")
def stacked(spark, sf):
    """Tables of differing columns under one another."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), dbl("c_acctbal").alias("balance"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), dbl("p_size").alias("size"))
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), dbl("s_acctbal").alias("balance"))
    return s.stacked([a, b, c])


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'cosine (0.' || CASE WHEN o_orderkey % 2 = 0 THEN '72' ELSE '6' END || ')' END AS audit FROM orders""")
def match_audits(spark, sf):
    k = F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select("o_orderkey", t.match_audit(F.when(k == 0, "x"), F.when(k < 2, "y"), F.when(F.col("o_orderkey") % 2 == 0, 0.7191).otherwise(0.6)).alias("audit"))


@query("""WITH d AS (SELECT o_orderpriority AS p, o_orderkey % 4 AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders) SELECT p AS category, count(*) FILTER (k < 2) AS n, CAST(sum(a) FILTER (k < 2) AS DOUBLE) AS total, count(*) FILTER (k = 2) AS near FROM d GROUP BY 1""")
def category_totals(spark, sf):
    d = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 4 < 2, F.col("o_orderpriority")).alias("c"), F.when(F.col("o_orderkey") % 4 < 3, F.col("o_orderpriority")).alias("near"), money("o_totalprice").alias("a"))
    return t.category_totals(d, "c", "near", "a").withColumn("total", dbl("total"))


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, arg_max(value, ts) AS v FROM events GROUP BY ALL), w AS (SELECT user_id, day, max(v) FILTER (event_type = 'view') AS waist, max(v) FILTER (event_type = 'click') AS hips, max(v) FILTER (event_type = 'error') + 40 AS weight, max(v) FILTER (event_type = 'signup') + 150 AS height FROM r GROUP BY ALL),
p AS (SELECT *, CASE WHEN user_id % 3 <> 0 THEN user_id % 2 = 0 END AS male, CASE WHEN user_id % 5 <> 0 THEN date_diff('day', DATE '1980-01-01', day) // 365 END AS age, coalesce(height, CASE WHEN user_id % 2 = 0 THEN 170.0 END) AS h FROM w),
u AS (SELECT user_id, day, 'whr' AS metric, round(waist / hips, 3) AS value FROM p WHERE hips > 0 UNION ALL SELECT user_id, day, 'bmi', round(weight / pow(height / 100, 2), 1) FROM p WHERE height > 0 UNION ALL SELECT user_id, day, 'bmr', round(10 * weight + 6.25 * h - 5 * age + CASE WHEN male THEN 5 ELSE -161 END, 0) FROM p WHERE male IS NOT NULL)
SELECT user_id, CAST(day AS VARCHAR) AS day, metric, value FROM u WHERE value IS NOT NULL""")
def derived_all(spark, sf):
    """bmi, bmr and whr of same-day readings; clients without gender or date of birth get no bmr."""
    kinds = {"view": "waist", "click": "hips", "error": "weight", "signup": "height"}
    name = F.lit(None).cast("string")
    for k, v in kinds.items():
        name = F.when(F.col("event_type") == k, v).otherwise(name)
    value = F.col("value") + F.when(F.col("event_type") == "error", 40.0).when(F.col("event_type") == "signup", 150.0).otherwise(0.0)
    e = table(spark, sf, "events").select(F.col("user_id").alias("client_id"), F.to_date("ts").alias("date"), name.alias("metric"), value.alias("value"), F.col("ts").alias("recorded_at")).where("metric is not null")
    u = e.select("client_id").distinct()
    p = u.select("client_id", F.when(F.col("client_id") % 3 != 0, F.when(F.col("client_id") % 2 == 0, "Male").otherwise("Female")).alias("gender"), F.when(F.col("client_id") % 5 != 0, F.lit("1980-01-01").cast("date")).alias("dob"), F.when(F.col("client_id") % 2 == 0, 170.0).alias("height_cm"))
    return t.derived_measures(e, p).select(F.col("client_id").alias("user_id"), F.col("date").cast("string").alias("day"), "metric", "value")


@query("""WITH q AS (SELECT c_custkey, CAST(round(abs(c_acctbal) + 1000, 2) AS DOUBLE) AS p FROM customer) SELECT c_custkey, true AS solves, round(p, 4) AS principal, CASE WHEN c_custkey % 3 <> 0 THEN round(p / 60, 6) END AS free FROM q""")
def loan_solutions(spark, sf):
    """The rate found by bisection pays the loan off with the payment; the payment gives the principal back; guards give null."""
    q = table(spark, sf, "customer").select("c_custkey", F.round(F.abs("c_acctbal") + 1000, 2).alias("p")).repartition("c_custkey")  # a step of rows that are few bytes and much work
    pay = fm.flat_emi(F.col("p"), F.lit(7.0), F.lit(60))
    q = q.withColumn("pay", pay).withColumn("rate", fm.effective_rate(F.col("p"), pay, F.lit(60)))
    solves = F.abs(fm.emi(F.col("p"), F.col("rate"), F.lit(60)) - F.col("pay")) < 0.01
    back = fm.principal_for(fm.emi(F.col("p"), F.lit(9.0), F.lit(60)), F.lit(9.0), F.lit(60))
    months = F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(60)
    free = fm.principal_for(F.col("p") / 3600, F.lit(0.0), months)
    return q.select("c_custkey", solves.alias("solves"), F.round(back, 4).alias("principal"), F.round(free, 6).alias("free"))


@query("""WITH s AS (SELECT s_suppkey, 'item_no_' || (s_suppkey % 7) AS b FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY s_suppkey) AS n FROM s) SELECT s_suppkey, CASE WHEN n = 1 THEN b ELSE b || '_' || n END AS id FROM k""")
def slug_ids(spark, sf):
    p = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit(" Item -- No. "), (F.col("s_suppkey") % 7).cast("string"), F.lit("! ")).alias("name"))
    return t.slug_ids(p, "name", ["s_suppkey"]).select("s_suppkey", "id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS price_number, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day_date, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a?' ELSE '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price FROM orders""")
def typed_columns(spark, sf):
    """Typed values beside the texts they were read from; what can't be read leaves its text."""
    d = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "n/a?").otherwise(F.concat(F.lit("$"), money("o_totalprice").cast("string"))).alias("price"), F.when(F.col("o_orderkey") % 4 == 0, "soon").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("day"))
    out = s.typed_columns(d, {"price": "currency", "day": "date"}, {"price": x.parse_money(F.col("price"))}, {"day": x.parse_date(F.col("day"))})
    return out.select("o_orderkey", "price", dbl("price_number").alias("price_number"), F.col("day_date").cast("string").alias("day_date"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'a' ELSE CAST(o_custkey AS VARCHAR) END AS filled, CASE WHEN o_orderkey % 8 < 3 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS amount, '12.5-' AS digits,
CASE o_orderkey % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'S' WHEN 2 THEN 'L' ELSE '' END AS term, printf('%02d:%02d:%02d', o_custkey // 3600, o_custkey % 3600 // 60, o_custkey % 60) AS duration, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) || '.5' ELSE CAST(o_custkey AS VARCHAR) END AS plain,
CASE WHEN o_orderkey % 3 = 0 AND o_custkey <> 0 THEN CAST(o_custkey AS DOUBLE) END AS wash, CASE WHEN o_orderkey % 2 = 0 THEN 2000 + o_orderkey % 31 ELSE 1900 + 31 + o_orderkey % 69 END AS year, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%b') ELSE 'Jan' END AS month, CASE o_orderkey % 3 WHEN 0 THEN o_custkey + 0.04 WHEN 1 THEN 0.48 ELSE NULL END AS ocr, o_orderkey % 3 <> 1 AS dated, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) || '.00' ELSE 'see note' END AS either FROM orders""")
def cell_functions(spark, sf):
    """Column functions on texts of every kind, readable and not."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    blank = F.when(k % 8 == 0, " -- ").when(k % 8 == 1, "NaN").when(k % 8 == 2, " a ").otherwise(F.concat(F.lit(" "), c, F.lit(" ")))
    names = F.when(k % 4 == 0, "Long-term").when(k % 4 == 1, "s").when(k % 4 == 2, " LONG").otherwise("other")
    tokens = F.when(k % 3 == 0, F.array(c, F.lit("04"))).when(k % 3 == 1, F.array(F.lit("048"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    day = F.date_format("o_orderdate", "dd-MM-yyyy")
    cells = F.when(k % 3 == 0, F.concat(F.lit("x\n"), F.date_format("o_orderdate", "MM/dd/yy"))).when(k % 3 == 1, F.lit("13 of 20")).otherwise("Various")
    return table(spark, sf, "orders").select(
        k.alias("k"), x.null_if_blank(blank).alias("filled"), dbl(x.parse_money(blank)).alias("amount"), x.clean_numeric(F.lit("$ 1x2,.5 USD-")).alias("digits"), x.term(F.trim(names)).alias("term"),
        x.duration_text(F.col("o_custkey")).alias("duration"), x.plain_number(F.col("o_custkey") + F.when(k % 2 == 0, 0.5).otherwise(0.0)).alias("plain"),
        dbl(x.wash_sale(F.when(k % 3 == 0, c).when(k % 3 == 1, F.lit("0.00")).otherwise("--"))[1]).alias("wash"),
        x.two_digit_year(F.when(k % 2 == 0, (k % 31).cast("string")).otherwise((31 + k % 69).cast("string"))).cast("bigint").alias("year"),
        x.month_label(F.when(k % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise("?")).alias("month"), dbl(x.ocr_amount(tokens)).alias("ocr"), x.has_date(cells).alias("dated"), x.iso_date(F.when(k % 3 == 0, day).otherwise("31-02-x"), "dd-MM-yyyy").alias("iso"),
        x.money_or_text(F.when(k % 2 == 0, F.concat(F.lit("$"), c)).otherwise(" see note ")).alias("either"))


@query("""WITH c AS (SELECT l_orderkey AS o, l_partkey % 4 AS m FROM lineitem) SELECT o, kind, n, round(100.0 * n / sum(n) OVER (PARTITION BY o), 1) AS percent FROM (SELECT o, 'k' || m AS kind, count(*) AS n FROM c GROUP BY ALL)""")
def row_distribution(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.concat(F.lit("k"), (F.col("l_partkey") % 4).cast("string")).alias("kind"))
    return g.row_distribution(li, ["o"])


@query("""WITH c AS (SELECT l_orderkey AS o, l_partkey % 4 AS m, l_suppkey % 3 AS f FROM lineitem WHERE l_suppkey % 3 <> 2) SELECT o, 1 AS col, count(*) FILTER (m = 0) AS nan, count(*) FILTER (m = 1) AS zero, count(*) FILTER (m = 2) AS nonzero, count(*) FILTER (m = 3) AS text FROM c GROUP BY o""")
def optional_tallies(spark, sf):
    cellv = F.get(F.array(F.lit(" nan "), F.lit("$0.00"), F.lit("(5.00)"), F.lit("abc")), (F.col("l_partkey") % 4).cast("int"))
    grid = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 3 != 2).alias("t"), F.array(F.lit("x"), cellv).alias("cells"))
    return g.optional_tallies(grid, ["o"], [1], F.col("t"))


@query("""SELECT l_orderkey AS o, CAST(l_partkey % 3 AS INTEGER) AS "offset", count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY ALL""")
def shift_pattern(spark, sf):
    grid = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 5 != 0).alias("t"), F.concat(F.array(F.lit("x")), F.array_repeat(F.lit("text"), (F.col("l_partkey") % 3).cast("int")), F.array(F.lit("01/02/2020"), F.lit("01/03/2020"))).alias("cells"))
    return g.shift_pattern(grid, ["o"], 1, F.col("t"))


@query("""SELECT o_custkey, count(*) FILTER (o_orderkey % 6 <> 0) AS filled, count(*) FILTER (o_orderkey % 6 = 1) AS unreadable, count(*) FILTER (o_orderkey % 6 = 2) AS negative, count(*) FILTER (o_orderkey % 6 = 3) AS zero, count(*) FILTER (o_orderkey % 6 > 3) AS positive FROM orders GROUP BY 1""")
def signed_checks(spark, sf):
    """Readable, unreadable, negative, positive and zero cells of a signed column, by account."""
    made = F.get(F.array(F.lit(None).cast("string"), F.lit("?"), F.lit("(5.00)"), F.lit("0"), F.lit("$1"), F.lit("7 W")), (F.col("o_orderkey") % 6).cast("int"))
    d = table(spark, sf, "orders").select("o_custkey", made.alias("c"))
    return s.signed_check(d, "c", x.parse_money(F.col("c")), ["o_custkey"])


@query("""SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'MISMATCH' WHEN l_orderkey % 3 = 1 AND n = 1 THEN 'MISMATCH' WHEN l_orderkey % 3 = 1 THEN 'MISMATCH' ELSE 'MATCH' END AS status FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def content_checks(spark, sf):
    """Ordered lines of both sides: the same, with one line changed, and with a line missing."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(o.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).alias("i"), F.col("l_partkey").cast("string").alias("text"))
    other = li.where((F.col("l_orderkey") % 3 != 1) | (F.col("i") > 1)).withColumn("text", F.when((F.col("l_orderkey") % 3 == 0) & (F.col("i") == 1), "x").otherwise(F.col("text")))
    return r.content_check(li, other, "l_orderkey", "i", "text")


@query("""WITH s AS (SELECT s_suppkey AS sheet, s_suppkey % 4 AS d, s_suppkey % 3 AS c FROM supplier), f AS (SELECT * FROM (VALUES ('fidelity', 2, 5), ('apex', 0, 2), ('robin', 3, 3)) v(format, fd, fc)), p AS (SELECT sheet, format, CASE abs(d - fd) WHEN 0 THEN 40 WHEN 1 THEN 20 ELSE 0 END + CASE abs(c + 3 - fc) WHEN 0 THEN 40 WHEN 1 THEN 20 ELSE 0 END AS score FROM s, f) SELECT sheet, format, score, row_number() OVER (PARTITION BY sheet ORDER BY score DESC, format) AS rank FROM p""")
def rank_formats(spark, sf):
    found = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sheet"), (F.col("s_suppkey") % 4).alias("date_col"), (F.col("s_suppkey") % 3 + 3).alias("cost_col"))
    formats = spark.createDataFrame([("fidelity", 2, 5), ("apex", 0, 2), ("robin", 3, 3)], "format string, format_date int, format_cost int")
    return g.rank_formats(found, formats).select("sheet", "format", "score", "rank")


@query("""WITH l AS (SELECT o_custkey AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS k FROM orders) SELECT f, i AS line, CASE WHEN k % 3 = 1 THEN CAST((SELECT min(m.i) FROM l m WHERE m.f = l.f AND m.i >= l.i AND m.k % 3 = 0) AS DOUBLE) END AS heading_for FROM l""")
def headings(spark, sf):
    """Heading lines with the number of the next numbered line of their file."""
    l = table(spark, sf, "orders").select(F.col("o_custkey").alias("f"), F.row_number().over(o.Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint").alias("line"), "o_orderkey").withColumn("num", F.when(F.col("o_orderkey") % 3 == 0, F.col("line")))
    return o.heading_of_next(l, "f", "line", "num", F.col("o_orderkey") % 3 == 1).select("f", "line", dbl("heading_for").alias("heading_for"))


@query("""SELECT o_orderpriority AS category, CAST(o_custkey % 5 AS VARCHAR) AS account, o_orderstatus AS currency, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CASE WHEN grouping(CAST(o_custkey % 5 AS VARCHAR)) = 0 AND grouping(o_orderstatus) = 0 THEN 'both' WHEN grouping(CAST(o_custkey % 5 AS VARCHAR)) = 0 THEN 'account' WHEN grouping(o_orderstatus) = 0 THEN 'currency' ELSE 'all' END AS level
FROM orders GROUP BY GROUPING SETS ((o_orderpriority, CAST(o_custkey % 5 AS VARCHAR), o_orderstatus), (o_orderpriority, CAST(o_custkey % 5 AS VARCHAR)), (o_orderpriority, o_orderstatus), (o_orderpriority))""")
def totals_by_levels(spark, sf):
    """Category totals by account and currency, by either and in all, in one pass."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 5).cast("string").alias("account"), F.col("o_orderstatus").alias("currency"), money("o_totalprice").alias("amount"))
    return s.totals_by_levels(o, "category", "account", "currency", "amount").select("category", "account", "currency", "n", dbl("total").alias("total"), "level")
