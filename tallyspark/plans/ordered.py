"""Queries of the ordered-row operators over events, conversations and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import order as o
from tallyspark.plans.common import dbl, money, query, table

BY, AT = ["user_id"], ["ts", "event_id"]


@query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1.0) AS carried FROM events""")
def carry_forward(spark, sf):
    e = table(spark, sf, "events")
    return o.carry_forward(e, BY, AT, F.when(F.col("event_type") == "signup", F.col("value")), "carried").select("event_id", "user_id", F.coalesce("carried", F.lit(-1.0)).alias("carried"))


@query("""SELECT event_id, carried FROM (SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events) WHERE carried IS NOT NULL""")
def carry_reset(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return o.carry_forward(e, ["user_id", "day"], AT, F.when(F.col("event_type") == "signup", F.col("event_id")), "carried", drop_before=True).select("event_id", "carried")


@query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn))
SELECT conv_id, min(turn) AS turn, count(*) AS n_rows, string_agg(text, ' ' ORDER BY turn) AS text FROM g WHERE g > 0 GROUP BY conv_id, g""")
def merge_continuations(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return o.merge_continuations(c, ["conv_id"], ["turn"], F.col("role") == "user", "text")


@query("""SELECT event_id, CASE WHEN nt = 'click' THEN ni ELSE -1 END AS click_id, CASE WHEN nt = 'click' THEN nv END AS click_value FROM (SELECT *, lead(event_type) OVER w AS nt, lead(event_id) OVER w AS ni, lead(value) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view'""")
def pair_next(spark, sf):
    e = table(spark, sf, "events")
    return o.pair_next(e, BY, AT, F.col("event_type") == "view", F.col("event_type") == "click", {"click_id": "event_id", "click_value": "value"}).select("event_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"), "click_value")


@query("""WITH a AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, max(CASE WHEN s = 1 AND event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM a)
SELECT event_id, event_type FROM b WHERE s = 1 AND e = 0 AND event_type <> 'signup'""")
def region_filter(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return o.region(e, ["user_id", "day"], AT, F.col("event_type") == "signup", F.col("event_type") == "error").where("in_region").select("event_id", "event_type")


def _statement(spark, sf):
    """Line items of an order as account lines with a running balance; every 97th part's is wrong, every 31st's absent."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", money("l_extendedprice").alias("amount"), "l_shipdate")
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("amount").alias("amount"))
    w = o._w(["l_orderkey"], ["l_linenumber"]).rowsBetween(o.Window.unboundedPreceding, o.Window.currentRow)
    total = F.sum("amount").over(w) + F.when(F.col("l_partkey") % 97 == 0, 5).otherwise(0)
    return li.withColumn("balance", F.when(F.col("l_partkey") % 31 != 0, total.cast("decimal(18,2)")))


STATEMENT = """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE WHEN l_partkey % 31 <> 0 THEN CAST(sum(amount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + CASE WHEN l_partkey % 97 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) END AS balance FROM l)"""


@query(STATEMENT + """, b AS (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(base + amount - balance) > 0.02 THEN 'VERIFY' END AS flag FROM b""")
def balance_walk(spark, sf):
    rows = _statement(spark, sf).withColumn("subtracted", F.lit(None).cast("decimal(18,2)"))
    return o.balance_walk(rows, ["l_orderkey"], ["l_linenumber"], "amount", "subtracted", "balance").select("l_orderkey", "l_linenumber", "flag")


@query(STATEMENT + """, b AS (SELECT *, lag(balance) OVER w AS pb, lag(amount) OVER w AS pa FROM s WHERE balance IS NOT NULL WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, l_linenumber, CAST(least(abs(pb + amount - balance), abs(balance + pa - pb)) AS DOUBLE) AS gap, coalesce(least(abs(pb + amount - balance), abs(balance + pa - pb)) > 0.02, false) AS broken FROM b""")
def continuity_gap(spark, sf):
    return o.continuity_gap(_statement(spark, sf), ["l_orderkey"], ["l_linenumber"], "amount", "balance").select("l_orderkey", "l_linenumber", dbl("gap").alias("gap"), "broken")


@query("""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, arg_min(value, event_id) - 1.0 AS opening, arg_max(value, event_id) AS closing FROM events GROUP BY ALL""")
def open_close(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string")).withColumn("one", F.lit(1.0))
    return o.open_close(e, ["user_id", "day"], "event_id", "one", "value")


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def keep_last(spark, sf):
    return o.keep_last(table(spark, sf, "events"), ["user_id", "event_type"], AT).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def keep_first(spark, sf):
    return o.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], AT).select("user_id", "event_type", "event_id", "value")


@query("""SELECT event_id, baseline_id, baseline_value FROM (SELECT *, min(event_id) OVER w AS baseline_id, first_value(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS baseline_value FROM events WINDOW w AS (PARTITION BY user_id, event_type)) WHERE event_id BETWEEN 500 AND 5000""")
def baseline_slice(spark, sf):
    return o.baseline_slice(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", 500, 5000, "value").select("event_id", F.col("baseline_date").alias("baseline_id"), "baseline_value")


@query("""WITH r AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY ALL),
d AS (SELECT DISTINCT user_id, day FROM r), m AS (SELECT DISTINCT user_id, event_type FROM r), n AS (SELECT user_id, count(*) AS n FROM d GROUP BY user_id),
f AS (SELECT user_id, event_type, day, value, n, min(value) OVER (PARTITION BY user_id) AS l1, max(value) OVER (PARTITION BY user_id) AS h1, min(value) OVER (PARTITION BY user_id, event_type) AS l2, max(value) OVER (PARTITION BY user_id, event_type) AS h2
  FROM d JOIN m USING (user_id) LEFT JOIN r USING (user_id, event_type, day) JOIN n USING (user_id)),
g AS (SELECT *, CASE WHEN n = 1 THEN l1 ELSE l2 END AS lo, CASE WHEN n = 1 THEN h1 ELSE h2 END AS hi FROM f)
SELECT user_id, event_type, CAST(day AS VARCHAR) AS day, CASE WHEN value IS NULL THEN NULL WHEN hi = lo THEN 1.0 ELSE (value - lo) / (hi - lo) END AS fill, CASE WHEN value IS NULL THEN 'no_data' ELSE 'value' END AS kind FROM g""")
def minmax_fill(spark, sf):
    r = table(spark, sf, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    return o.minmax_fill(r, ["user_id"], "event_type", "day", "value").select("user_id", "event_type", F.col("day").cast("string").alias("day"), "fill", "kind")


@query("""SELECT user_id, day FROM (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 10""")
def recent_dates(spark, sf):
    return o.recent(table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string")), ["user_id"], "day", 10)


@query("""SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 30 AS INTEGER) AS batch FROM orders""")
def batches(spark, sf):
    return o.number_batches(table(spark, sf, "orders"), ["o_orderpriority"], ["o_orderkey"], 30).select("o_orderkey", "batch")


@query("""WITH old AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
k AS (SELECT o_orderkey, coalesce(n, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o_orderkey) AS k FROM orders o LEFT JOIN old USING (o_custkey) WHERE o_orderstatus <> 'F')
SELECT o_orderkey, 'RCP-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS receipt FROM k""")
def sequence(spark, sf):
    rows = table(spark, sf, "orders")
    old = rows.where("o_orderstatus = 'F'").withColumn("receipt", F.lit(None).cast("string"))
    old = o.next_numbers(old, old.limit(0), ["o_custkey"], ["o_orderkey"], "receipt")
    return o.next_numbers(rows.where("o_orderstatus <> 'F'").withColumn("receipt", F.lit(None).cast("string")), old, ["o_custkey"], ["o_orderkey"], "receipt").select("o_orderkey", "receipt")


@query("""WITH r AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM r""")
def period_runs(spark, sf):
    return o.change_runs(table(spark, sf, "events"), BY, AT, "event_type", "run").select("event_id", "run")


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS value FROM events GROUP BY ALL)
SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN value > p THEN 'up' WHEN value < p THEN 'down' WHEN value = p THEN 'same' END AS trend, value - f AS from_start, round(mean_7d, 9) AS mean_7d
FROM (SELECT *, lag(value) OVER w AS p, first_value(value) OVER w AS f, avg(value) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS mean_7d FROM r WINDOW w AS (PARTITION BY user_id ORDER BY day))""")
def trend(spark, sf):
    r = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    return o.trend(r, ["user_id"], "day", "value").select("user_id", F.col("day").cast("string").alias("day"), "trend", "from_start", F.round("mean_7d", 9).alias("mean_7d"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line, section, coalesce(sign, -1) AS sign FROM (SELECT doc_id, line,
  last_value(CASE WHEN regexp_matches(text, '^(The|And) ') THEN 'prose' WHEN regexp_matches(text, 'License') THEN 'licence' END IGNORE NULLS) OVER w AS section,
  last_value(CASE WHEN regexp_matches(text, '^(The|And) ') THEN 1 WHEN regexp_matches(text, 'License') THEN 0 END IGNORE NULLS) OVER w AS sign,
  regexp_matches(text, '^(The|And) ') OR regexp_matches(text, 'License') AS h FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE NOT h""")
def section_carry(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return o.section_carry(lines, ["doc_id"], ["line"], [("^(The|And) ", "prose", 1), ("License", "licence", 0)]).select("doc_id", F.col("line").cast("bigint").alias("line"), "section", F.coalesce("sign", F.lit(-1)).alias("sign"))
