"""Queries of wide assessment sheets and of repairs gated by stated totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import has_date
from tallyspark.operators import assess as a
from tallyspark.operators.grid import cell
from tallyspark.operators.repair import pull_back
from tallyspark.plans.common import dbl, query, table
from tallyspark.plans.layouts import ITEMS, _grid, _items, _row

FIELDS = [a.Field("Body Weight In KGs", "weight_kg", "body_vitals"), a.Field("BMI", "bmi", "body_vitals", "derived"), a.Field("Pushups", "pushups", "physio_1", "integer"),
          a.Field("Pullups with weights", "pullups_reps", "physio_1", "weighted", "pullups_weight"), a.Field("5. Plank", "plank", "physio_2", "seconds")]
DATES = {"body_vitals": "Vitals Date", "physio_1": "Physio 1 Date", "physio_2": "Physio 2 Date"}


def _sheet(spark, sf):
    """Orders as assessments of their customers: dates as serial numbers, years, months and texts; blanks, notes and texts without numbers."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    text = lambda c: c.cast("string")
    serial = text(F.datediff(day, F.lit("1899-12-30").cast("date")))
    return o.select(
        F.col("o_custkey").alias("Client Name"), "o_orderkey",
        F.when(k % 4 == 0, serial).when(k % 4 == 1, text(F.year(day))).when(k % 4 == 2, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("Vitals Date"),
        F.when(k % 7 == 3, " -- ").otherwise(text(k % 90 + 40)).alias("Body Weight In KGs"), text(k % 30).alias("BMI"),
        F.when(k % 11 == 0, "soon").otherwise(F.date_format(day, "MMM yyyy")).alias("Physio 1 Date"),
        F.when(k % 5 == 0, "many").otherwise(F.concat(text(k % 60), F.lit(" (M)"))).alias("Pushups"),
        F.when(k % 3 == 0, F.concat(text(k % 40), F.lit(" ("), text(k % 150 + 5), F.lit(" lbs)"))).when(k % 3 == 1, F.concat(text(k % 40), F.lit(" (No weights)"))).alias("Pullups with weights"),
        F.date_format(day, "d MMM yyyy").alias("Physio 2 Date"), text((k % 300) / 86400).alias("5. Plank"))


CELLS = """o AS (SELECT o_orderkey AS k, o_custkey AS client, CAST(o_orderdate AS DATE) AS day FROM orders),
c AS (SELECT client, k, 'weight_kg' AS metric, 'body_vitals' AS component, CAST(NULL AS VARCHAR) AS note, CASE WHEN k % 4 = 1 THEN CAST(date_trunc('year', day) AS DATE) ELSE day END AS date, CAST(k % 90 + 40 AS DOUBLE) AS value,
 CASE WHEN k % 7 = 3 THEN 'empty' ELSE 'read' END AS status, NULL AS reason FROM o
UNION ALL SELECT client, k, 'bmi', 'body_vitals', NULL, NULL, NULL, 'derived', NULL FROM o
UNION ALL SELECT client, k, 'pushups', 'physio_1', 'M', CAST(date_trunc('month', day) AS DATE), k % 60, CASE WHEN k % 5 = 0 OR k % 11 = 0 THEN 'error' ELSE 'read' END, CASE WHEN k % 5 = 0 THEN 'no number' WHEN k % 11 = 0 THEN 'no date' END FROM o
UNION ALL SELECT client, k, 'pullups_reps', 'physio_1', CASE WHEN k % 3 = 0 THEN (k % 150 + 5) || ' lbs' ELSE 'No weights' END, CAST(date_trunc('month', day) AS DATE), k % 40, CASE WHEN k % 3 = 2 THEN 'empty' WHEN k % 11 = 0 THEN 'error' ELSE 'read' END, CASE WHEN k % 3 <> 2 AND k % 11 = 0 THEN 'no date' END FROM o
UNION ALL SELECT client, k, 'pullups_weight', 'physio_1', (k % 150 + 5) || ' lbs', CAST(date_trunc('month', day) AS DATE), k % 150 + 5, CASE WHEN k % 11 = 0 THEN 'error' ELSE 'read' END, CASE WHEN k % 11 = 0 THEN 'no date' END FROM o WHERE k % 3 = 0
UNION ALL SELECT client, k, 'plank', 'physio_2', NULL, day, k % 300, 'read', NULL FROM o),
old AS (SELECT DISTINCT client, date, metric FROM c WHERE status = 'read' AND client % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY client, date, metric ORDER BY k DESC) AS i FROM c WHERE status = 'read'),
done AS (SELECT n.*, CASE WHEN i = 1 AND old.metric IS NULL THEN 'written' ELSE 'duplicate' END AS became FROM n LEFT JOIN old USING (client, date, metric))"""


def _imported(spark, sf):
    """An import after an earlier one that took the sheets of half the clients."""
    cells = a.sheet_cells(_sheet(spark, sf), "Client Name", FIELDS, DATES, ["o_orderkey"])
    before = a.sheet_cells(_sheet(spark, sf).where("`Client Name` % 2 = 0"), "Client Name", FIELDS, DATES, ["o_orderkey"])
    none = cells.where("false")
    return a.import_cells(cells, a.new_readings(a.import_cells(before, none, ["o_orderkey"])), ["o_orderkey"])


@query(f"WITH {CELLS} SELECT client, strftime(date, '%d/%m/%Y') AS date_text, metric, component, value, note, 'migration' AS source FROM done WHERE became = 'written'")
def sheet_readings(spark, sf):
    """What an import of wide sheets appends to the readings."""
    return a.new_readings(_imported(spark, sf)).drop("date")


@query(f"WITH {CELLS} SELECT became AS status, NULL AS reason, count(*) AS n FROM done GROUP BY 1 UNION ALL SELECT status, reason, count(*) FROM c WHERE status <> 'read' GROUP BY 1, 2")
def sheet_counts(spark, sf):
    return a.import_counts(_imported(spark, sf))


def _slid(spark, sf):
    """(grid, stated): the optional cells of an order in place beside a withheld tax (kind 0), four to the right (1), four to the right
    without stated totals (2), or lost (3)."""
    items, kind = _items(spark, sf), F.col("o") % 4
    row = lambda r: F.when(kind == 0, _row(r["a"], r["c"], r["p"], r["w"], r["g"], "9", "", "")).when(kind == 3, _row(r["a"], r["c"], "", "", r["g"], "9", "", "")).otherwise(_row(r["a"], r["c"], "", "", r["g"], "", r["p"], r["w"]))
    grid = _grid(items, F.concat(F.array(_row("Name", "1", "", "", "1", "", "5", "5")), F.transform("rs", row)))
    total = lambda n: F.when(kind != 2, F.aggregate("rs", F.lit(0).cast("decimal(18,2)"), lambda s, r: (s + r[n].cast("decimal(18,2)")).cast("decimal(18,2)")))
    return grid, items.select(F.col("o").alias("file"), total("p").alias("accrued"), total("w").alias("wash"))


PULLED = f"WITH {ITEMS}, t AS (SELECT o, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(w) AS DOUBLE) AS w FROM l GROUP BY o)"


@query(PULLED + """ SELECT o AS file, CASE o % 4 WHEN 0 THEN 0 WHEN 2 THEN NULL ELSE p END AS gap_accrued, CASE o % 4 WHEN 3 THEN p WHEN 2 THEN NULL ELSE 0 END AS left_accrued,
CASE o % 4 WHEN 0 THEN 0 WHEN 2 THEN NULL ELSE w END AS gap_wash, CASE o % 4 WHEN 3 THEN w WHEN 2 THEN NULL ELSE 0 END AS left_wash, CASE WHEN o % 4 = 1 THEN 4 ELSE 0 END AS distance,
CASE o % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'REPAIRED' WHEN 2 THEN 'N/A' ELSE 'GAP' END AS status FROM t""")
def pulled_back_verdicts(spark, sf):
    """Files whose stated totals disagree are repaired if that closes the gap."""
    grid, stated = _slid(spark, sf)
    _, verdicts = pull_back(grid, stated, ["file"], 2, 4, ["accrued", "wash"], has_date(cell("cells", 0)), fed=5)
    return verdicts.select("file", *[dbl(c).alias(c) for c in verdicts.columns if c.startswith(("gap_", "left_"))], F.coalesce("distance", F.lit(0)).alias("distance"), "status")


@query(f"""WITH {ITEMS} SELECT o AS file, CAST(k AS INTEGER) AS row_idx, CASE WHEN o % 4 < 2 THEN CAST(p AS VARCHAR) ELSE '' END AS accrued, CASE WHEN o % 4 < 2 THEN CAST(w AS VARCHAR) ELSE '' END AS wash, CASE WHEN o % 4 IN (0, 3) THEN '9' ELSE '' END AS tax,
CASE WHEN o % 4 = 2 THEN CAST(p AS VARCHAR) ELSE '' END AS c6, CASE WHEN o % 4 = 2 THEN CAST(w AS VARCHAR) ELSE '' END AS c7 FROM l UNION ALL SELECT DISTINCT o, 0, '', '', '', '5', '5' FROM l""")
def pulled_back(spark, sf):
    """The repaired grid: only files with a gap change, rows that are no transactions never do."""
    grid, stated = _slid(spark, sf)
    fixed, _ = pull_back(grid, stated, ["file"], 2, 4, ["accrued", "wash"], has_date(cell("cells", 0)), fed=5)
    return fixed.select("file", "row_idx", *[cell("cells", k).alias(n) for k, n in ((2, "accrued"), (3, "wash"), (5, "tax"), (6, "c6"), (7, "c7"))])
