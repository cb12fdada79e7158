import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.text import has_date
from tallyspark.operators import assess as a
from tallyspark.operators.grid import cell
from tallyspark.operators.repair import pull_back

FIELDS = [a.Field("Weight", "weight_kg", "vitals"), a.Field("BMI", "bmi", "vitals", "derived"), a.Field("Pushups", "pushups", "physio", "integer"), a.Field("Pullups", "reps", "physio", "weighted", "weight"), a.Field("5. Plank", "plank", "physio", "seconds")]
DATES = {"vitals": "V", "physio": "P"}
SHEET = "client string, n int, V string, Weight string, BMI string, P string, Pushups string, Pullups string, `5. Plank` string"


def test_sheet_dates(spark):
    cases = {"46082": dt.date(2026, 3, 1), "2019": dt.date(2019, 1, 1), "Oct 2022": dt.date(2022, 10, 1), "15/5/2021": dt.date(2021, 5, 15), "2021-05-15": dt.date(2021, 5, 15), "3 May 2020": dt.date(2020, 5, 3), "soon": None, " ": None, "31/02/2020": None}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", a.sheet_date(F.col("c")).alias("d")).collect()
    assert {r.c: r.d for r in got} == cases


def test_readings_of_a_sheet(spark):
    rows = [("T", 1, "2020", "81.5", "24", "Oct 2022", "14 (M)", "33 (130 lbs)", "0.000289"), ("T", 2, "2020", "80", None, "Oct 2022", None, "7 (No weights)", "x"), (None, 3, None, "70", None, "?", "5", None, None)]
    cells = a.sheet_cells(spark.createDataFrame(rows, SHEET), "client", FIELDS, DATES, ["n"])
    none = cells.where("false")
    first = a.import_cells(cells, none, ["n"])
    new = a.new_readings(first)
    got = sorted((r.client, r.date_text, r.metric, r.value, r.note) for r in new.collect())
    assert got == [("T", "01/01/2020", "weight_kg", 80.0, None), ("T", "01/10/2022", "plank", 25.0, None), ("T", "01/10/2022", "pushups", 14.0, "M"), ("T", "01/10/2022", "reps", 7.0, "No weights"), ("T", "01/10/2022", "weight", 130.0, "130 lbs")]
    counts = {(r.status, r.reason): r.n for r in a.import_counts(first).collect()}
    assert counts == {("written", None): 5, ("duplicate", None): 2, ("derived", None): 3, ("empty", None): 3, ("error", "no number"): 1, ("error", "no date"): 2}
    again = a.import_cells(cells, new, ["n"])
    assert a.new_readings(again).count() == 0 and again.where("status = 'duplicate'").count() == 7
    empty = a.import_cells(none, none, ["n"])
    assert empty.count() == 0 and a.import_counts(empty).count() == 0
    with pytest.raises(ValueError, match="Height, date of other"):
        a.sheet_cells(spark.createDataFrame(rows, SHEET), "client", [a.Field("Height", "h", "vitals"), a.Field("Weight", "w", "other")], DATES, ["n"])


def test_cells_come_back_only_where_totals_disagree(spark):
    d = "01/02/2020"
    rows = [
        ("slid", 0, [d, "10", "", None, "5", "", "1.50", "(2.00)"]), ("slid", 1, [d, "10", "3", "", "5", "", "7", "7"]), ("slid", 2, ["x", "", "", "", "", "", "9", "9"]), ("slid", 3, [d]),
        ("fine", 0, [d, "10", "1", "2", "5", "8", "9", "9"]), ("fine", 1, [d, "10", "", "", "5", "8", "9", "9"]),
        ("tax", 0, [d, "10", "", "", "5", "4", "6", ""]), ("open", 0, [d, "10", "", "", "5", "", "1", "1"]), ("quiet", 0, [d, "10", "", "", "5", "", "1", "1"]), ("one", 0, [d, "10", "", "", "5", "", "", "6"]),
    ]
    grid = spark.createDataFrame([(f, 0, "s", i, c) for f, i, c in rows], "file string, sheet_idx int, sheet string, row_idx int, cells array<string>")
    stated = spark.createDataFrame([("slid", 4.5, -2.0), ("fine", 1.0, 2.0), ("tax", 4.0, 6.0), ("open", 2.0, 1.0), ("one", None, 6.0), ("absent", 1.0, 1.0)], "file string, acc double, wash double")
    fixed, verdicts = pull_back(grid, stated, ["file"], 2, 4, ["acc", "wash"], has_date(cell("cells", 0)), fed=5)
    got = {(r.file, r.row_idx): r.cells for r in fixed.collect()}
    want = {(f, i): c for f, i, c in rows}
    want[("slid", 0)] = [d, "10", "1.50", "(2.00)", "5", "", "", ""]
    want[("one", 0)] = [d, "10", "", "6", "5", "", "", ""]
    assert got == want
    assert {(r.file, r.status, r.distance) for r in verdicts.collect()} == {("slid", "REPAIRED", 4), ("fine", "MATCH", None), ("tax", "GAP", None), ("open", "GAP", None), ("quiet", "N/A", None), ("one", "REPAIRED", 4)}
    again, after = pull_back(fixed, stated, ["file"], 2, 4, ["acc", "wash"], has_date(cell("cells", 0)), fed=5)
    assert {(r.file, r.row_idx): r.cells for r in again.collect()} == want and after.where("status = 'REPAIRED'").count() == 0
