"""What is computed for a row more often than once, where that made a query slow."""

from datetime import date

from pyspark.sql import functions as F

from tallyspark.functions.measures import effective_rate
from tallyspark.operators.assess import sheet_date


def test_the_steps_of_a_rate_use_bound_values(spark):
    df = spark.createDataFrame([(1200.0,), (2400.0,), (0.0,)], "p double")
    principal = F.round(F.col("p"), 2)
    out = df.select(effective_rate(principal, (principal + principal * 0.35) / 60, F.lit(60)).alias("rate"))
    rates = [r.rate for r in out.collect()]
    assert rates[0] == rates[1] and 12 < rates[0] < 13
    assert out._jdf.queryExecution().optimizedPlan().toString().count("round(p") <= 3


def test_dates_of_every_shape(spark):
    texts = ["5/3/1996", "1996-03-05", "5 Mar 1996", "5 March 1996", "Mar 1996", "March 1996", "1996", "35129", " 35129.5 ", "soon", "1996 \n"]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sheet_date(F.col("t")).alias("d")).collect()]
    day, month = date(1996, 3, 5), date(1996, 3, 1)
    assert got == [day, day, day, day, month, month, date(1996, 1, 1), date(1996, 3, 5), date(1996, 3, 5), None, date(1996, 1, 1)]


def test_dates_and_amounts_of_cells_by_patterns(spark):
    from tallyspark.functions.text import has_date, money_text, parse_money

    parts = ["01/02/2020", "1-2-20", "2020-01-02 x", "Various", " ", "$", "\n", "\t", "x", "12", "1,234.56", "(1.5)", "W", "1e3", "--", "1.2.3"]
    df = spark.createDataFrame([(a + b + c,) for a in parts for b in parts for c in parts] + [(None,)], "c string")
    c = F.col("c")
    assert df.where(~parse_money(c).eqNullSafe(money_text(c).try_cast("decimal(18,2)"))).count() == 0
    assert "exists(" not in df.select(has_date(c))._jdf.queryExecution().optimizedPlan().toString()


def test_a_grid_with_headers_is_read_once(spark):
    from tallyspark.operators.lots import lots

    grid = spark.createDataFrame([("f", 0, "s", 0, ["x"])], "file string, sheet_idx int, sheet string, row_idx int, cells array<string>")
    plan = lots(grid, "robinhood")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    # A text of a row is put together and lowered once, not for each word that it may hold.
    assert plan.count("lower(array_join") <= 2


def test_kinds_of_rows_and_amounts_of_pairs_are_computed_once(spark):
    from tallyspark.functions.text import _DATE_LINE
    from tallyspark.operators.lots import lots

    grid = spark.createDataFrame([("f", 0, "s", 0, ["x"])], "file string, sheet_idx int, sheet string, row_idx int, cells array<string>")
    plan = lots(grid, "charles_schwab").select("proceeds", "cost")._jdf.queryExecution().optimizedPlan().treeString()
    assert plan.count(_DATE_LINE) == 1
    assert plan.count("total|totals") == 1


def test_a_numbered_row_is_matched_once_for_all_its_parts(spark):
    from tallyspark.operators.statements import numbered_rows

    texts = ["1 06 Jan 2025 06 Jan 2025 a\u0001b  c +1,234.50 12,345,678.00\u0085", "2 06  Feb 2025 06 Jan 2025 shop REF1234567890 -5.00 1,2,3.00 ", "3 31 Foo 2025 06 Jan 2025 x 5.00 1.00", "4 06 Jan 2025 x 5.00"]
    lines = spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(texts)], "file string, page_idx int, line_idx int, text string")
    out = numbered_rows(lines)
    got = [(r.date, r.description, str(r.amount), str(r.balance)) for r in out.orderBy("line_idx").collect()]
    assert got == [("2025-01-06", "a\u0001b  c", "1234.50", "12345678.00"), ("2025-02-06", "shop", "-5.00", "123.00"), (None, "x", "5.00", "1.00")]
    assert out._jdf.queryExecution().optimizedPlan().treeString().count(r"\d{4})\s+\d{2}") == 2


def test_items_are_dealt_by_their_rows(spark, monkeypatch):
    from tallyspark.plans import common, layouts

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(common, "ROWS_A_TASK", 500)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert layouts._items(spark, sf).rdd.getNumPartitions() == -(-rows // 500)


def test_lines_are_dealt_by_their_rows_and_markers_are_looked_for_once(spark, monkeypatch):
    from tallyspark.operators import statements as st
    from tallyspark.plans import common, pages

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(common, "ROWS_A_TASK", 500)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    lines = pages._lines(spark, sf)
    assert lines.rdd.getNumPartitions() == -(-rows // 500)
    plan = st.dated_lines(spark.createDataFrame([("f", 0, 0, "x")], "file string, page_idx int, line_idx int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("OLR") == 1


def test_words_by_their_first_character_are_the_same_words(spark):
    from tallyspark.functions.text import contains_any
    from tallyspark.operators.statements import MARKERS

    words = [*MARKERS, "^x", "-y]", "é z", "\\d", "a&&b"]
    texts = [f"{a}{w[:k]}{b}" for w in words for k in (1, len(w) - 1, len(w)) for a in ("", "1 ", "q") for b in ("", ".", "Z")]
    texts += [t.swapcase() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    body = "|".join(r"\Q" + w + r"\E" for w in words)
    assert df.where(contains_any(F.col("t"), words) != F.col("t").rlike(f"(?i)(?:{body})")).count() == 0
    assert df.where(contains_any(F.col("t"), words, whole=True) != F.col("t").rlike(rf"(?i)(?:^|[^A-Za-z0-9_])(?:{body})(?:$|[^A-Za-z0-9_])")).count() == 0


def test_statements_are_made_in_the_tasks_of_their_items(spark, monkeypatch):
    from tallyspark.plans import common, pages

    monkeypatch.setattr(common, "ROWS_A_TASK", 1000)
    statement = pages._statement(spark, "/root/testdata/sf0.001")
    assert statement.rdd.getNumPartitions() == pages._lines(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 5
