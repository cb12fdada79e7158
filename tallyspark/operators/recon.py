"""Operators that hold parsed rows against stated figures and tables against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stated_vs_parsed(parsed: DataFrame, stated: DataFrame, by: list[str], amount: str, total: str, tolerance: float = 0.01) -> DataFrame:
    """parsed sum, stated total, gap and status (MATCH, GAP, N/A without a stated total) for each key."""
    sums = parsed.groupBy(*by).agg(F.sum(amount).alias("parsed"), F.count("*").alias("n_rows"))
    out = sums.join(stated.select(*by, F.col(total).alias("stated")), by, "full_outer")
    gap = F.col("stated") - F.coalesce("parsed", F.lit(0))
    return out.withColumn("gap", gap).withColumn("status", F.when(F.col("stated").isNull(), "N/A").when(F.abs(gap) > tolerance, "GAP").otherwise("MATCH"))


def sentinel_rows(rows: DataFrame, recon: DataFrame, by: list[str], amount: str, description: str, label: str = "MISSING ROWS", tolerance: float = 0.01) -> DataFrame:
    """The rows with one more for each key whose gap is over the tolerance: it carries the gap and the flag VERIFY."""
    missing = recon.where(F.abs("gap") > tolerance).select(*by, F.col("gap").cast(rows.schema[amount].dataType).alias(amount), F.lit(label).alias(description), F.lit("VERIFY").alias("flag"))
    return rows.withColumn("flag", F.lit(None).cast("string")).unionByName(missing, allowMissingColumns=True)


def drop_phantom(rows: DataFrame, recon: DataFrame, by: list[str], order: list[str], amount: str, tolerance: float = 0.02) -> DataFrame:
    """If the parsed sum exceeds the stated one by just one row's amount, the first such row goes."""
    excess = recon.select(*by, (-F.col("gap")).alias("_excess")).where(F.col("_excess") > tolerance)
    hit = rows.join(excess, by).where(F.abs(F.col(amount) - F.col("_excess")) <= tolerance)
    first = hit.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").select(*by, *order)
    return rows.join(first, [*by, *order], "left_anti")


def outer_status(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys of both sides with status matched, only_left or only_right."""
    a, b = left.select(*by).distinct().withColumn("_a", F.lit(True)), right.select(*by).distinct().withColumn("_b", F.lit(True))
    return a.join(b, by, "full_outer").select(*by, F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_a"), "only_left").otherwise("only_right").alias("status"))


def number_gaps(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Numbers missing between the least and the greatest of a key: from each number to the next."""
    w = Window.partitionBy(*by).orderBy(number)
    steps = df.select(*by, number).distinct().withColumn("_next", F.lead(number).over(w)).where(F.col("_next") > F.col(number) + 1)
    return steps.select(*by, F.explode(F.sequence(F.col(number) + 1, F.col("_next") - 1)).alias(number))


def table_diff(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.01, most: int = 20) -> DataFrame:
    """Cells that differ between two tables on their common columns: keys, the occurrence of repeated keys,
    column, left and right text. Blank and zero are the same, numbers may differ by the tolerance; a row that
    one side lacks gives one line with the column null. At most `most` cells of a column are reported."""
    common = [c for c in left.columns if c in right.columns and c not in keys]
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(*common))
    norm = lambda c: F.when(F.trim(c.cast("string")).isin("", "0", "0.0", "0.00"), None).otherwise(F.trim(c.cast("string")))
    side = lambda df, p: df.select(*keys, pos.alias("occurrence"), F.lit(True).alias(f"{p}_here"), *[norm(F.col(c)).alias(f"{p}_{c}") for c in common])
    both = side(left, "l").join(side(right, "r"), [*keys, "occurrence"], "full_outer")

    def differ(c: str) -> Column:
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        x, y = F.coalesce(a.try_cast("double"), F.lit(0.0)), F.coalesce(b.try_cast("double"), F.lit(0.0))
        number = (a.isNull() | a.try_cast("double").isNotNull()) & (b.isNull() | b.try_cast("double").isNotNull())
        return F.when(number, F.abs(x - y) > tolerance).otherwise(~a.eqNullSafe(b))

    whole = F.col("l_here") & F.col("r_here")
    lines = [F.when(F.coalesce(whole, F.lit(False)) & differ(c), F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value"))) for c in common]
    absent = F.when(~F.coalesce(whole, F.lit(False)), F.struct(F.lit(None).cast("string").alias("column"), F.when(F.col("l_here"), "present").alias("left_value"), F.when(F.col("r_here"), "present").alias("right_value")))
    cells = both.select(*keys, "occurrence", F.explode(F.filter(F.array(*lines, absent), lambda x: x.isNotNull())).alias("d")).select(*keys, "occurrence", "d.*")
    # The plain filter on the row number lets Spark limit the rows of a column before they are shuffled.
    w = Window.partitionBy("column").orderBy(*keys, "occurrence")
    reported = cells.where(F.col("column").isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return reported.unionByName(cells.where(F.col("column").isNull()))


def content_check(left: DataFrame, right: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """MATCH or MISMATCH of the ordered lines of each key."""
    lines = lambda df, n: df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias(n))
    return lines(left, "_l").join(lines(right, "_r"), by, "full_outer").select(by, F.when(F.col("_l").eqNullSafe(F.col("_r")), "MATCH").otherwise("MISMATCH").alias("status"))


def account_recon(rows: DataFrame, by: list[str], amount: str, opening: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """credits, debits, net, computed closing, gap and status of each account against (opening, closing)."""
    sums = rows.groupBy(*by).agg(F.coalesce(F.sum(F.expr(f"if({amount} > 0, {amount}, null)")), F.lit(0)).alias("credits"), F.coalesce(F.sum(F.expr(f"if({amount} < 0, -{amount}, null)")), F.lit(0)).alias("debits"))
    out = sums.join(opening, by, "left").withColumn("net", F.col("credits") - F.col("debits")).withColumn("computed_closing", F.col("opening") + F.col("net"))
    gap = F.col("closing") - F.col("computed_closing")
    return out.withColumn("gap", gap).withColumn("status", F.when(gap.isNull(), "N/A").when(F.abs(gap) > tolerance, "GAP").otherwise("MATCH"))


def validate(df: DataFrame, required: list[str], core: list[str], amounts: list[str]) -> DataFrame:
    """Lines (rule, severity, n): missing columns, fully empty core columns, rows without any core value."""
    spark = df.sparkSession
    missing = [(f"missing column {c}", "error", 1) for c in required if c not in df.columns]
    here = [c for c in core if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in here], F.count_if(reduce(lambda a, b: a & b, [F.col(c).isNull() for c in amounts])).alias("_none"), F.count("*").alias("_all"))
    lines = F.array(*[F.struct(F.lit(f"empty column {c}").alias("rule"), F.lit("warning").alias("severity"), F.when((F.col(c) == 0) & (F.col("_all") > 0), 1).otherwise(0).cast("bigint").alias("n")) for c in here], F.struct(F.lit("rows without values").alias("rule"), F.lit("warning").alias("severity"), F.col("_none").alias("n")))
    found = counts.select(F.explode(lines).alias("x")).select("x.*").where("n > 0")
    return found.unionByName(spark.createDataFrame(missing, "rule string, severity string, n bigint")) if missing else found
