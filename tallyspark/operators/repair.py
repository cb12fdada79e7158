"""A further repair of grids that runs only where a file's stated totals say that something is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import is_money, parse_money
from tallyspark.operators.grid import blank, cell


def pull_back(grid: DataFrame, stated: DataFrame, by: list[str], first: int, gain: int, optional: list[str], transaction: Column, fed: int | None = None, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(grid, verdicts): optional cells that slid right of the gain come back in files whose totals disagree with the stated ones.

    The optional columns stand side by side from `first` on, left of `gain`; `stated` has a total for each by its name, null if the
    file states none. Files with a gap try to move the whole block back from each distance, on transaction rows where its own places are
    blank and the distant ones hold numbers or blanks, never over the withheld tax at `fed`. The least distance that closes all gaps is
    taken; if none does, the file stays as it is. Verdicts: for each file gap_<name> before and left_<name> after (stated less
    parsed), the distance, and MATCH, REPAIRED, GAP or N/A (nothing stated). An empty grid has no verdicts."""
    own = [first + k for k in range(len(optional))]
    add = lambda c: F.coalesce(F.sum(parse_money(c)), F.lit(0).cast("decimal(18,2)"))
    sums = grid.where(transaction).groupBy(*by).agg(*[add(cell("cells", k)).alias(n) for k, n in zip(own, optional)])
    files = grid.select(*by).distinct().join(sums, by, "left")
    said = stated.select(*by, *[F.col(n).cast("decimal(18,2)").alias(f"_{n}") for n in optional])
    judged = files.join(said, by, "left").select(*by, *[(F.col(f"_{n}") - F.coalesce(n, F.lit(0).cast("decimal(18,2)"))).alias(f"gap_{n}") for n in optional])
    closed = lambda left: reduce(lambda a, b: a & b, [F.coalesce(F.abs(left(n)) <= tolerance, F.lit(True)) for n in optional])
    unknown = reduce(lambda a, b: a & b, [F.col(f"gap_{n}").isNull() for n in optional])
    gaps = judged.where(~closed(lambda n: F.col(f"gap_{n}")))

    away = lambda d: F.array(*[cell("cells", F.lit(k) + d) for k in own])
    empty = F.forall(F.array(*[cell("cells", k) for k in own]), blank)
    number = lambda c: F.coalesce(is_money(c), F.lit(False))
    fits = lambda d: F.forall(away(d), lambda c: blank(c) | number(c)) & F.exists(away(d), number)
    taxed = [] if fed is None else [fed - k for k in own]
    reach = F.size("cells") - 1 - first
    distances = F.when(reach > gain - first, F.sequence(F.lit(gain - first + 1), reach))
    free = grid.where(transaction & empty).join(gaps.select(*by), by, "left_semi").withColumn("_d", F.explode(distances)).where(fits(F.col("_d")))
    if taxed:
        free = free.where(~F.col("_d").isin(taxed))
    moved = free.groupBy(*by, "_d").agg(*[add(cell("cells", F.lit(k) + F.col("_d"))).alias(f"_{n}") for k, n in zip(own, optional)])
    closing = moved.join(gaps, by).where(closed(lambda n: F.col(f"gap_{n}") - F.col(f"_{n}")))
    best = closing.groupBy(*by).agg(F.min(F.struct("_d", *[f"_{n}" for n in optional])).alias("_b")).select(*by, "_b.*")

    d = F.col("_d")
    here = F.col("_d").isNotNull() & transaction & empty & fits(d)
    back = F.transform("cells", lambda c, i: F.when(i.isin(own), F.coalesce(cell("cells", i + d), c)).when((i - d).isin(own), F.lit("")).otherwise(c))
    fixed = grid.join(best.select(*by, "_d"), by, "left").withColumn("cells", F.when(F.coalesce(here, F.lit(False)), back).otherwise(F.col("cells"))).select(*grid.columns)
    left = [F.when(d.isNull(), F.col(f"gap_{n}")).otherwise(F.col(f"gap_{n}") - F.col(f"_{n}")).alias(f"left_{n}") for n in optional]
    status = F.when(unknown, "N/A").when(d.isNotNull(), "REPAIRED").when(closed(lambda n: F.col(f"gap_{n}")), "MATCH").otherwise("GAP")
    verdicts = judged.join(best, by, "left").select(*by, *[f"gap_{n}" for n in optional], *left, d.alias("distance"), status.alias("status"))
    return fixed, verdicts
