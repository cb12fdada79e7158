"""Summaries: rollups by period, pivots and matrices with totals, counts with zeros, key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup_by_period(df: DataFrame, group: str, sub: str, period: str, periods: list[str], amount: str) -> DataFrame:
    """Sums of each group and sub-group for each period and in all, with a subtotal for groups of more than one
    sub-group and a grand total without the subtotals; a period without rows is null, not 0.

    level: 'row', 'subtotal' or 'total'. One shuffle: conditional sums over a rollup."""
    data = df.withColumn(sub, F.coalesce(F.nullif(F.trim(sub), F.lit("")), F.lit("(unspecified)")))
    sums = [F.sum(F.when(F.col(period) == p, F.col(amount))).alias(p) for p in periods]
    rolled = data.rollup(group, sub).agg(F.grouping_id().alias("_g"), F.count_distinct(sub).alias("_subs"), *sums, F.sum(amount).alias("total"))
    kept = rolled.where((F.col("_g") != 1) | (F.col("_subs") > 1))
    level = F.when(F.col("_g") == 0, "row").when(F.col("_g") == 1, "subtotal").otherwise("total")
    return kept.select(F.when(F.col("_g") == 3, "GRAND TOTAL").otherwise(F.col(group)).alias(group), F.when(F.col("_g") == 0, F.col(sub)).otherwise("").alias(sub), level.alias("level"), *periods, "total")


def with_total(df: DataFrame, label: str, text: str = "TOTAL") -> DataFrame:
    """One more row with the sums of every number column."""
    numbers = [f.name for f in df.schema if f.dataType.typeName() in ("decimal", "double", "long", "integer")]
    total = df.agg(*[F.sum(c).cast(df.schema[c].dataType).alias(c) for c in numbers]).withColumn(label, F.lit(text))
    return df.unionByName(total, allowMissingColumns=True)


def section_pivot(df: DataFrame, by: str, section: str, sections: list[str], amount: str) -> DataFrame:
    """A column of sums for each section, their Net, and a TOTAL row."""
    out = df.groupBy(by).pivot(section, sections).agg(F.sum(amount))
    net = sum((F.coalesce(F.col(s), F.lit(0)) for s in sections), F.lit(0))
    return with_total(out.withColumn(by, F.col(by).cast("string")).withColumn("Net", net), by)


def matrix(df: DataFrame, row: str, column: str, columns: list[str], amount: str, other: str = "OTHER") -> DataFrame:
    """Rows by a fixed list of columns; what the list lacks is in OTHER, with TOTAL by row and by column."""
    named = df.withColumn("_c", F.when(F.col(column).isin(columns), F.col(column)).otherwise(other))
    out = named.groupBy(row).pivot("_c", [*columns, other]).agg(F.sum(amount)).na.fill(0)
    return with_total(out.withColumn("TOTAL", sum((F.col(c) for c in [*columns, other]), F.lit(0))), row)


def three_levels(df: DataFrame, section: str, sub: str, line: str, amount: str) -> DataFrame:
    return df.groupBy(section, sub, line).agg(F.sum(amount).alias("total"), F.count("*").alias("n"))


def key_figures(df: DataFrame, figures: dict[str, Column], amount: str) -> DataFrame:
    """(figure, value): a conditional sum for each name, in one pass over the rows."""
    sums = df.agg(*[F.coalesce(F.sum(F.when(c, F.col(amount))), F.lit(0)).alias(n) for n, c in figures.items()])
    return sums.unpivot([], list(figures), "figure", "value")


def counts_with_zero(dim: DataFrame, facts: DataFrame, key: str, exclude: list | None = None) -> DataFrame:
    """n rows of facts for each key of the dimension, 0 included."""
    keys = dim if not exclude else dim.where(~F.col(key).isin(exclude))
    return keys.join(facts.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def period_summary(rows: DataFrame, stated: DataFrame, by: list[str], order: str, subtracted: str, added: str) -> DataFrame:
    """Counts, parsed sums and net of each key beside the last stated totals, with the gaps."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(subtracted).alias("parsed_subtracted"), F.sum(added).alias("parsed_added"))
    last = stated.groupBy(*by).agg(F.max_by("stated_subtracted", order).alias("stated_subtracted"), F.max_by("stated_added", order).alias("stated_added"))
    out = sums.join(last, by, "left").withColumn("net", F.col("parsed_added") - F.col("parsed_subtracted"))
    return out.withColumn("gap_subtracted", F.col("stated_subtracted") - F.col("parsed_subtracted")).withColumn("gap_added", F.col("stated_added") - F.col("parsed_added"))


def lot_summary(df: DataFrame, description: str, proceeds: str, cost: str, wash: str, fed: str | None = None, by: list[str] | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n_rows"), F.count_distinct(description).alias("n_descriptions"), F.sum(proceeds).alias("proceeds"), F.sum(cost).alias("cost"), F.count_if(F.col(wash) > 0).alias("n_wash")]
    return df.groupBy(*(by or [])).agg(*aggs, *([F.sum(fed).alias("fed_tax")] if fed else []))


def signed_check(df: DataFrame, column: str, parsed: Column, by: list[str] | None = None) -> DataFrame:
    """Counts of a signed column, in all or for each key: filled, unreadable, negative, positive, zero."""
    v = F.col(column)
    return df.groupBy(*(by or [])).agg(F.count(v).alias("filled"), F.count_if(v.isNotNull() & parsed.isNull()).alias("unreadable"), F.count_if(parsed < 0).alias("negative"), F.count_if(parsed > 0).alias("positive"), F.count_if(parsed == 0).alias("zero"))


def snapshot_pivot(lists: DataFrame, cards: DataFrame, dates: list[str]) -> DataFrame:
    """Open cards of each list on each date, in the lists' order, 0 where there are none, and a TOTAL row.

    lists (id, name, pos), cards (list_id, closed, snapshot_date); a card of an unknown list counts as Unknown (id)."""
    open_cards = cards.where(~F.col("closed")).join(lists.select(F.col("id").alias("list_id"), "name", "pos"), "list_id", "left")
    named = open_cards.withColumn("name", F.coalesce("name", F.concat(F.lit("Unknown ("), F.col("list_id").cast("string"), F.lit(")")))).withColumn("pos", F.coalesce("pos", F.lit(1e9)))
    empty = lists.select("name", F.col("pos").cast("double").alias("pos"), F.lit(None).cast("string").alias("snapshot_date"))
    rows = named.select("name", F.col("pos").cast("double").alias("pos"), F.col("snapshot_date").cast("string").alias("snapshot_date")).unionByName(empty)
    return with_total(rows.groupBy("name", "pos").agg(*[F.count_if(F.col("snapshot_date") == d).alias(d) for d in dates]), "name")


def infer_types(df: DataFrame, columns: list[str], number: dict[str, Column], date: dict[str, Column], first: tuple[str, int] | None = None, years: tuple[int, int] = (1990, 2035)) -> DataFrame:
    """(column, type): date if 80 % of the filled cells are dates in the years, else number if 80 % are numbers, else text.
    With `first` (order column, n) only the n least rows by that order are looked at, as a preview does."""
    if first:
        df = df.orderBy(first[0]).limit(first[1])
    date = {c: F.when(F.year(d).between(*years), d) for c, d in date.items()}
    aggs = []
    for c in columns:
        aggs += [F.avg(F.when(F.col(c).isNotNull(), date[c].isNotNull().cast("double"))).alias(f"d_{c}"), F.avg(F.when(F.col(c).isNotNull(), number[c].isNotNull().cast("double"))).alias(f"n_{c}")]
    kind = F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(f"d_{c}") >= 0.8, "date").when(F.col(f"n_{c}") >= 0.8, "number").otherwise("text").alias("type")) for c in columns])
    return df.agg(*aggs).select(F.explode(kind).alias("k")).select("k.*")


def cheapest(quotes: DataFrame, by: list[str], cost: str, within: float = 1.0) -> DataFrame:
    return quotes.withColumn("cheapest", F.col(cost) <= F.min(cost).over(Window.partitionBy(*by)) + within)


def amortise(loans: DataFrame, keys: list[str], principal: str, rate: str, months: str) -> DataFrame:
    """month, interest, cumulative interest and balance of each loan at every max(1, n / 24) months and the last.

    The balance is closed form, so months are rows and not steps."""
    r = F.col(rate) / 1200
    grown = F.pow(1 + r, F.col("month"))
    pay = F.when(r == 0, F.col(principal) / F.col(months)).otherwise(F.col(principal) * r * F.pow(1 + r, F.col(months)) / (F.pow(1 + r, F.col(months)) - 1))
    balance = F.when(r == 0, F.col(principal) - pay * F.col("month")).otherwise(F.col(principal) * grown - pay * (grown - 1) / r)
    rows = loans.withColumn("month", F.explode(F.sequence(F.lit(1), F.col(months)))).withColumn("balance", F.when(F.round(balance, 2) <= 0, 0.0).otherwise(F.round(balance, 2)))
    rows = rows.withColumn("cumulative_interest", F.round(pay * F.col("month") - (F.col(principal) - balance), 2))
    return rows.where((F.col("month") % F.greatest(F.lit(1), F.floor(F.col(months) / 24)) == 0) | (F.col("month") == F.col(months))).select(*keys, "month", "balance", "cumulative_interest")


def with_income(rolled: DataFrame, income: DataFrame, group: str, sub: str, period: str, periods: list[str], amount: str, label: str = "Income") -> DataFrame:
    """A rollup by period with one more row, level 'income', of what came in; it is no part of the grand total."""
    sums = [F.sum(F.when(F.col(period) == p, F.col(amount))).alias(p) for p in periods]
    row = income.agg(*sums, F.sum(amount).alias("total")).select(F.lit(label).alias(group), F.lit("").alias(sub), F.lit("income").alias("level"), *periods, "total")
    return rolled.unionByName(row)


def expense_matrix(income: DataFrame, expenses: DataFrame, kind: str, column: str, columns: list[str], amount: str, preferred: list[str], labels: tuple[str, str, str] = ("Rental Income", "Total Expenses", "Net Rental Income")) -> DataFrame:
    """Rows place, kind, the fixed columns and TOTAL: the income row, a row for each kind of expense in the preferred order
    (others after them, by name), total expenses, net. What isn't in the columns is left out. place counts from 1; an
    expense cell without rows is null, an income cell 0. The kinds are few: their places come from a window over them."""
    sums = [F.sum(F.when(F.col(column) == c, F.col(amount))).alias(c) for c in columns]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,2)")
    total = lambda df: df.withColumn("TOTAL", sum((zero(c) for c in columns), F.lit(0)).cast("decimal(28,2)"))
    named = lambda df, text, order: df.select(F.lit(order).alias("_o"), F.lit(text).alias(kind), *[zero(c).alias(c) for c in columns])
    inside = expenses.where(F.col(column).isin(columns))
    per = inside.groupBy(kind).agg(*sums)
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col(kind))
    order = F.when(at > 0, at).otherwise(F.lit(len(preferred) + 1))
    rows = total(per.select((F.lit(1000) + order).cast("int").alias("_o"), kind, *[F.col(c).cast("decimal(28,2)").alias(c) for c in columns]))
    came = income.agg(*sums)
    spent = inside.agg(*sums)
    net = came.select(*[zero(c).alias(c) for c in columns]).unionByName(spent.select(*[zero(c).alias(c) for c in columns])).agg(*[F.sum(c).alias(c) for c in columns])
    whole = total(named(came, labels[0], 0)).unionByName(rows).unionByName(total(named(spent, labels[1], 1_000_000))).unionByName(total(named(net, labels[2], 1_000_001)))
    w = Window.partitionBy(F.lit("matrix")).orderBy("_o", kind)
    return whole.withColumn("place", F.row_number().over(w)).select("place", kind, *columns, "TOTAL")


def in_order(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """The place of each row in its group from 1, by the columns in rising order with nulls last."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*[F.asc_nulls_last(c) for c in order])))


def sorted_readings(df: DataFrame, by: list[str], date: str, value: str, name: str = "readings") -> DataFrame:
    """The readings of each key as an array of (date, value) in the order of their dates. A key's readings are few."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(date, value))).alias(name))


def stacked(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables under the columns of all, null where a table lacks one."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def with_names(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """The display name of a key from a dimension (key, name), or the key itself where it has none."""
    n = names.select(F.col(key).alias("_key"), F.col(name).alias("_name")).dropDuplicates(["_key"])
    return df.join(n, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_name", F.col(key).cast("string"))).drop("_key", "_name")


def result_status(result: DataFrame, asked: DataFrame, keys: list[str], none_asked: str, none_found: str) -> DataFrame:
    """(.., status, message) for each asked key: ok with rows in the result, else error with the message none_found; with no
    asked keys at all, one error row with none_asked. An empty result is a value, not a failure."""
    found = result.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = asked.select(*keys).distinct().join(found, keys, "left")
    ok = F.coalesce(F.col("_n"), F.lit(0)) > 0
    rows = out.select(*keys, F.when(ok, "ok").otherwise("error").alias("status"), F.when(~ok, F.lit(none_found)).alias("message"))
    none = asked.agg(F.count("*").alias("_n")).where("_n = 0").select(*[F.lit(None).cast(asked.schema[k].dataType).alias(k) for k in keys], F.lit("error").alias("status"), F.lit(none_asked).alias("message"))
    return rows.unionByName(none)


def typed_columns(df: DataFrame, types: dict[str, str], number: dict[str, Column], date: dict[str, Column]) -> DataFrame:
    """Each column beside its typed value (<column>_number or <column>_date); the text itself stays where it can't be read."""
    out = df
    for c, kind in types.items():
        if kind == "date":
            out = out.withColumn(f"{c}_date", date[c])
        elif kind != "text":
            out = out.withColumn(f"{c}_number", number[c])
    return out


def totals_by_levels(df: DataFrame, category: str, account: str, currency: str, amount: str) -> DataFrame:
    """n and total of each category by account and currency, by either, and in all: grouping sets of one pass. level says which of
    both a row is for ('account', 'currency', 'both', 'all'); a null account or currency of the rows stays a group of its own."""
    sets = df.groupingSets([[category, account, currency], [category, account], [category, currency], [category]], category, account, currency)
    out = sets.agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.grouping(account).alias("_a"), F.grouping(currency).alias("_c"))
    level = F.when((F.col("_a") == 0) & (F.col("_c") == 0), "both").when(F.col("_a") == 0, "account").when(F.col("_c") == 0, "currency").otherwise("all")
    return out.withColumn("level", level).drop("_a", "_c")
