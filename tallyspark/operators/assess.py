"""Wide assessment sheets to readings: a rule for each column, a date for each group of columns, and a status for each cell."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import bind, null_if_blank


class Field(NamedTuple):
    """What a sheet's column holds. kind: 'number', 'integer' (the first digits of the text), 'seconds' (a fraction of a day), 'weighted'
    (`33 (130 lbs)`: a count, and a weight for the metric `weight`) or 'derived' (made at report time, not read)."""

    column: str
    metric: str
    component: str
    kind: str = "number"
    weight: str | None = None


#: Date formats of assessment sheets in the order in which they are tried; a month alone is its first day.
SHEET_DATES = ["d/M/yyyy", "yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "MMM yyyy", "MMMM yyyy"]

#: What a text of each format looks like at least; others can't be read by it.
_SHAPES = {f: r"^[^/]+/[^/]+/[^/]+$" if "/" in f else r"^[^-]+-[^-]+-.+$|^-.*-.*-" if "-" in f else r"^\S+ \S+ \S+$" if f.startswith("d ") else r"^\S+ \S+$" for f in SHEET_DATES}


def sheet_date(c: Column) -> Column:
    """DATE of a year (its first day), a serial number of days from 1899-12-30 or a text with the day first; else null."""

    def number(n: Column) -> Column:
        whole = F.when((n == F.floor(n)) & n.between(1900, 2100), F.make_date(n.cast("int"), F.lit(1), F.lit(1)))
        serial = F.when((n >= 1) & (n < 100000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))
        return F.coalesce(whole, serial)

    def read(t: Column) -> Column:
        # A failed cast or parse raises an exception inside, so texts of other shapes aren't tried.
        n = F.when(~t.rlike(r"/|\d-|[^\x00-\x20] +[^\x00-\x20]"), t).try_cast("double")
        return F.coalesce(bind(n, number), *[F.try_to_date(F.when(t.rlike(_SHAPES[f]), t), f) for f in SHEET_DATES])

    return bind(null_if_blank(c), read)


def _values(raw: Column, field: Field) -> Column:
    """The readings of one cell: array of (metric, value); a value that can't be read is null."""
    row = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    bare = F.regexp_replace(raw, r"\s*\([^)]*\)", "")
    if field.kind == "number":
        return F.array(row(field.metric, bare.try_cast("double")))
    if field.kind == "integer":
        return F.array(row(field.metric, F.nullif(F.regexp_extract(bare, r"(\d+)", 1), F.lit("")).try_cast("bigint")))
    if field.kind == "seconds":
        return F.array(row(field.metric, F.round(bare.try_cast("double") * 86400)))
    if field.kind == "weighted" and field.weight:
        count = row(field.metric, F.nullif(F.regexp_extract(bare, r"(\d+)", 1), F.lit("")).try_cast("bigint"))
        weight = F.nullif(F.regexp_extract(raw, r"\(\s*(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
        return F.when(weight.isNull(), F.array(count)).otherwise(F.array(count, row(field.weight, weight)))
    raise ValueError(f"{field.column}: a field of kind {field.kind} can't be read")


def sheet_cells(wide: DataFrame, client: str, fields: list[Field], dates: dict[str, str], order: list[str]) -> DataFrame:
    """One row for each reading of each cell: client, *order, column, component, metric, raw, note (what stood in brackets), date, value,
    status and reason.

    dates: the date column of each component. A blank cell is 'empty', a derived column 'derived'; a text without a number and a
    cell without a date that can be read are an 'error' with its reason; all others are 'read'. A field whose column the sheet
    lacks, or whose component has no date column, is an error of the call. The sheet is read once, without a shuffle."""
    missing = [f.column for f in fields if f.column not in wide.columns] + [f"date of {f.component}" for f in fields if f.kind != "derived" and dates.get(f.component) not in wide.columns]
    if missing:
        raise ValueError(f"the sheet has no {', '.join(missing)}")
    q = lambda c: F.col(f"`{c}`")
    cells = []
    for f in fields:
        raw = null_if_blank(q(f.column))
        date = q(dates[f.component]).cast("string") if f.component in dates else F.lit(None).cast("string")
        none = F.array(F.struct(F.lit(f.metric).alias("metric"), F.lit(None).cast("double").alias("value")))
        values = none if f.kind == "derived" else F.when(raw.isNull(), none).otherwise(_values(raw, f))
        cells.append(F.struct(F.lit(f.column).alias("column"), F.lit(f.component).alias("component"), F.lit(f.kind).alias("kind"), raw.alias("raw"), date.alias("on"), values.alias("values")))
    rows = wide.select(q(client).alias("client"), *[q(o) for o in order], F.explode(F.array(*cells)).alias("_c"))
    rows = rows.select("client", *order, "_c.*").select("*", F.explode("values").alias("_v")).withColumn("date", sheet_date(F.col("on")))
    value = F.when(~F.isnan("_v.value"), F.col("_v.value"))
    status = F.when(F.col("kind") == "derived", "derived").when(F.col("raw").isNull(), "empty").when(value.isNull() | F.col("date").isNull(), "error").otherwise("read")
    reason = F.when(status == "error", F.when(value.isNull(), "no number").otherwise("no date"))
    note = F.nullif(F.regexp_extract("raw", r"\(([^)]*)\)", 1), F.lit(""))
    return rows.select("client", *order, "column", "component", "_v.metric", "raw", note.alias("note"), "date", value.alias("value"), status.alias("status"), reason.alias("reason"))


def import_cells(cells: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """The cells with what becomes of each: of the read ones the last in `order` for a client, date and metric is 'written', if
    `existing` (client, date, metric) doesn't have it yet, and the others are 'duplicate': a second run writes nothing.

    A null client is a client like others. Rows that tie in the whole order are told apart by their column and value."""
    key = ["client", "date", "metric"]
    read = cells.where("status = 'read'")
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order], F.desc("column"), F.desc("value"))
    old = existing.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = F.col("client").eqNullSafe(F.col("_client")) & (F.col("date") == F.col("_date")) & (F.col("metric") == F.col("_metric"))
    one = read.withColumn("_n", F.row_number().over(w)).join(old, same, "left")
    done = one.withColumn("status", F.when((F.col("_n") == 1) & F.col("_metric").isNull(), "written").otherwise("duplicate")).select(*cells.columns)
    return done.unionByName(cells.where("status <> 'read'"))


def new_readings(imported: DataFrame, source: str = "migration") -> DataFrame:
    """The rows to append: client, date, date_text (dd/MM/yyyy), metric, component, value, note, source."""
    text = F.date_format("date", "dd/MM/yyyy")
    return imported.where("status = 'written'").select("client", "date", text.alias("date_text"), "metric", "component", "value", "note", F.lit(source).alias("source"))


def import_counts(imported: DataFrame) -> DataFrame:
    """How many readings were written, are duplicates, empty, derived or errors, by status and reason."""
    return imported.groupBy("status", "reason").agg(F.count("*").alias("n"))
