"""Operators on cell grids: rows (file, sheet_idx, sheet, row_idx, cells ARRAY<STRING>) of ragged width."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import has_date, is_money, null_if_blank, parse_money
from tallyspark.operators.shared import computed


def cell(cells: Column | str, at: int | Column) -> Column:
    """The cell at a position from 0, or null beyond the row."""
    return F.get(F.col(cells) if isinstance(cells, str) else cells, at if isinstance(at, Column) else F.lit(at))


def blank(c: Column) -> Column:
    return null_if_blank(c).isNull()


def filled(cells: Column | str) -> Column:
    """The cells that aren't blank."""
    return F.filter(cells, lambda c: ~blank(c))


def first_where(cells: Column | str, test, start: Column | int = 0) -> Column:
    """Position from 0 of the first cell at or after `start` that passes the test, or null."""
    at = F.array_position(F.transform(cells, lambda c, i: F.coalesce(test(c), F.lit(False)) & (i >= start)), F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def _at(k: int | Column) -> Column:
    return k if isinstance(k, Column) else F.lit(k)


def shift_left(df: DataFrame, column: int | Column, cells: str = "cells", test=has_date) -> DataFrame:
    """Right-shift repair: if the cell at `column` fails the test, everything from the first later cell that
    passes moves left to it and nulls fill the end. offset: cells moved, 0 for none."""
    column = _at(column)
    at = first_where(cells, test, column)
    off = F.when(F.coalesce(test(cell(cells, column)), F.lit(False)), 0).otherwise(F.coalesce(at - column, F.lit(0)))
    moved = F.concat(F.slice(cells, F.lit(1), column), F.slice(cells, F.col("offset") + column + 1, F.greatest(F.size(cells) - F.col("offset") - column, F.lit(0))), F.array_repeat(F.lit(None).cast("string"), F.col("offset")))
    return df.withColumn("offset", off.cast("int")).withColumn(cells, F.when(F.col("offset") > 0, moved).otherwise(F.col(cells)))


def move_cell(df: DataFrame, source: Column, target: int | Column, when: Column, cells: str = "cells", flag: str | None = None) -> DataFrame:
    """Moves the cell at `source` to `target` and leaves null behind, where `when` holds."""
    target = _at(target)
    out = df.withColumn("_from", F.when(when, source))
    wide = F.concat(F.col(cells), F.array_repeat(F.lit(None).cast("string"), F.greatest(target + 1 - F.size(cells), F.lit(0))))
    moved = F.transform(wide, lambda c, i: F.when(i == target, F.get(F.col(cells), F.col("_from"))).when(i == F.col("_from"), None).otherwise(c))
    out = out.withColumn("_hit", F.col("_from").isNotNull()).withColumn(cells, F.when(F.col("_hit"), moved).otherwise(F.col(cells)))
    return (out.withColumnRenamed("_hit", flag) if flag else out.drop("_hit")).drop("_from")


def date_left_shift(df: DataFrame, column: int | Column, cost: int | Column, cells: str = "cells", flag: str | None = None) -> DataFrame:
    """A date one cell too far left moves right, in rows with a numeric cost."""
    column = _at(column)
    return move_cell(df, column - 1, column, blank(cell(cells, column)) & has_date(cell(cells, column - 1)) & is_money(cell(cells, cost)), cells, flag)


def collapse_gain(df: DataFrame, cost: int | Column, gain: int | Column, cells: str = "cells", any_value: bool = False, flag: str | None = "collapsed") -> DataFrame:
    """An empty gain cell takes the nearest number (or any value) left of it, behind the cost."""
    test = (lambda c: ~blank(c)) if any_value else (lambda c: is_money(c))
    spots = F.filter(F.transform(cells, lambda c, i: F.when((i > cost) & (i < gain) & F.coalesce(test(c), F.lit(False)), i)), lambda i: i.isNotNull())
    return move_cell(df, F.array_max(spots), gain, blank(cell(cells, gain)) & (F.size(spots) > 0) & is_money(cell(cells, cost)), cells, flag)


def fed_tax_shift(df: DataFrame, gain: int | Column, fed: int | Column, cells: str = "cells", fired: str = "collapsed", flag: str | None = None) -> DataFrame:
    """The cell behind the gain moves to the tax column, only in rows where the gain was repaired."""
    fed = _at(fed)
    return move_cell(df, fed - 1, fed, F.col(fired) & blank(cell(cells, fed)) & is_money(cell(cells, fed - 1)) & (fed - 1 > _at(gain)), cells, flag)


def realign(grid: DataFrame, sold: int | Column, cost: int | Column, gain: int | Column, optional: list[int] | Column, cells: str = "cells", acquired: int | Column | None = None, fed: int | Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The repaired grid and, for each sheet, how many rows each repair touched. Positions are numbers or columns of the grid.

    First rows that slid right come back, then a date acquired that slid one cell left, a collapsed gain, and, only where
    the gain was repaired, the tax. offset, moved_right, collapsed and fed_moved say what was done to a row; rows whose
    optional cells are filled are marked for review."""
    out = shift_left(grid, sold, cells)
    log = {"shifted": F.col("offset") > 0}
    if acquired is not None:
        out = date_left_shift(out, acquired, cost, cells, flag="moved_right")
        log["moved_right"] = F.col("moved_right")
    out = collapse_gain(out, cost, gain, cells)
    log["collapsed"] = F.col("collapsed")
    if fed is not None:
        out = fed_tax_shift(out, gain, fed, cells, flag="fed_moved")
        log["fed_moved"] = F.col("fed_moved")
    places = optional if isinstance(optional, Column) else F.array(*map(F.lit, optional))
    review = F.exists(places, lambda k: ~blank(cell(cells, k)) & (F.coalesce(parse_money(cell(cells, k)), F.lit(0)) != 0))
    # A later filter on the cells would be copied into the repairs' expressions, each time several times over.
    out = out.withColumn("review", review).withColumn(cells, F.when(F.monotonically_increasing_id() >= 0, F.col(cells)))
    log["review"] = F.col("review")
    return out, out.groupBy("file", "sheet").agg(*[F.count_if(v).alias(k) for k, v in log.items()])


def detected_positions(grid: DataFrame, formats: DataFrame) -> DataFrame:
    """For each file the row of `formats` (format, acquired, sold, cost, gain, optional, fed) that fits its first sheet best, with the
    anchors found there as date_col and cost_col: the date and the cost column by the sheet's profile, scored against each format's.
    A sheet without dates or numbers scores 0 everywhere and has the first format by name."""
    first = grid.join(grid.groupBy("file").agg(F.min("sheet_idx").alias("sheet_idx")), ["file", "sheet_idx"], "left_semi")
    found = anchors(profile_columns(first, ["file"]), ["file"])
    known = formats.select("*", F.col("acquired").alias("format_date"), F.col("cost").alias("format_cost"))
    return rank_formats(found, known).where("rank = 1").drop("format_date", "format_cost", "rank")


def realign_detected(grid: DataFrame, formats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """realign for files of any of the formats (a fixed small table) in one pass, each by the positions that its first sheet shows;
    the positions stay as columns of the grid."""
    at = detected_positions(grid, formats).select("file", *[F.col(c) for c in ("format", "acquired", "sold", "cost", "gain", "optional", "fed")])
    c = F.col
    return realign(grid.join(at, "file"), c("sold"), c("cost"), c("gain"), c("optional"), acquired=c("acquired"), fed=c("fed"))


def lines_of(c: Column) -> Column:
    """The lines of a cell, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def explode_multi(df: DataFrame, columns: list[str] | dict[str, str], n: Column, pad: str = "single", out: str = "part", split: Column | None = None) -> DataFrame:
    """A row for each of n values of newline-joined cells, one at least. What a column with fewer values gives for the rest
    is its padding (one for all, or by column): 'single' repeats a value that stands alone, 'last' the last one, 'none' nothing;
    missing values are ''. Rows for which `split` doesn't hold stay as they are."""
    pads = columns if isinstance(columns, dict) else dict.fromkeys(columns, pad)
    many = F.greatest(n, F.lit(1)) if split is None else F.when(split, F.greatest(n, F.lit(1))).otherwise(1)
    rows = df.withColumn("_split", F.lit(True) if split is None else split).withColumn(out, F.explode(F.sequence(F.lit(0), many - 1)))
    for c, how in pads.items():
        p = F.when(F.col("_split"), lines_of(F.col(c))).otherwise(F.array(F.trim(F.coalesce(c, F.lit("")))))
        rest = {"single": F.when(F.size(p) == 1, F.get(p, F.lit(0))), "last": F.try_element_at(p, F.lit(-1)), "none": F.lit(None).cast("string")}[how]
        rows = rows.withColumn(c, F.coalesce(F.get(p, F.col(out)), rest, F.lit("")))
    return rows.drop("_split")


def split_pair(c: Column) -> tuple[Column, Column]:
    """Both amounts of a cell "$ X $ Y"; the second is null if there is one."""
    parts = F.filter(F.split(c, r"\$"), lambda x: F.trim(x) != "")
    return parse_money(F.get(parts, F.lit(0))), parse_money(F.get(parts, F.lit(1)))


def date_block(cells: Column | str, fallback: tuple[int, int] = (2, 3)) -> tuple[Column, Column]:
    """Positions of the first two date cells; the fallback if there aren't two."""
    spots = F.filter(F.transform(cells, lambda c, i: F.when(has_date(c), i)), lambda i: i.isNotNull())
    return tuple(F.when(F.size(spots) >= 2, F.get(spots, F.lit(k))).otherwise(F.lit(fallback[k])) for k in (0, 1))


def unmerge_description(df: DataFrame, target: int, rule: Column, cells: str = "cells") -> DataFrame:
    """In rows of one filled cell, its text moves to `target` and the rest becomes null."""
    text = F.get(filled(cells), F.lit(0))
    return df.withColumn(cells, F.when(rule & (F.size(filled(cells)) == 1), F.transform(cells, lambda c, i: F.when(i == target, text))).otherwise(F.col(cells)))


def header_row(grid: DataFrame, keywords: list[str], by: list[str], least: int = 3, best: bool = False, within: int | None = None) -> DataFrame:
    """The header row of each sheet: the first with `least` keywords, or the one with most (then the first)."""
    text = F.lower(F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " "))
    hits = F.size(F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: text.contains(k)))
    rows = grid.withColumn("hits", hits)
    if within is not None:
        rows = rows.where(F.col("row_idx") < within)
    if best:
        return rows.groupBy(*by).agg(F.max_by("row_idx", F.struct("hits", -F.col("row_idx"))).alias("header_row"))
    return rows.groupBy(*by).agg(F.min(F.when(F.col("hits") >= least, F.col("row_idx"))).alias("header_row"))


def header_span(grid: DataFrame, by: list[str], opens: Column, closes: Column, words: list[str], least: int) -> DataFrame:
    """The rows of each sheet with a header, with header_start and header_end: from the last row that opens one before the first that
    closes it (alone, if none does); without one that opens, the first row with `least` of the words. Sheets without a header go."""
    text = F.lower(F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " "))
    rows = computed(grid.dropna(subset=by), {"_t": text})
    hits = reduce(add, [F.contains("_t", F.lit(k.lower())).cast("int") for k in words])
    rows = computed(rows, {"_o": F.coalesce(opens, F.lit(False)), "_c": F.coalesce(closes, F.lit(False)), "_d": hits >= least}).drop("_t")
    # One order for all windows of a sheet, so that its rows are sorted once.
    w = Window.partitionBy(*by).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.col("row_idx")
    rows = rows.withColumns({"_first": F.min(F.when(F.col("_o"), at)).over(w), "_dense": F.min(F.when(F.col("_d"), at)).over(w)})
    rows = rows.withColumn("_end", F.min(F.when(F.col("_c") & ~F.col("_o") & (at > F.col("_first")), at)).over(w))
    rows = rows.withColumn("_start", F.max(F.when(F.col("_o") & (F.col("_end").isNull() | (at < F.col("_end"))), at)).over(w))
    rows = rows.withColumns({"header_start": F.coalesce("_start", "_dense"), "header_end": F.when(F.col("_start").isNull(), F.col("_dense")).otherwise(F.coalesce("_end", "_start"))})
    return rows.where("header_start is not null").drop("_o", "_c", "_d", "_first", "_dense", "_end", "_start")


def header_texts(rows: Column) -> Column:
    """For each column the texts of the cells of a header's rows (an array of cells), joined, in lower case."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    texts = lambda k: F.filter(F.transform(rows, lambda cells: F.trim(F.get(cells, k))), lambda x: x != "")
    return F.transform(F.slice(F.sequence(F.lit(0), width), 1, width), lambda k: F.lower(F.array_join(texts(k), " ")))


def mapped_columns(rows: DataFrame, by: list[str], rules: Callable[[Column], list[tuple[str, Column]]], defaults: dict[str, int], carried: dict[str, Column]) -> DataFrame:
    """The rows below each sheet's header (rows of header_span) with `at`, a struct of field to column: a column whose header texts fit
    has the field of the first rule that does; of several columns the last one counts; fields that none has are at their
    default. `carried` are values of which each row has the last one at or before it below the header.

    A header's rows are gathered beside those above and in it alone; the rows below it get its columns."""

    def field(header: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, rule in reversed(rules(header)):
            out = F.when((header != "") & rule, name).otherwise(out)
        return out

    ends = F.col("row_idx") == F.col("header_end")
    rows = rows.withColumn("_below", F.col("row_idx") > F.col("header_end"))
    so_far = Window.unboundedPreceding, Window.currentRow
    inside = F.collect_list(F.when(F.col("row_idx").between(F.col("header_start"), F.col("header_end")), F.col("cells")))
    rows = rows.withColumn("_rows", inside.over(Window.partitionBy(*by, "_below").orderBy("row_idx").rowsBetween(*so_far)))
    rows = computed(rows, {"_fields": F.when(ends, F.transform(header_texts(F.col("_rows")), field))}).drop("_rows")
    last = lambda name: F.when(F.array_contains("_fields", name), F.size("_fields") - F.array_position(F.reverse("_fields"), F.lit(name)).cast("int"))
    names = dict.fromkeys([name for name, _ in rules(F.lit(""))] + list(defaults))
    at = F.struct(*[F.coalesce(last(name), F.lit(defaults.get(name)).cast("int")).alias(name) for name in names])
    rows = computed(rows, {"_at": F.when(ends, at)}).drop("_fields")
    w = Window.partitionBy(*by).orderBy("_below", "row_idx").rowsBetween(*so_far)
    values = {name: F.last(F.when(F.col("_below"), value), ignorenulls=True).over(w) for name, value in carried.items()}
    return rows.withColumns({"at": F.last("_at", ignorenulls=True).over(w)} | values).where("_below").drop("_below", "_at", "header_start", "header_end")


def cell_class(c: Column) -> Column:
    return F.when(blank(c), "empty").when(has_date(c), "date").when(is_money(c), "numeric").otherwise("text")


def optional_class(c: Column) -> Column:
    return F.when(blank(c), "nan").when(parse_money(c) == 0, "zero").when(is_money(c), "nonzero").otherwise("text")


def profile_columns(grid: DataFrame, by: list[str]) -> DataFrame:
    """For each column of a sheet: shares of empty, date, numeric and text cells, the most frequent, samples."""
    cells = grid.select(*by, "row_idx", F.posexplode("cells").alias("col", "value")).withColumn("class", cell_class(F.col("value")))
    shares = [F.round(F.avg((F.col("class") == k).cast("double")), 4).alias(k) for k in ("empty", "date", "numeric", "text")]
    # Samples: the least rows of a value that isn't empty, at most three, found before they are gathered.
    w = Window.partitionBy(*by, "col", "_full").orderBy("row_idx")
    numbered = cells.withColumn("_full", F.col("class") != "empty").withColumn("_k", F.row_number().over(w))
    picked = F.collect_list(F.when(F.col("_full") & (F.col("_k") <= 3), F.struct("row_idx", "value")))
    return numbered.groupBy(*by, "col").agg(*shares, F.transform(F.array_sort(picked), lambda x: x["value"]).alias("samples")).withColumn("dominant", _dominant())


def _dominant() -> Column:
    pairs = F.array(*[F.struct(F.col(k).alias("v"), F.lit(3 - i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(("empty", "date", "numeric", "text"))])
    return F.array_max(pairs)["k"]


def anchors(profiles: DataFrame, by: list[str], least: float = 0.2) -> DataFrame:
    """The first date column and the cost: the second numeric column after it, else the first."""
    rows = profiles.groupBy(*by).agg(F.min(F.when(F.col("date") > least, F.col("col"))).alias("date_col"), F.array_sort(F.collect_list(F.when(F.col("numeric") > least, F.col("col")))).alias("_n"))
    after = F.filter("_n", lambda c: c > F.col("date_col"))
    return rows.withColumn("cost_col", F.coalesce(F.get(after, F.lit(1)), F.get(after, F.lit(0)))).drop("_n")


def row_class(cells: Column | str, keywords: list[str]) -> Column:
    """empty, single, header (three keywords), transaction (two dates, or a date and two numbers) or other."""
    full = filled(cells)
    text = F.lower(F.array_join(full, " "))
    hits = F.size(F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: text.contains(k)))
    dates = F.size(F.filter(full, has_date))
    numbers = F.size(F.filter(full, lambda c: is_money(c) & ~has_date(c)))
    return F.when(F.size(full) == 0, "empty").when(F.size(full) == 1, "single").when(hits >= 3, "header").when((dates >= 2) | ((dates == 1) & (numbers >= 2)), "transaction").otherwise("other")


def row_distribution(classes: DataFrame, by: list[str], kind: str = "kind") -> DataFrame:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return classes.groupBy(*by, kind).agg(F.count("*").alias("n")).withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(w), 1))


def optional_tallies(grid: DataFrame, by: list[str], columns: list[int], transaction: Column) -> DataFrame:
    """Counts of nan, zero, nonzero and text cells of optional columns, over transaction rows."""
    rows = grid.where(transaction).select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("col"), cell("cells", k).alias("value")) for k in columns])).alias("c")).select(*by, "c.col", optional_class(F.col("c.value")).alias("class"))
    return rows.groupBy(*by, "col").agg(*[F.count_if(F.col("class") == k).alias(k) for k in ("nan", "zero", "nonzero", "text")])


def shift_pattern(grid: DataFrame, by: list[str], column: int, transaction: Column) -> DataFrame:
    """Of transaction rows, how many have their date in place or further right, by the column where it is."""
    at = first_where("cells", has_date, column)
    return grid.where(transaction).select(*by, (at - column).alias("offset")).where("offset is not null").groupBy(*by, "offset").agg(F.count("*").alias("n"))


def rank_formats(found: DataFrame, formats: DataFrame, date: str = "date_col", cost: str = "cost_col") -> DataFrame:
    """Detected anchors scored against each known format: 40 for the same column, 20 for the next, ranked."""
    score = lambda a, b: F.when(F.abs(F.col(a) - F.col(b)) == 0, 40).when(F.abs(F.col(a) - F.col(b)) == 1, 20).otherwise(0)
    keys = [c for c in found.columns if c not in (date, cost)]
    pairs = found.join(F.broadcast(formats), F.lit(True)).withColumn("score", score(date, "format_date") + score(cost, "format_cost"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "format")))


def is_header(cells: Column | str) -> Column:
    """Some cell is filled and none of the filled ones is a number."""
    full = filled(cells)
    return (F.size(full) > 0) & F.forall(full, lambda c: F.regexp_replace(F.trim(c), "[$,]", "").try_cast("double").isNull())


def guess_columns(columns: list[str]) -> dict[str, str | None]:
    """Columns that a file's headers suggest: description, date, debit and credit; the first column (for credit none)
    where no header fits."""
    words = {"description": ["desc"], "date": ["date"], "debit": ["debit", "subtracted", "withdrawal"], "credit": ["credit", "added", "deposit"]}
    pick = lambda keys: next((c for c in columns if any(k in c.lower() for k in keys)), None)
    return {name: pick(keys) or (None if name == "credit" else columns[0]) for name, keys in words.items()}


def named_columns(grid: DataFrame, by: list[str], exact: list[str], words: list[str], names: list[str], least: int = 3) -> DataFrame:
    """The rows under each sheet's header as columns of `names`, taken by the header's own texts.

    The header is the first row whose first cells are `exact`, else the first with `least` of the words; a sheet without
    one has the names by position. Texts are compared without case and outer white space; a name that a header lacks is null."""
    low = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    text = F.array_join(low, " ")
    is_exact = F.slice(low, 1, len(exact)) == F.array(*map(F.lit, exact))
    hits = F.size(F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(text, k)))
    rows = grid.withColumn("_low", low).withColumn("_kind", F.when(is_exact, 0).when(hits >= least, 1))
    headers = rows.where("_kind is not null").groupBy(*by).agg(F.min_by(F.struct("row_idx", "_low"), F.struct("_kind", "row_idx")).alias("_h"))
    body = rows.join(headers, by, "left").where(F.col("_h").isNull() | (F.col("row_idx") > F.col("_h.row_idx")))
    place = lambda k, n: F.when(F.col("_h").isNull(), F.lit(k)).otherwise(F.array_position("_h._low", F.lit(n.lower())) - 1)
    cells = [F.when(place(k, n) >= 0, F.get("cells", place(k, n).cast("int"))).alias(n) for k, n in enumerate(names)]
    return body.select(*by, "row_idx", *cells)


def collate_headed(grid: DataFrame, by: list[str], width: int) -> DataFrame:
    """The rows of all sheets of a file under one another, without their header rows and blank rows: Month is the sheet's
    name, c0 .. are the cells, filled up with ''; header is the first sheet's header row that there is, or null."""
    head = is_header("cells") & (F.col("row_idx") == 0)
    rows = grid.withColumn("_head", head)
    first = rows.where("_head").groupBy(*by).agg(F.min_by("cells", "sheet_idx").alias("header"))
    body = rows.where(~F.col("_head") & (F.size(filled("cells")) > 0)).join(first, by, "left")
    return body.select(*by, F.col("sheet").alias("Month"), "row_idx", "header", *[F.coalesce(cell("cells", k), F.lit("")).alias(f"c{k}") for k in range(width)])


def collation_recon(rows: DataFrame, by: list[str], amounts: dict[str, str], month: str = "Month") -> DataFrame:
    """Rows and sums of each sheet and, as 'Grand Total', of the file; what is no number counts as 0."""
    number = lambda c: F.coalesce(F.regexp_replace(F.col(c), "[$,]", "").try_cast("decimal(18,2)"), F.lit(0))
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.sum(number(c)).alias(n) for c, n in amounts.items()])
    return sums(rows, *by, month).unionByName(sums(rows, *by).withColumn(month, F.lit("Grand Total")))


def right_of_anchor(grid: DataFrame, by: list[str], gain: int, fed: int | None = None) -> DataFrame:
    """Of the columns right of the gain that aren't empty: empty, numeric and text cells, the total of the absolute
    amounts, and the flag FED TAX, PARTIAL SHIFT? or FULL COL. The grid has transaction rows only."""
    cells = grid.select(*by, F.posexplode("cells").alias("col", "value")).where(F.col("col") > gain)
    kind = cell_class(F.col("value"))
    per = cells.groupBy(*by, "col").agg(F.count_if(kind == "numeric").alias("numeric"), F.count_if(~kind.isin("numeric", "empty")).alias("text"), F.coalesce(F.sum(F.when(kind == "numeric", F.abs(parse_money(F.col("value"))))), F.lit(0)).alias("total"))
    out = per.join(grid.groupBy(*by).agg(F.count("*").alias("_n")), by).where("numeric + text > 0").withColumn("empty", F.col("_n") - F.col("numeric") - F.col("text"))
    flag = F.when(F.col("col") == F.lit(fed), "FED TAX").when(F.col("numeric") == F.col("_n"), "FULL COL").when(F.col("numeric") > 0, "PARTIAL SHIFT?").otherwise("")
    return out.withColumn("flag", flag).drop("_n")


def shift_totals(grid: DataFrame, by: list[str], cost: int, gain: int, optional: list[str], fed: int | None = None) -> DataFrame:
    """normal_rows and shifted_rows of transaction rows, and the absolute totals of each optional column in its own place
    and displaced. A row is shifted if all its optional cells are blank and numbers stand right of the gain (up to the tax);
    they count for the optional columns in their order. The positions with their counts are in `positions`."""
    own = [k for k in range(cost + 1, min(cost + 1 + len(optional), gain))]
    empty = F.forall(F.array(*[cell("cells", k) for k in own]), blank)
    spots = F.filter(F.transform("cells", lambda c, i: F.when((i > gain) & (i < (F.size("cells") if fed is None else F.lit(fed))) & F.coalesce(is_money(c), F.lit(False)), F.struct(i.alias("at"), F.abs(parse_money(c)).alias("v")))), lambda x: x.isNotNull())
    rows = grid.withColumn("_spots", spots).withColumn("_shifted", empty & (F.size("_spots") > 0))
    aggs = [F.count_if(~F.col("_shifted")).alias("normal_rows"), F.count_if("_shifted").alias("shifted_rows")]
    for k, name in enumerate(optional):
        here = F.abs(parse_money(cell("cells", cost + 1 + k))) if cost + 1 + k < gain else F.lit(None).cast("decimal(18,2)")
        aggs.append(F.coalesce(F.sum(F.when(~F.col("_shifted"), here)), F.lit(0)).alias(f"normal_{name}"))
        aggs.append(F.coalesce(F.sum(F.when(F.col("_shifted"), F.get("_spots", F.lit(k))["v"])), F.lit(0)).alias(f"shifted_{name}"))
    at = rows.where("_shifted").select(*by, F.explode("_spots.at").alias("at")).groupBy(*by, "at").agg(F.count("*").alias("n"))
    positions = at.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("at", "n")))).alias("positions"))
    return rows.groupBy(*by).agg(*aggs).join(positions, by, "left")


def financial_totals(grid: DataFrame, by: list[str], cost: int, gain: int, optional: list[str]) -> DataFrame:
    """Sums of proceeds (the cell before the cost), cost, gain and the optional columns between them; no number adds nothing."""
    at = {"proceeds": cost - 1, "cost": cost, "gain": gain} | {n: cost + 1 + k for k, n in enumerate(optional) if cost + 1 + k < gain}
    return grid.groupBy(*by).agg(*[F.coalesce(F.sum(parse_money(cell("cells", k))), F.lit(0)).alias(n) for n, k in at.items()])


def null_rates(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """n_rows and, for each column, the number of blank cells as empty_<column>."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count_if(blank(F.col(c))).alias(f"empty_{c}") for c in columns])
