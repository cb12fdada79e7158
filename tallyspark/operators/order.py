"""Operators on ordered rows. Every one takes the partition and the order; each partition is one task's window,
so partitions are the unit of parallelism (a file, an account, a user) and there is no window without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import bind


def _w(by: list[str], order: list[str | Column]):
    return Window.partitionBy(*by).orderBy(*order)


def carry_forward(df: DataFrame, by: list[str], order: list, value: Column, name: str, default: str | None = None, drop_before: bool = False) -> DataFrame:
    """`value` or the last one before it in the partition; rows before the first get `default` or go."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    if drop_before:
        return out.where(F.col(name).isNotNull())
    return out if default is None else out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def running_group(df: DataFrame, by: list[str], order: list, starts: Column, name: str) -> DataFrame:
    """The number of starts so far: 0 before the first."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(starts.cast("bigint")).over(w))


def change_runs(df: DataFrame, by: list[str], order: list, value: str, name: str) -> DataFrame:
    """A number for each run of equal values: a run ends when the value changes, so a value may have several."""
    previous = F.lag(value).over(_w(by, order))
    flagged = df.withColumn("_change", (~F.col(value).eqNullSafe(previous)).cast("bigint"))
    return running_group(flagged, by, order, F.col("_change"), name).drop("_change")


def merge_continuations(df: DataFrame, by: list[str], order: list[str], starts: Column, text: str, separator: str = " ", most: int | None = None, closes: Column | None = None) -> DataFrame:
    """One row per start: the partition, the order of its first row, n_rows and the joined text of the start
    and the rows that follow it. At most `most` rows follow; a closing row ends the group and isn't in it."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_g", F.sum(starts.cast("bigint")).over(w)).where("_g > 0")
    in_group = Window.partitionBy(*by, "_g").orderBy(*order)
    if closes is not None:
        rows = rows.withColumn("_closed", F.max((closes & ~starts).cast("int")).over(in_group.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_closed = 0").drop("_closed")
    if most is not None:
        rows = rows.withColumn("_k", F.row_number().over(in_group)).where(F.col("_k") <= most + 1).drop("_k")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    merged = rows.groupBy(*by, "_g").agg(parts.alias("_p"))
    first = [F.col("_p")[0][c].alias(c) for c in order]
    return merged.select(*by, *first, F.size("_p").cast("bigint").alias("n_rows"), F.array_join(F.transform("_p", lambda x: x["_t"]), separator).alias(text))


def pair_next(df: DataFrame, by: list[str], order: list, first: Column, second: Column, take: dict[str, str]) -> DataFrame:
    """Each `first` row with the values (new name -> column) of the row right after it if that is a `second`."""
    w = _w(by, order)
    out = df.withColumn("_first", first).withColumn("_next", F.lead(second).over(w))
    for name, column in take.items():
        out = out.withColumn(name, F.when(F.col("_next"), F.lead(column).over(w)))
    return out.where("_first").drop("_first", "_next")


def region(df: DataFrame, by: list[str], order: list, start: Column, end: Column, name: str = "in_region") -> DataFrame:
    """True after the first start row and before the first end row that follows it; markers are outside."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_s", F.max(start.cast("int")).over(w))
    out = out.withColumn("_e", F.max(((F.col("_s") == 1) & end).cast("int")).over(w))
    return out.withColumn(name, (F.col("_s") == 1) & (F.col("_e") == 0) & ~start).drop("_s", "_e")


def keep_last(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the whole order."""
    return df.withColumn("_n", F.row_number().over(_w(by, [F.desc(c) for c in order]))).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(_w(by, order))).where("_n = 1").drop("_n")


def balance_walk(df: DataFrame, by: list[str], order: list, added: str, subtracted: str, balance: str, tolerance: float = 0.02, accumulate: bool = False) -> DataFrame:
    """flag 'VERIFY' where the last known balance and the row's amounts don't give its balance.

    The first known balance of a partition is the base; a row without balance is passed over (with
    `accumulate` its amounts count in the next check); the base moves to the stated balance, right or wrong."""
    w = _w(by, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    move = F.coalesce(F.col(added), F.lit(0)) - F.coalesce(F.col(subtracted), F.lit(0))
    out = df.withColumn("_base", F.last(balance, ignorenulls=True).over(before)).withColumn("_move", move)
    if accumulate:
        out = out.withColumn("_total", F.sum("_move").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        out = out.withColumn("_at", F.last(F.when(F.col(balance).isNotNull(), F.col("_total")), ignorenulls=True).over(before)).withColumn("_move", F.col("_total") - F.col("_at"))
    off = F.abs(F.col("_base") + F.col("_move") - F.col(balance)) > tolerance
    return out.withColumn("flag", F.when(off, "VERIFY")).drop(*[c for c in ("_base", "_move", "_total", "_at") if c in out.columns])


def continuity_gap(df: DataFrame, by: list[str], order: list, amount: str, balance: str, tolerance: float = 0.02) -> DataFrame:
    """gap: the smaller misfit of a row's balance with the one before, read upwards or downwards; broken if over
    the tolerance. Rows without balance go; the first row of a partition has no gap."""
    w = _w(by, order)
    rows = df.where(F.col(balance).isNotNull())
    last, last_amount = F.lag(balance).over(w), F.lag(amount).over(w)
    up = F.abs(last + F.col(amount) - F.col(balance))
    down = F.abs(F.col(balance) + last_amount - last)
    return rows.withColumn("gap", F.least(up, down)).withColumn("broken", F.coalesce(F.col("gap") > tolerance, F.lit(False)))


def open_close(df: DataFrame, by: list[str], order: str, amount: str, balance: str, ascending: bool = True) -> DataFrame:
    """opening (the first balance less its amount) and closing (the last balance) of each key."""
    first, last = (F.min_by, F.max_by) if ascending else (F.max_by, F.min_by)
    return df.groupBy(*by).agg(first(F.col(balance) - F.col(amount), order).alias("opening"), last(balance, order).alias("closing"))


def places(df: DataFrame, key: Column, name: str, ranges: int | None = None) -> DataFrame:
    """The place of each row in the order of `key` (a null comes first) over the whole table, from 1; equal keys in any order.

    Rows are dealt to ranges of keys (as many as shuffle partitions) that a small sample bounds; a row's place is
    its place in the range plus the rows of the ranges before it. df is read here twice, for the sample and the counts."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys, most = df.select(key.alias("k")), 50 * ranges
    sample = sorted({r["k"] for r in keys.sample(fraction=min(1.0, most / max(1, keys.count())), seed=1).collect() if r["k"] is not None})
    bounds = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    # The key is computed once for a row, not once for each bound.
    at = bind(key, lambda k: F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= k))) if bounds else F.lit(0)
    dealt = df.withColumn("_range", F.when(key.isNull(), 0).otherwise(at).cast("int"))
    before, so_far = {}, 0
    for r in sorted(dealt.groupBy("_range").count().collect()):  # at most `ranges` rows
        before[r["_range"]], so_far = so_far, so_far + r["count"]
    offset = F.get(F.array(*[F.lit(before.get(k, 0)).cast("bigint") for k in range(ranges)]), F.col("_range"))
    return dealt.withColumn(name, F.row_number().over(_w(["_range"], [key])) + offset).drop("_range")


def recent(df: DataFrame, by: list[str], order: str, n: int = 10) -> DataFrame:
    """The n most recent distinct values of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.select(*by, order).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def number_batches(df: DataFrame, by: list[str], order: list, size: int = 30) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(_w(by, order)) - 1) / size).cast("int"))


def next_numbers(df: DataFrame, existing: DataFrame, by: list[str], order: list, column: str, prefix: str = "RCP") -> DataFrame:
    """New rows numbered on from the last `prefix`-n of their key: prefix-001 if there is none."""
    number = F.regexp_extract(column, rf"^{prefix}-(\d+)$", 1).try_cast("int")
    last = existing.select(*by, number.alias("_n")).groupBy(*by).agg(F.max("_n").alias("_last"))
    out = df.join(last, by, "left").withColumn("_k", F.coalesce("_last", F.lit(0)) + F.row_number().over(_w(by, order)))
    text = F.when(F.col("_k") < 1000, F.lpad(F.col("_k").cast("string"), 3, "0")).otherwise(F.col("_k").cast("string"))
    return out.withColumn(column, F.concat(F.lit(f"{prefix}-"), text)).drop("_k", "_last")


def baseline_slice(df: DataFrame, by: list[str], date: str, low, high, value: str) -> DataFrame:
    """Rows in the range with the earliest date and value of all history: the window runs before the filter."""
    w = Window.partitionBy(*by)
    out = df.withColumn("baseline_date", F.min(date).over(w)).withColumn("baseline_value", F.min_by(value, date).over(w))
    return out.where(F.col(date).between(low, high))


def minmax_fill(df: DataFrame, key: list[str], metric: str, date: str, value: str) -> DataFrame:
    """A row for every metric and date of a key: fill from 0 to 1, or kind 'no_data'.

    With one date the range is over all metrics, else over the metric's dates; without a range fill is 1."""
    dates, metrics = df.select(*key, date).distinct(), df.select(*key, metric).distinct()
    n_dates = dates.groupBy(*key).agg(F.count("*").alias("_n"))
    full = dates.join(metrics, key).join(df.select(*key, metric, date, value), [*key, metric, date], "left").join(n_dates, key)
    one, own = Window.partitionBy(*key), Window.partitionBy(*key, metric)
    low = F.when(F.col("_n") == 1, F.min(value).over(one)).otherwise(F.min(value).over(own))
    high = F.when(F.col("_n") == 1, F.max(value).over(one)).otherwise(F.max(value).over(own))
    full = full.withColumn("_lo", low).withColumn("_hi", high)
    fill = F.when(F.col(value).isNull(), None).when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return full.withColumn("fill", fill).withColumn("kind", F.when(F.col(value).isNull(), "no_data").otherwise("value")).drop("_n", "_lo", "_hi")


def section_carry(lines: DataFrame, by: list[str], order: list[str], rules: list[tuple[str, str, int]], text: str = "text") -> DataFrame:
    """section and sign of the last header line in the partition; rules are (pattern, section, sign), lines that
    begin with a date are no headers, sections of sign 0 are to be skipped."""
    header = F.lit(None).cast("struct<section:string,sign:int>")
    for pattern, name, sign in reversed(rules):
        header = F.when(F.col(text).rlike(pattern) & ~F.col(text).rlike(r"^\s*\d{1,2}/\d{1,2}\b"), F.struct(F.lit(name).alias("section"), F.lit(sign).alias("sign"))).otherwise(header)
    out = carry_forward(lines.withColumn("_is_header", header.isNotNull()), by, order, header, "_h")
    return out.where("not _is_header").select("*", "_h.section", "_h.sign").drop("_h", "_is_header")


def number_segments(lines: DataFrame, source: str, line: str, text: str = "text", start: str = r"^\s*(\d{1,6})\.\s*\S", header: str = r"^\s*\d{1,6}\.\s*\t") -> DataFrame:
    """Lines with the number of the section they belong to: a number line starts a section, a header line ends
    it, a number that came before ends it too and its lines go, trailing blank lines go."""
    number = F.when(F.col(text).rlike(start) & ~F.col(text).rlike(header), F.regexp_extract(text, start, 1).try_cast("int"))
    rows = lines.withColumn("_num", number).withColumn("_first", F.min(F.when(F.col("_num").isNotNull(), F.col(line))).over(Window.partitionBy(source, "_num")))
    event = F.when(F.col("_num").isNotNull() & (F.col("_first") == F.col(line)), F.struct(F.col("_num").alias("num"), F.lit(True).alias("open"))).when(F.col("_num").isNotNull() | F.col(text).rlike(header), F.struct(F.lit(0).alias("num"), F.lit(False).alias("open")))
    rows = carry_forward(rows, [source], [line], event, "_e").where("_e.open").withColumn("num", F.col("_e.num"))
    last = F.max(F.when(F.trim(text) != "", F.col(line))).over(Window.partitionBy(source, "num"))
    return rows.withColumn("_last", last).where(F.col(line) <= F.col("_last")).drop("_num", "_first", "_e", "_last")


def heading_of_next(lines: DataFrame, source: str, line: str, num: str, heading: Column, name: str = "heading_for") -> DataFrame:
    """For heading lines the number of the next numbered line."""
    w = Window.partitionBy(source).orderBy(line).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return lines.withColumn(name, F.when(heading, F.first(num, ignorenulls=True).over(w)))


def date_headers(lines: DataFrame, by: list[str], order: list[str], is_date: Column, is_amount: Column, text: str = "text") -> DataFrame:
    """Amount rows with their date: the last date line, or the next line if it is a date followed by 'Payment'.
    A short text line right after the amount continues the name."""
    w = _w(by, order)
    rows = lines.withColumn("_d", is_date).withColumn("_a", is_amount)
    ahead = F.when(F.lead("_d").over(w) & (F.trim(F.lead(text, 2).over(w)) == "Payment"), F.lead(text).over(w))
    own = F.when(F.col("_d") & ~((F.coalesce(F.lag("_a").over(w), F.lit(False))) & (F.coalesce(F.trim(F.lead(text).over(w)), F.lit("")) == "Payment")), F.col(text))
    tail = F.when(~F.lead("_d").over(w) & ~F.lead("_a").over(w) & (F.length(F.lead(text).over(w)) < 40) & (F.trim(F.lead(text).over(w)) != "Payment"), F.concat(F.lit(" "), F.lead(text).over(w)))
    out = rows.withColumn("_ahead", ahead).withColumn("_tail", tail).withColumn("_own", own)
    out = out.withColumn("date_line", F.coalesce("_ahead", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return out.where("_a").withColumn(text, F.concat(F.col(text), F.coalesce("_tail", F.lit("")))).drop("_d", "_a", "_ahead", "_tail", "_own")


def described(df: DataFrame, file: str, sheet: str, row: str, is_row: Column, own: Column, full: Column, prefixed: Column | str, default: str = "UNKNOWN") -> DataFrame:
    """The rows for which is_row holds, with `description`; the others of df are rows of text (`full`) between them.

    A name is carried through a file: the text of a text row, or of a row whose own text lacks the prefix (a pattern). A row
    without text of its own is described by the carried name; one whose text has the prefix by it and, unless that has the
    prefix too, the carried name; any other by its full text. Descriptions with the prefix go on: the text rows
    after them in their sheet, and the full text of the row that follows in it if its own text lacks the prefix, are appended.
    Two windows over a file and one aggregation; what is gathered for a row are the texts up to the next one."""
    starts = lambda c: F.coalesce(c.rlike(prefixed), F.lit(False))
    named = F.coalesce(~is_row, F.lit(True)) | ((F.col("_own") != "") & ~starts(F.col("_own")))
    w = _w([file], [sheet, row])
    rows = df.withColumns({"_is": F.coalesce(is_row, F.lit(False)), "_own": F.coalesce(own, F.lit("")), "_full": F.coalesce(full, F.lit(""))})
    rows = rows.withColumn("_name", F.when(named & (F.col("_full") != ""), F.col("_full")))
    rows = rows.withColumn("_before", F.last("_name", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_n", F.count_if("_is").over(_w([file, sheet], [row]).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = F.when(starts(F.col("_before")) | F.col("_before").isNull(), F.col("_own")).otherwise(F.concat_ws(" ", "_own", "_before"))
    base = F.when(F.col("_own") == "", F.coalesce("_before", F.lit(default))).when(starts(F.col("_own")), joined).otherwise(F.col("_full"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_is"), F.struct(row, "_full")))), lambda x: x["_full"])
    kept = [F.first(F.when(F.col("_is"), F.struct(*[c for c in df.columns if c not in (file, sheet)], base.alias("_base"), F.when(F.col("_name").isNotNull(), F.col("_full")).alias("_named"))), ignorenulls=True).alias("_row"), texts.alias("_texts")]
    lots = rows.where("_n > 0").groupBy(file, sheet, "_n").agg(*kept)
    after = F.lead("_row._named").over(_w([file, sheet], ["_n"]))
    more = F.when(starts(F.col("_row._base")), F.concat("_texts", F.array_compact(F.array(after)))).otherwise(F.array())
    described = F.array_join(F.concat(F.array("_row._base"), more), " ")
    return lots.withColumn("description", described).select(file, sheet, *[F.col(f"_row.{c}").alias(c) for c in df.columns if c not in (file, sheet)], "description")


def trend(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """The change from the row before (up, down, same), from the first, and the mean of seven days."""
    w = _w(by, [date])
    days = Window.partitionBy(*by).orderBy(F.unix_date(F.col(date))).rangeBetween(-6, 0)
    last = F.lag(value).over(w)
    return df.withColumn("trend", F.when(F.col(value) > last, "up").when(F.col(value) < last, "down").when(F.col(value) == last, "same")).withColumn("from_start", F.col(value) - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("mean_7d", F.avg(value).over(days))
