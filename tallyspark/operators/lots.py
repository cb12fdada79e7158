"""Broker statements: cell grids to lots (description, dates, amounts), one function for each layout.

A layout is a rule for description rows, a rule for transactions and the places of the cells; what differs in
kind (paired rows, merged cells, descriptions that follow) is composed from the order and grid operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import has_date, is_date, is_money, null_if_blank, parse_money
from tallyspark.operators import grid as g
from tallyspark.operators.order import carry_forward, described
from tallyspark.operators.shared import computed

ORDER = ["sheet_idx", "row_idx"]
LOT = ["file", "sheet", "sheet_idx", "row_idx", "description", "date_acquired", "date_sold", "proceeds", "cost", "accrued_market_discount", "wash_sale_loss", "fed_tax_withheld", "type"]
#: Words of rows that hold sums or page furniture.
SKIP = r"(?i)\b(?:sub\s?-?total|grand total|totals?|page \d+|continued)\b"


def _c(k: int | Column) -> Column:
    return g.cell("cells", k)


def skip_row(legacy: bool = False) -> Column:
    """Rows of sums and furniture: whole words, or with `legacy` any text that holds sum, total or page."""
    text = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " ")
    return text.rlike("(?i)sum|total|page" if legacy else SKIP)


def _lot(df: DataFrame, at: dict[str, int | Column]) -> DataFrame:
    """The lot columns from the cells at the given places; others are null."""
    out = {}
    for name in LOT[5:12]:
        cell = _c(at[name]) if name in at else F.lit(None).cast("string")
        out[name] = null_if_blank(cell) if name.startswith("date") else parse_money(cell)
    typed = _c(at["type"]) if "type" in at else F.lit(None).cast("string")
    return df.select("file", "sheet", "sheet_idx", "row_idx", "description", *[v.alias(k) for k, v in out.items()], typed.alias("type"))


def carried(grid: DataFrame, description: Column, text: Column, transaction: Column, at: dict, within_sheet: bool = False) -> DataFrame:
    """Transactions with the description of the last description row: across a file's sheets ('UNKNOWN' before the
    first), or within a sheet (transactions before the first go)."""
    rows = grid.withColumn("_d", F.coalesce(description, F.lit(False)) & ~skip_row())
    by = ["file", "sheet_idx"] if within_sheet else ["file"]
    rows = carry_forward(rows, by, ORDER, F.when(F.col("_d"), text), "description", None if within_sheet else "UNKNOWN", drop_before=within_sheet)
    return _lot(rows.where(~F.col("_d") & F.coalesce(transaction, F.lit(False)) & ~skip_row()), at)


def fidelity(grid: DataFrame) -> DataFrame:
    grid = g.collapse_gain(grid, 5, 8, any_value=True, flag=None)
    return carried(grid, F.size(g.filled("cells")) == 1, F.get(g.filled("cells"), F.lit(0)), has_date(_c(3)) & is_money(_c(4)), {"date_acquired": 2, "date_sold": 3, "proceeds": 4, "cost": 5, "accrued_market_discount": 6, "wash_sale_loss": 7, "fed_tax_withheld": 9}, within_sheet=True)


def morgan_stanley(grid: DataFrame) -> DataFrame:
    named = ~g.blank(_c(0)) & F.array_join(g.filled("cells"), " ").rlike("(?i)cusip|symbol")
    return carried(grid, named, null_if_blank(_c(0)), has_date(_c(2)) & has_date(_c(3)) & is_money(_c(4)), {"date_acquired": 2, "date_sold": 3, "proceeds": 4, "cost": 5, "accrued_market_discount": 6, "wash_sale_loss": 7, "fed_tax_withheld": 9})


def apex_clearing(grid: DataFrame) -> DataFrame:
    return carried(grid, (F.size(g.filled("cells")) <= 2) & ~g.blank(_c(0)) & ~has_date(_c(0)), null_if_blank(_c(0)), has_date(_c(0)) & is_money(_c(7)), {"date_sold": 0, "proceeds": 2, "date_acquired": 4, "cost": 5, "wash_sale_loss": 6})


#: The words of a header, the usual columns, and rows of totals and footers.
ROBINHOOD_WORDS = ["quantity", "1b-", "1c-", "1d-", "1e-", "proceeds", "cost", "basis"]
ROBINHOOD_COLUMNS = {"date_sold": 0, "quantity": 1, "proceeds": 2, "date_acquired": 3, "cost": 4, "wash_sale_loss": 5, "additional_info": 7}
ROBINHOOD_SKIP = r"important tax information|furnished to the internal revenue service|irs determines|negligence penalty|taxpayers are ultimately responsible|security total|security subtotal|^\s*totals"


def robinhood_rules(header: Column) -> list[tuple[str, Column]]:
    """Which field a column has, by the texts of its header; the first rule that fits counts."""
    has = lambda *words: reduce(and_, [F.contains(header, F.lit(w)) for w in words])
    return [
        ("date_sold", has("1c-") | has("sold", "disposed")),
        ("quantity", has("quantity") & ~has("1")),
        ("proceeds", has("1d-") | (has("proceeds") & ~has("reported"))),
        ("date_acquired", has("1b-") | has("date", "acquired")),
        ("cost", has("1e-") | has("cost", "basis")),
        ("accrued_market_discount", has("1f-") | has("accrued", "market", "discount")),
        ("wash_sale_loss", has("1g-") | has("wash", "sale")),
        ("additional_info", has("additional", "info")),
    ]


def robinhood(grid: DataFrame) -> DataFrame:
    """Columns by the texts of a header of several rows; a row that names a security, then its lots. Sheets without a header and
    lots before the first name go."""
    by, text = ["file", "sheet_idx"], F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), " ")
    rows = computed(computed(grid, {"_text": text}), {"_low": F.lower("_text")})
    low, up = F.col("_low"), F.upper("_text")
    opens = low.contains("1a-") & low.contains("description")
    closes = (low.contains("sold") | low.contains("disposed")) & low.contains("quantity")
    security = up.rlike(r"CUSIP ?:|\b(?:INC|CORP|LTD|PLC|COMPANY|CO)\b.*\b(?:COMMON|STOCK|CLASS)\b|[A-Z]{2,}\s+(?:INC|CORP)\.?\s+(?:COMMON\s+)?STOCK")
    named = F.get(F.filter("cells", lambda c: (F.length(F.trim(c)) > 10) & F.upper(c).rlike("CUSIP|STOCK|INC")), F.lit(0))
    named = F.coalesce(F.trim(F.regexp_replace(F.trim(F.replace(named, F.lit("(cont'd)"), F.lit(""))), r"/\s*Symbol:\s*$", "")), F.nullif(F.array_join(F.slice(g.filled("cells"), 1, 2), " "), F.lit("")))
    field = lambda name: F.get("cells", F.col(f"at.{name}"))
    rows = g.header_span(rows, by, opens, closes, ROBINHOOD_WORDS, 4)
    # Rows of totals and footers name no security and are no lots.
    rows = computed(rows, {"_d": F.when(~low.rlike(ROBINHOOD_SKIP), security)}).drop("_text", "_low")
    rows = g.mapped_columns(rows, by, robinhood_rules, ROBINHOOD_COLUMNS, {"description": F.when(F.col("_d"), named)})
    rows = rows.where(~F.col("_d") & F.col("description").isNotNull() & has_date(field("date_sold")))
    return _lot(rows.withColumn("cells", F.array(*[field(n) for n in LOT[5:11]])), {n: k for k, n in enumerate(LOT[5:11])})


def pershing(grid: DataFrame) -> DataFrame:
    """Lots are the values of the proceeds cell; dates repeat their last value, a missing cost stays empty."""
    prefix = r"(?i)^\s*(?:description|security)\s*(?:\(box 1a\))?\s*:?\s*"
    named = _c(0).rlike(prefix + r"\S")
    text = F.regexp_replace(_c(0), prefix, "")
    sold = F.upper(F.trim(_c(0))).isin("SELL", "LIQUIDATION") | (g.blank(_c(0)) & has_date(_c(2)) & is_money(F.get(g.lines_of(_c(4)), F.lit(0))))
    rows = carry_forward(grid.withColumn("_d", F.coalesce(named, F.lit(False))), ["file"], ORDER, F.when(named, text), "description", "UNKNOWN").where(~F.col("_d") & F.coalesce(sold, F.lit(False)))
    pads = {"_2": "last", "_3": "last", "_4": "none", "_5": "none"}
    rows = rows.withColumns({c: _c(int(c[1])) for c in pads})
    rows = g.explode_multi(rows, pads, F.size(g.lines_of(F.col("_4"))), split=F.coalesce(F.col("_4").contains("\n"), F.lit(False)))
    return _lot(rows.withColumn("cells", F.array(*pads)), {"date_acquired": 0, "date_sold": 1, "proceeds": 2, "cost": 3})


#: Rows of headers, sections and footers, and words that name no security.
MERRILL_SKIP = r"\d+\s+of\s+\d+|form 1099|omb no|1a\.|description of property|short term capital gains|long term capital gains|covered transactions|net short term|net long term|sales proceeds and net|covered short term gains|covered long term gains|form 8949|subtotal|this transaction has been identified|important tax information|furnished to the internal revenue|taxpayers are ultimately|deferred loss amount|please refer to the instructions"
MERRILL_NO_NAME = ["sale", "nan", "none", ""]


def _amount_line(c: Column) -> Column:
    """Some line of the cell is an amount: a number with a point, a comma or a dollar sign."""
    return F.exists(g.lines_of(c), lambda x: x.rlike("[.,$]") & x.rlike(r"^\(?[$,\s]*-?[$,\s]*(?:\d[\d,$]*\.?\d*|\.\d+)\)?$"))


def merrill(grid: DataFrame) -> DataFrame:
    """Dates locate the amounts behind them; a row with newline-joined dates is a lot for each acquired or sold date, whichever
    are more, and may name the security itself. A text with cells behind it is a description, one without continues it."""
    text = F.lower(F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), " "))
    first_line = F.get(g.lines_of(_c(0)), F.lit(0))
    second = F.when(~F.lower(F.trim(_c(1))).isin(MERRILL_NO_NAME), F.trim(_c(1)))
    skip = text.rlike(MERRILL_SKIP) | (F.trim(text) == "") | (F.trim(_c(0)).isin("(W)", "(B)", "(Y)") & (F.length(text) > 100)) | (g.blank(_c(0)) & F.coalesce(F.lower(F.trim(_c(1))).rlike(r'^sales\.|^sale"'), F.lit(False)))
    dated, merged = F.exists("cells", has_date), F.exists("cells", lambda c: has_date(c) & c.contains("\n"))
    amount = F.exists(F.slice("cells", 3, 1 << 20), _amount_line)
    behind = F.exists(F.slice("cells", 3, 1 << 20), lambda c: F.trim(c) != "")
    named = F.trim(F.coalesce(_c(0), F.lit(""))) != ""
    kind = F.when(F.coalesce(skip, F.lit(False)), None).when(merged & amount, "merged").when(dated & amount, "lot").when(named & ~dated & behind, "name").when(named & ~amount, "more")
    rows = grid.withColumn("_kind", kind).where("_kind is not null")
    a, s = g.date_block("cells")
    both = F.size(F.filter("cells", has_date)) >= 2
    own = F.filter(F.transform(F.slice("cells", 1, a), lambda c: F.get(g.lines_of(c), F.lit(0))), lambda x: ~F.lower(x).isin(MERRILL_NO_NAME) & ~x.rlike(r"^\d+\.?\d*$"))
    named_by = F.when(F.col("_kind") == "name", F.concat_ws(" ", first_line, second)).when((F.col("_kind") == "merged") & both & (F.size(own) > 0), F.array_join(own, " "))
    w = g.Window.partitionBy("file").orderBy(*ORDER)
    so_far = g.Window.unboundedPreceding, g.Window.currentRow
    rows = rows.withColumn("_named", named_by).withColumn("_g", F.count("_named").over(w.rowsBetween(*so_far)))
    of_name = g.Window.partitionBy("file", "_g").orderBy(*ORDER).rowsBetween(*so_far)
    more = F.when(F.col("_kind") == "more", F.concat_ws(" ", null_if_blank(_c(0)), null_if_blank(_c(1))))
    parts = F.array_compact(F.concat(F.array(F.first("_named").over(of_name)), F.collect_list(more).over(of_name)))
    rows = rows.withColumn("description", F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("UNKNOWN"))
    lots = rows.where((F.col("_kind") == "lot") | ((F.col("_kind") == "merged") & both))
    joined = F.col("_kind") == "merged"
    dates = lambda c: F.when(joined, F.array_join(F.filter(g.lines_of(c), is_date), "\n")).otherwise(c)
    cells = {"_a": dates(_c(a)), "_s": dates(_c(s)), "_p": _c(s + 1), "_b": _c(s + 2), "_x": _c(s + 3), "_w": _c(s + 4)}
    lots = lots.withColumns(cells)
    pads = {c: "none" if c in ("_a", "_s") else "single" for c in cells}
    lots = g.explode_multi(lots, pads, F.greatest(F.size(g.lines_of(F.col("_a"))), F.size(g.lines_of(F.col("_s")))), split=joined)
    return _lot(lots.withColumn("cells", F.array(*cells)), {"date_acquired": 0, "date_sold": 1, "proceeds": 2, "cost": 3, "accrued_market_discount": 4, "wash_sale_loss": 5})


def charles_schwab(grid: DataFrame) -> DataFrame:
    """A primary row (date and money) and the secondary right after it (a date): description, sale date and wash sale
    come from both; the date column hangs on the row's width."""
    d = F.least(F.greatest(F.size("cells") - 5, F.lit(2)), F.lit(4))
    kind = F.when(~has_date(_c(d)) | skip_row(), None).when(_c(d + 1).contains("$") | is_money(_c(d + 1)), "primary").otherwise("secondary")
    w = g.Window.partitionBy("file", "sheet_idx").orderBy("row_idx")
    rows = computed(grid, {"_k": kind}).where("_k is not null").withColumn("_n", F.when(F.lead("_k").over(w) == "secondary", F.lead("cells").over(w))).where("_k = 'primary'")
    second = lambda k: F.get("_n", k if isinstance(k, Column) else F.lit(k))
    both = _c(d + 1).contains("$") & (F.size(F.filter(F.split(_c(d + 1), r"\$"), lambda x: F.trim(x) != "")) > 1)
    one, two = g.split_pair(_c(d + 1))
    rows = rows.withColumn("description", F.concat_ws(" ", null_if_blank(_c(0)), null_if_blank(second(0))))
    made = F.array(_c(d), second(d), F.when(both, one.cast("string")).otherwise(_c(d + 1)), F.when(both, two.cast("string")).otherwise(_c(d + 2)), _c(d + 3), second(d + 3))
    lots = _lot(rows.withColumn("cells", made), {"date_acquired": 0, "date_sold": 1, "proceeds": 2, "cost": 3, "accrued_market_discount": 4, "wash_sale_loss": 5})
    return computed(lots, {c: F.col(c) for c in ("proceeds", "cost")}).where("proceeds is not null or cost is not null")


#: Words of header and total rows, the prefix of an option's description.
JPMORGAN_SKIP = r"items - total|grand total|cusip|\(box 1[a-g]\)|description of property|quantity sold|date acquired|date sold"
OPTION = r"(?i)^(?:PUT|CALL)\b"


def jpmorgan(grid: DataFrame) -> DataFrame:
    """An option and the company it is on stand in rows of their own: descriptions go on in both directions (see
    order.described). Optional amounts may be displaced behind the gain."""
    cells = F.slice("cells", 1, 13)
    text = F.lower(F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " "))
    skip = text.rlike(JPMORGAN_SKIP) | F.exists(cells, lambda c: F.trim(c).rlike(r"(?i)^column\d+$")) | (F.lower(F.trim(_c(3))) == "subtotals")
    joined = lambda n: F.concat_ws(" ", *[F.when(F.trim(_c(k)) != "", F.trim(_c(k))) for k in range(n)])
    sold = has_date(_c(5)) & has_date(_c(6))
    rows = grid.where(~F.coalesce(skip, F.lit(False)) & (sold | (joined(4) != "")))
    rows = described(rows, "file", "sheet_idx", "row_idx", sold, joined(2), joined(4), OPTION)
    empty = lambda k: parse_money(_c(k)).isNull()
    displaced = empty(9) & empty(10) & (F.size("cells") > 14)
    made = F.array(_c(5), _c(6), _c(7), _c(8), F.when(displaced, _c(13)).otherwise(_c(9)), F.when(displaced, _c(14)).otherwise(_c(10)))
    return _lot(rows.withColumn("cells", made), {"date_acquired": 0, "date_sold": 1, "proceeds": 2, "cost": 3, "accrued_market_discount": 4, "wash_sale_loss": 5})


def betterment(grid: DataFrame) -> DataFrame:
    """A headed CSV: its cells by position, rows without an acquisition date go."""
    rows = grid.where(~g.blank(_c(3)) & has_date(_c(3))).withColumn("description", null_if_blank(_c(0)))
    return _lot(rows, {"date_acquired": 3, "date_sold": 4, "proceeds": 5, "cost": 6, "wash_sale_loss": 8, "fed_tax_withheld": 9, "type": 10})


LAYOUTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "apex_clearing": apex_clearing,
    "charles_schwab": charles_schwab,
    "csv_betterment": betterment,
    "fidelity": fidelity,
    "jpmorgan": jpmorgan,
    "merrill": merrill,
    "morgan_stanley": morgan_stanley,
    "pershing": pershing,
    "robinhood": robinhood,
}
#: Places that realignment needs: sold, cost, gain, and optional cells between. CSV layouts aren't realigned.
ALIGNED = {"fidelity": (3, 5, 8, [6, 7]), "morgan_stanley": (3, 5, 8, [6, 7]), "jpmorgan": (6, 8, 11, [9, 10])}


def lots(grid: DataFrame, layout: str, repair: bool = True) -> DataFrame:
    """The lots of a layout, after realignment where it has one and isn't a CSV."""
    if repair and layout in ALIGNED and not layout.startswith("csv_"):
        sold, cost, gain, optional = ALIGNED[layout]
        grid = g.realign(grid, sold, cost, gain, optional)[0].select("file", "sheet_idx", "sheet", "row_idx", "cells")
    return LAYOUTS[layout](grid)
