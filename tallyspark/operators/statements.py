"""Bank statement pages to transactions: lines (file, page_idx, line_idx, text) in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import bind, contains_any, parse_money, period_label, statement_period, statement_year
from tallyspark.operators.order import carry_forward, region
from tallyspark.operators.shared import computed
from tallyspark.operators.tagging import CREDITS, DEBITS, classify_debit_credit

PAGE, LINE = ["file", "page_idx"], ["line_idx"]
# Here and in the functions below, patterns that must match the lines as statements print them.
AMOUNT = r"-?\$?\s?[\d,]+\.\d{2}"


#: Texts of a bank's furniture, and misread words of its total rows.
MARKERS = [
    "Total Subtracted", "All transaction", "CHECKING ACTIVITY",
    "IF YOU HAVE", "CUSTOMER SERVICE", "Please read", "FDIC",
    "IN CASE OF", "CHECKING AND SAVINGS", "The products reported",
    "In Case of Errors", "You are entitled", "Give us the following",
    "The following special", "Citibank is an Equal", "Date Description",
    "Amount Subtracted", "Amount Added", "© 20", "Citigroup",
    "BASIC BANKING", "Relationship Summary", "Regular Checking Fees",
    "Monthly Service Fee*", "Fee for non-Citibank", "Beginning Balance",
    "Ending Balance", "TTY:", "Impaired Customers", "Speech and Hearing",
    "packages.", "limitations of", "time it takes us",
    "SUGGESTIONS AND", "EOLR", "PAGE 00",
]
MISREAD_TOTALS = [r"tot[a4i]l\s+sub", r"tot[a4i]l\s+[a4]dd", r"tot[a4]i\s+(?:sub|[a4]dd)"]


def is_boilerplate(text: Column, markers: list[str] = MARKERS) -> Column:
    """A marker's text, or a total row even with its letters misread."""
    return contains_any(text, markers) | text.rlike("(?i)" + "|".join(MISREAD_TOTALS))


#: Lines of account pages and of mobile lists that are no transactions.
ACCOUNT_SKIP = [
    r"^\s*DATE\s+DESCRIPTION", r"^\s*JOINT\s+WITH", r"^\s*Page\s+\d+", r"^\s*capitalone\.com", r"^\s*P\.O\.\s*Box", r"^\s*STATEMENT\s+PERIOD",
    r"^\s*(?:Thanks\s+for|Here.s\s+your|TOTAL\s+ENDING|IN\s+ALL\s+ACCOUNTS)", r"^\s*(?:Account\s+Summary|Cashflow\s+Summary)", r"(?:Simply\s+Checking|Confidence\s+Savings)\.\.\.",
    r"^\s*All\s+Accounts", r"^\s*(?:TOTAL\s+FOR\s+THIS|TOTAL\s+YEAR|Total\s+Overdraft|Total\s+Return|Total\s+Fees)", r"^\s*PERIOD\s+DATE", r"^\s*(?:ANNUAL|APY|YTD\s+INTEREST|DAYS\s+IN\s+STATEMENT)",
    r"^\s*\d+\.\d{2}\s*%", r"^\s*1-888", r"^\s*FDIC", r"^\s*\$[\d,]+\.\d{2}\s*$", r"^\s*CATEGORY\s*$", r"^\s*(?:AMOUNT|BALANCE)\s*$",
]
MOBILE_SKIP = [r"freedom\s+unlimit", r"\(\.\.\.\d{4}\)", r"transactions\s*$"]


def without_lines(lines: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """Lines that none of the patterns fits, in any case of letters."""
    return lines.where(~F.coalesce(F.col(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)))


def amounts(text: Column) -> Column:
    """Up to three amounts at the end of a line, in order."""
    tail = F.regexp_extract(text, rf"((?:\s{AMOUNT}){{1,3}})\s*$", 1)
    return F.transform(F.regexp_extract_all(tail, F.lit(rf"({AMOUNT})"), F.lit(1)), lambda x: parse_money(x))


def built_transaction(df: DataFrame, description: str, found: Column, credits: list[str] = CREDITS, debits: list[str] = DEBITS) -> DataFrame:
    """subtracted, added, balance of a list of amounts: of several the last is the balance, of three the others are subtracted and
    added; of two the first is the typed amount (an unknown type is subtracted and the description marked); one is the typed amount, or
    the balance; none gives nothing."""
    kind = classify_debit_credit(F.col(description), credits, debits)
    a = lambda k: F.get("_a", F.lit(k))
    n = F.size("_a")
    out = df.withColumn("_a", found).withColumn("_k", kind)
    subtracted = F.when(n == 3, a(0)).when((n == 2) & (F.col("_k") != "credit"), a(0)).when((n == 1) & (F.col("_k") == "debit"), a(0))
    added = F.when(n == 3, a(1)).when((n == 2) & (F.col("_k") == "credit"), a(0)).when((n == 1) & (F.col("_k") == "credit"), a(0))
    balance = F.when(n >= 2, F.try_element_at("_a", F.lit(-1))).when((n == 1) & (F.col("_k") == "unknown"), a(0))
    marked = F.when((n == 2) & (F.col("_k") == "unknown"), F.concat(F.lit("[CHECK TYPE] "), F.col(description))).otherwise(F.col(description))
    return out.withColumn("subtracted", subtracted).withColumn("added", added).withColumn("balance", balance).withColumn(description, marked).drop("_a", "_k")


#: How a transaction starts, an amount in its line, and rows of balances.
DATED_LINE = r"^(\d{2}/\d{2}(?:/\d{2})?)\s+(.+)$"
LINE_AMOUNT = r"(?:^|(?<=\s))(\d{1,3}(?:,\d{3})*\.\d{2})(?:\s|$)"
BALANCE_ROW = r"(?i)^\s*(?:Opening|Closing)\s+Balance"


def dated_lines(lines: DataFrame, markers: list[str] = MARKERS, credits: list[str] = CREDITS, debits: list[str] = DEBITS, most: int = 2, longest: int = 100) -> DataFrame:
    """Transactions of lines that start with a date; rows of balances aren't any. The text before the first amount is the
    description, to which at most `most` further lines of less than `longest` characters are joined by ' | '.

    A start without amounts takes those of the first line after it that has any, and the lines between go into the description;
    after `most` lines without, it stands without amounts. Before that, furniture or another date drops it, the end of the page doesn't.
    Furniture ends a transaction, and lines after it belong to none."""
    rows = lines.withColumn("text", F.trim("text")).where(F.col("text") != "")
    start, stops = F.col("text").rlike(DATED_LINE), is_boilerplate(F.col("text"), markers)
    rows = computed(rows, {"_stop": stops})
    rows = computed(rows, {"_start": ~F.col("_stop") & start})
    w = Window.partitionBy(*PAGE).orderBy(*LINE)
    rows = rows.withColumn("_g", F.count_if(F.col("_start") | F.col("_stop")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Lines of groups that no start opens go before the groups are gathered.
    rows = rows.withColumn("_live", F.last(F.when(F.col("_start") | F.col("_stop"), F.col("_start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_last", F.max("_g").over(Window.partitionBy(*PAGE)) == F.col("_g")).where("_live")
    parts = F.array_sort(F.collect_list(F.struct(*LINE, "text", "_start")))
    groups = rows.groupBy(*PAGE, "_g", "_last").agg(parts.alias("_p")).where("_p[0]._start")
    rest = F.regexp_extract(F.col("_p")[0]["text"], DATED_LINE, 2)
    groups = groups.select(*PAGE, F.col("_p")[0][LINE[0]].alias(LINE[0]), F.regexp_extract(F.col("_p")[0]["text"], DATED_LINE, 1).alias("date_text"), rest.alias("_rest"), F.transform(F.slice("_p", 2, 1 << 30), lambda x: x["text"]).alias("_more"), "_last").where(~F.col("_rest").rlike(BALANCE_ROW))
    found = lambda c: F.transform(F.regexp_extract_all(c, F.lit(LINE_AMOUNT), F.lit(1)), lambda x: parse_money(x))
    groups = computed(groups, {"_own": F.when(F.col("_rest").rlike(LINE_AMOUNT), 0).otherwise(F.coalesce(F.nullif(F.array_position(F.transform(F.slice("_more", 1, most), lambda x: x.rlike(LINE_AMOUNT)), F.lit(True)), F.lit(0)), F.lit(-1))).cast("int")})
    # _own: the line whose amounts count, 0 the start itself, -1 none.
    waited = F.when(F.col("_own") == 0, F.array()).when(F.col("_own") > 0, F.slice("_more", F.lit(1), F.greatest(F.col("_own") - 1, F.lit(0)))).otherwise(F.slice("_more", 1, most))
    first = F.when(F.col("_own") == 0, F.trim(F.regexp_extract("_rest", rf"^(.*?){LINE_AMOUNT}", 1))).otherwise(F.trim("_rest"))
    tail = F.when(F.col("_own") >= 0, F.slice(F.filter(F.slice("_more", F.col("_own") + 1, F.lit(1 << 30)), lambda x: F.length(x) < longest), 1, most)).otherwise(F.array())
    whole = groups.where((F.col("_own") >= 0) | (F.size("_more") >= most) | F.col("_last"))
    whole = whole.withColumn("_found", F.when(F.col("_own") == 0, found(F.col("_rest"))).when(F.col("_own") > 0, found(F.get("_more", F.col("_own") - 1))).otherwise(F.array().cast("array<decimal(18,2)>")))
    whole = whole.withColumn("description", F.array_join(F.concat(F.array(first), waited), " | ")).withColumn("_tail", tail)
    whole = computed(whole, {c: F.col(c) for c in ("_found", "description")})
    made = built_transaction(whole, "description", F.col("_found"), credits, debits)
    return made.withColumn("description", F.array_join(F.concat(F.array("description"), "_tail"), " | ")).drop("_rest", "_more", "_own", "_found", "_tail", "_last")


def card_activity(lines: DataFrame, start: str = "(?i)ACCOUNT ACTIVITY", end: str = r"(?i)TRANSACTIONS THIS CYCLE") -> tuple[DataFrame, DataFrame]:
    """Card lines between the markers of a file, and the total that the end marker states."""
    order = ["page_idx", "line_idx"]
    inside = region(lines, ["file"], order, F.col("text").rlike(start), F.col("text").rlike(end)).where("in_region")
    pattern = rf"^(\d{{2}}/\d{{2}})\s+(.+?)\s+({AMOUNT})\s*$"
    part = lambda k: F.regexp_extract("text", pattern, k)
    rows = inside.where(F.col("text").rlike(pattern)).select("file", *order, part(1).alias("date_text"), part(2).alias("description"), parse_money(part(3)).alias("amount"))
    totals = lines.where(F.col("text").rlike(end)).groupBy("file").agg(F.max_by(parse_money(F.regexp_extract("text", rf"({AMOUNT})\s*$", 1)), F.struct(*order)).alias("total"))
    return rows, totals


def account_lines(lines: DataFrame, header: str, fees: str = r"(?i)Fees?\s+Summary", skip: list[str] | None = None) -> DataFrame:
    """Signed transactions ('Jan 6 text - $88.29 $1,000.00') with the account of the last header, which lasts over
    pages; a fees part lasts until the next account or page and its lines go."""
    order = ["page_idx", "line_idx"]
    rows = lines if not skip else lines.where(~F.col("text").rlike("|".join(f"(?:{p})" for p in skip)))
    account = F.when(F.col("text").rlike(header), F.regexp_extract("text", header, 0))
    rows = carry_forward(rows, ["file"], order, account, "account", drop_before=True)
    mode = F.when(F.col("text").rlike(header), False).when(F.col("text").rlike(fees), True)
    rows = carry_forward(rows, PAGE, LINE, mode, "_fees")
    pattern = r"(?i)^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]?\s*\d{0,2})\s+(.+?)\s+([+-])\s*\$\s*([\d,]+\.\d{2})(?:\s+\$?\s*([\d,]+\.\d{2}))?\s*$"
    part = lambda k: F.regexp_extract("text", pattern, k)
    day = F.regexp_extract(part(1), r"(\d{1,2})$", 1)
    date = F.concat(F.initcap(F.substring(part(1), 1, 3)), F.lit(" "), F.when(day == "", "??").otherwise(day))
    amount = parse_money(part(4)) * F.when(part(3) == "-", -1).otherwise(1)
    kept = rows.where(F.col("text").rlike(pattern) & ~F.coalesce("_fees", F.lit(False)))
    return kept.select("file", *order, "account", date.alias("date_text"), part(2).alias("description"), amount.cast("decimal(18,2)").alias("amount"), parse_money(part(5)).alias("balance"))


def check_rows(lines: DataFrame) -> DataFrame:
    """'1042 ** 01/16 $50.00' lines: number (three to six digits), date ('??/??' if misread) and amount."""
    pattern = rf"^(\d{{3,6}})\s+\S*?\s*(\S+)\s+({AMOUNT})\s*$"
    part = lambda k: F.regexp_extract("text", pattern, k)
    date = F.when(part(2).rlike(r"^\d{2}/\d{2}$"), part(2)).otherwise("??/??")
    return lines.where(F.col("text").rlike(pattern)).select(*PAGE, *LINE, part(1).alias("check"), date.alias("date_text"), (-parse_money(part(3))).cast("decimal(18,2)").alias("amount"))


def page_periods(lines: DataFrame) -> DataFrame:
    """(file, page_idx, period_text, period, year) of each page: the period it states as printed and as a label, the year that its
    text names, each null where there is none."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*LINE, "text"))), lambda x: x["text"]), "\n")
    pages = lines.groupBy(*PAGE).agg(text.alias("_t"))
    return pages.select(*PAGE, statement_period(F.col("_t")).alias("period_text"), statement_year(F.col("_t")).alias("year")).withColumn("period", period_label(F.col("period_text")))


def with_periods(lines: DataFrame) -> DataFrame:
    """Lines with the period label of their page, carried over the pages of a file; 'Unknown' before the first."""
    w = Window.partitionBy("file").orderBy("page_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pages = page_periods(lines).select(*PAGE, F.coalesce(F.last("period", ignorenulls=True).over(w), F.lit("Unknown")).alias("period"))
    return lines.join(pages, PAGE)


def page_totals(lines: DataFrame, label: str = "total subtracted") -> DataFrame:
    """(file, page_idx, total_subtracted, total_added): the amounts of the first line of a page that has the label and
    an amount; a single amount is the subtracted one and the other 0. Pages without such a line give no row."""
    found = F.transform(F.regexp_extract_all("text", F.lit(r"([\d,]+\.\d{2})"), F.lit(1)), lambda x: parse_money(x))
    hits = lines.where(F.contains(F.lower("text"), F.lit(label))).withColumn("_a", found).where(F.size("_a") > 0)
    first = hits.groupBy(*PAGE).agg(F.min_by("_a", F.struct(*LINE)).alias("_a"))
    return first.select(*PAGE, F.get("_a", F.lit(0)).alias("total_subtracted"), F.coalesce(F.get("_a", F.lit(1)), F.lit(0)).cast("decimal(18,2)").alias("total_added"))


#: Section words of deposit-account statements in the order in which they are tried (word, sign, name); the
#: stricter words of their printed totals; words of parts without transactions.
SECTIONS = [
    ("DEPOSIT", 1, "Deposits and Additions"),
    ("ADDITION", 1, "Deposits and Additions"),
    ("CHECK", -1, "Checks Paid"),
    ("ATM", -1, "ATM & Debit Card Withdrawals"),
    ("DEBIT CARD", -1, "ATM & Debit Card Withdrawals"),
    ("ELECTRONIC", -1, "Electronic Withdrawals"),
    ("OTHER WITHDRAWAL", -1, "Other Withdrawals"),
    ("SERVICE FEE", -1, "Service Fees"),
    ("FEES", -1, "Fees"),
]
TOTAL_WORDS = [
    ("DEPOSITS AND ADDITIONS", "Deposits and Additions"),
    ("DEPOSITS & ADDITIONS", "Deposits and Additions"),
    ("CHECKS PAID", "Checks Paid"),
    ("ATM & DEBIT", "ATM & Debit Card Withdrawals"),
    ("ELECTRONIC WITHDRAWALS", "Electronic Withdrawals"),
    ("OTHER WITHDRAWAL", "Other Withdrawals"),
    ("SERVICE FEE", "Service Fees"),
    ("FEES", "Fees"),
]
PARTS_WITHOUT_ROWS = ["DAILY ENDING", "BALANCE", "SUMMARY", "CARD TOTALS", "CARD SUMMARY", "ATM & DEBIT CARD TOTALS", "ATM & DEBIT CARD SUMMARY", "HOW TO AVOID", "CUSTOMER SERVICE"]
#: Line beginnings that end a transaction and are none; labels of trace lines; amounts at a line's end.
ENDS_ROW = r"(?i)^\s*(?:total\s|date\s+(?:description|check)|check\s+no|if you (?:see|have|meet)|\*+\s*(?:all|an image)|page\s+\d|(?:beginning|ending)\s+balance|instances\s+amount|congratulations)"
TRACE = r"Trn:|Trace#:|Sec:|Eed:|Ind\s+\S+:|CO Entry|[1I]D:|Tax\s+Impoun|Invoice\s+Trn"
AT_TAIL = r"\$?([\d,]+\.\d{2})[\s\S]{0,15}$"
PAYLOAD = rf"(?i)(?:Descr?:|Deser:)\s*(.+?)(?=\s+(?:{TRACE})|$)"
COMPANY = r"(?i)Orig\s+CO\s+Name:\s*(.+?)(?:\s+Orig\s+[|1I!]?D:|$)"
DATED = r"^(\d{2}/\d{2})\.?[\s_]+(.+)$"


def clean_description(raw: Column) -> Column:
    """A row's text without its amount, noise before it, a repeated date and identifiers; of an ACH row the company."""
    text = F.regexp_replace(F.trim(F.regexp_replace(raw, AT_TAIL, "")), r"[\s$]+$", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^[_\-—|~]+\s*", ""), r"^\d{2}/\d{2}\.?\s+", "")
    text = F.when(text.rlike(COMPANY), F.concat(F.lit("ACH: "), F.trim(F.regexp_extract(text, COMPANY, 1)))).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)\s*Transaction#:\s*\d+", ""), r"\.\.\.\d{3,6}", "")
    text = F.regexp_replace(text, r"(?i)^(Zelle Payment (?:From|To)\s+.+|Deposit)\s+(?=[A-Za-z]*\d)[A-Za-z0-9]+$", "$1")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def total_line(text: Column) -> tuple[Column, Column]:
    """(section, amount) of a printed section total, or nulls."""
    pattern = r"(?i)^\s*total\s+(.+?)\s+\$?([\d,]+\.\d{2})\s*\S{0,6}$"

    def named(label: Column) -> Column:
        name = F.lit(None).cast("string")
        for word, section in reversed(TOTAL_WORDS):
            name = F.when(label.contains(word), section).otherwise(name)
        return name

    name = F.when(text.rlike(pattern) & ~text.rlike(r"^\d{2}/\d{2}[.\s_]"), bind(F.upper(F.regexp_extract(text, pattern, 1)), named))
    return name, F.when(name.isNotNull(), parse_money(F.regexp_extract(text, pattern, 2)))


def section_totals(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(file, section, total): the printed totals of each section, summed over the pages."""
    section, amount = total_line(F.trim("text"))
    rows = lines.select(*(by or ["file"]), section.alias("section"), amount.alias("total")).where("section is not null")
    return rows.groupBy(*(by or ["file"]), "section").agg(F.sum("total").cast("decimal(18,2)").alias("total"))


def section_rows(lines: DataFrame) -> DataFrame:
    """(file, page_idx, line_idx, section, date_text, description, amount) of sectioned statement pages.

    A header sets section and sign until the page's end; a dated line starts a row (of two dates the second counts);
    lines after it add their text if they are shorter than 120 characters and hold no amount, or their payload
    ('Descr:'), never trace labels; the first amount found counts. Lines numbered with three to six digits are rows of the checks' section.
    Total lines, headers and furniture end a row; rows without an amount go."""
    text = F.trim("text")
    rows = lines.withColumn("text", text).where("text <> ''").where(total_line(F.col("text"))[0].isNull())
    dated = F.col("text").rlike(r"^\d{2}/\d{2}[.\s_]")

    def header(upper: Column) -> Column:
        out = F.lit(None).cast("struct<section:string,sign:int>")
        for word, sign, name in reversed([(x, 0, x) for x in PARTS_WITHOUT_ROWS] + SECTIONS):
            out = F.when(upper.contains(word), F.struct(F.lit(name).alias("section"), F.lit(sign).alias("sign"))).otherwise(out)
        return out

    rows = rows.withColumn("_header", F.when(~dated, bind(F.upper("text"), header)))
    rows = carry_forward(rows, PAGE, LINE, F.col("_header"), "_in", drop_before=True).where("_in.sign <> 0")
    checks = F.col("_in.section") == "Checks Paid"
    numbered = rf"^(\d{{3,6}})\s+(?:\*+\s+)?(\S+(?:\s+\S+)?)\s+\$?([\d,]+\.\d{{2}})"
    part = lambda p, k: F.regexp_extract("text", p, k)
    start = F.when(checks, F.col("text").rlike(numbered)).otherwise(F.col("text").rlike(DATED))
    ends = F.col("_header").isNotNull() | F.col("text").rlike(ENDS_ROW)
    rows = rows.withColumn("_ends", ends).withColumn("_start", ~ends & start).where(F.col("_ends") | F.col("_start") | ~checks)
    # What is read from a line is computed before the window, so that later expressions use it as a column.
    first, second = part(DATED, 1), part(DATED, 2)
    rows = rows.withColumns({"_checks": checks, "_day": F.when(F.col("_start") & ~checks, first), "_rest": F.when(F.col("_start") & ~checks, second)})
    rows = rows.withColumn("_twice", F.col("_rest").rlike(DATED))
    rows = rows.withColumns({"_day": F.when(F.col("_twice"), F.regexp_extract("_rest", DATED, 1)).otherwise(F.col("_day")), "_rest": F.when(F.col("_twice"), F.regexp_extract("_rest", DATED, 2)).otherwise(F.col("_rest"))})
    tail = lambda c: F.when(c.rlike(AT_TAIL), parse_money(F.regexp_extract(c, AT_TAIL, 1)))
    payload = F.regexp_replace(F.regexp_replace(part(PAYLOAD, 1), r"(?i)sec:\w*", ""), r"^[\s_-]+|[\s_-]+$", "")
    goes_on = ~F.col("_start")
    rows = rows.withColumns({
        "_tail": tail(F.coalesce("_rest", "text")),
        "_payload": F.when(goes_on & F.col("text").rlike(PAYLOAD), payload),
        "_trace": goes_on & F.col("text").rlike(rf"(?i)^(?:{TRACE}|Impound\s)"),
    })
    w = Window.partitionBy(*PAGE).orderBy(*LINE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_g", F.sum((F.col("_ends") | F.col("_start")).cast("int")).over(w)).where("not _ends")
    plain = F.when(F.col("text").rlike(COMPANY), clean_description(F.col("text"))).otherwise(F.col("text"))
    said = F.when(F.col("_checks"), F.concat(F.lit("Check #"), part(numbered, 1))).when(F.col("_tail").isNotNull(), clean_description(F.col("_rest"))).otherwise(F.trim("_rest"))
    more = F.when(F.col("_payload").isNotNull(), F.nullif(F.col("_payload"), F.lit(""))).when(~F.col("_trace") & F.col("_tail").isNull() & (F.length("text") < 120), plain)
    date = F.when(F.col("_checks"), F.when(part(numbered, 2).rlike(r"^\d{2}/\d{2}$"), part(numbered, 2)).otherwise("??/??")).otherwise(F.col("_day"))
    amount = F.when(F.col("_start"), F.when(F.col("_checks"), parse_money(part(numbered, 3))).otherwise(F.col("_tail"))).when(~F.col("_trace") & F.col("_payload").isNull(), F.col("_tail"))
    rows = rows.select(*PAGE, *LINE, "_g", "_start", "_in", F.when(F.col("_start"), said).otherwise(more).alias("_text"), F.when(F.col("_start"), date).alias("_date"), amount.alias("_amount"))
    parts = F.array_sort(F.collect_list(F.struct(*LINE, "_start", "_text", "_date", "_amount", "_in")))
    grouped = rows.groupBy(*PAGE, "_g").agg(parts.alias("_p")).withColumn("_first", F.get("_p", F.lit(0))).where("_first._start")
    texts = F.filter(F.transform("_p", lambda x: x["_text"]), lambda x: x.isNotNull())
    amounts_ = F.filter(F.transform("_p", lambda x: x["_amount"]), lambda x: x.isNotNull())
    out = grouped.select(*PAGE, F.col("_first.line_idx").alias("line_idx"), F.col("_first._in.section").alias("section"), F.col("_first._date").alias("date_text"), F.array_join(texts, " | ").alias("description"), (F.get(amounts_, F.lit(0)) * F.col("_first._in.sign")).cast("decimal(18,2)").alias("amount"))
    return out.where("amount is not null")


def is_list_date(text: Column) -> Column:
    """A date line of a mobile list: short, with letters and a year from 2000 to 2099, without an amount."""
    return ~text.rlike(AMOUNT) & text.rlike(r"20\d{2}") & (F.length(text) <= 25) & text.rlike("[A-Za-z]")


def list_date(text: Column) -> Column:
    """The date text without what an icon left before it, commas at its end and with a space after the day's comma."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(text, r"^[^A-Za-z]+", "")), r"[,\s]+$", "")
    clean = F.regexp_replace(clean, r"(\d),(\d)", "$1, $2")
    return F.when(clean == "", F.trim(text)).otherwise(F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1000)))


def list_description(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^[^A-Za-z0-9]+", ""))


def positive_amount(text: Column) -> Column:
    """The amount's text without sign, currency and grouping."""
    return F.trim(F.regexp_replace(text, r"[-$,]", ""))


def numbered_rows(lines: DataFrame) -> DataFrame:
    """'12 06 Jan 2025 06 Jan 2025 text REF -1,234.00 5,000.00' lines: (.., date, description, amount, balance). A last word of
    ten or more capitals and digits, with a digit, is a reference and goes; lines of other shapes go."""
    pattern = r"^\d+\s+(\d{2}\s+\w{3}\s+\d{4})\s+\d{2}\s+\w{3}\s+\d{4}\s+(.+?)\s+(\+?-?[0-9,]+\.[0-9]{2})\s+([0-9,]+\.[0-9]{2})\s*$"
    # One match of a line gives all parts; the text, which may hold any character, is the last.
    rows = lines.where(F.col("text").rlike(pattern))
    rows = computed(rows, {"_parts": F.split(F.regexp_replace("text", pattern + r"[\s\S]*", "$1\u0001$3\u0001$4\u0001$2"), "\u0001", 4)})
    part = lambda k: F.get("_parts", F.lit({1: 0, 3: 1, 4: 2, 2: 3}[k]))
    date = F.date_format(F.try_to_date(F.regexp_replace(part(1), r"\s+", " "), "dd MMM yyyy"), "yyyy-MM-dd")
    said = F.regexp_replace(part(2), r"\s+(?=[A-Z]*[0-9])[A-Z0-9]{10,}$", "")
    return rows.select(*PAGE, *LINE, date.alias("date"), said.alias("description"), parse_money(F.regexp_replace(part(3), r"^\+", "")).alias("amount"), parse_money(part(4)).alias("balance"))


def one_amount(df: DataFrame, withdrawal: str, deposit: str, name: str = "amount") -> DataFrame:
    """The withdrawal as a negative amount or else the deposit; rows where neither is over 0 go: nothing is guessed."""
    signed = F.when(F.col(withdrawal) > 0, -F.col(withdrawal)).when(F.col(deposit) > 0, F.col(deposit))
    return df.withColumn(name, signed).where(F.col(name).isNotNull())


def side_totals(df: DataFrame, by: list[str], amount: str, date: str) -> DataFrame:
    """Counts and totals of debits and credits, and of rows without a date."""
    a = F.col(amount)
    return df.groupBy(*by).agg(F.count_if(a < 0).alias("n_debits"), F.coalesce(F.sum(F.when(a < 0, -a)), F.lit(0)).alias("debits"), F.count_if(a > 0).alias("n_credits"), F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0)).alias("credits"), F.count_if(F.col(date).isNull() | (F.col(date) == "date unknown")).alias("n_undated"))


def period_of_rows(pages: DataFrame, rows: DataFrame, year: str) -> DataFrame:
    """(file, page_idx, period): the stated period of a page; else the month of its last dated row with the file's
    `year`; else that of the page before; 'Unknown' until one is known. pages: file, page_idx, period and `year`."""
    month = F.try_to_date(F.concat(F.regexp_extract("date_text", r"^(\d{2})/", 1), F.lit("/01/2000")), "MM/dd/yyyy")
    last = rows.groupBy(*PAGE).agg(F.max_by(F.date_format(month, "MMM"), F.struct(*LINE)).alias("_m"))
    own = pages.join(last, PAGE, "left").withColumn("_p", F.coalesce("period", F.when(F.col("_m").isNotNull() & F.col(year).isNotNull(), F.concat_ws(" ", "_m", F.col(year).cast("string")))))
    return carry_forward(own, ["file"], ["page_idx"], F.col("_p"), "period", "Unknown").select(*PAGE, "period")


def card_cycle(rows: DataFrame, totals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(file, parsed, total, gap, status) of card lines and the totals that card_activity states: the cycle's net, without sign."""
    sums = rows.groupBy("file").agg(F.abs(F.sum("amount")).alias("parsed"))
    gap = F.col("total") - F.coalesce("parsed", F.lit(0))
    return totals.join(sums, "file", "full_outer").withColumn("gap", gap).withColumn("status", F.when(F.col("total").isNull(), "N/A").when(F.abs(gap) > tolerance, "GAP").otherwise("MATCH")).select("file", "parsed", "total", "gap", "status")
