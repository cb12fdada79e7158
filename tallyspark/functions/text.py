"""Column functions that read money, dates and blanks from messy text. All are built-in expressions; bad text gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as an empty cell.
BLANKS = ["", "nan", "none", "nat", "null", "--", "...", "n/a"]
#: The same as a pattern; lower() takes several times as long.
_BLANK = r"(?i)\A(?:" + "|".join(r"\Q" + b + r"\E" for b in BLANKS) + r")\z"
#: Date formats in the order in which they are tried.
DATE_FORMATS = ["M/d/yyyy", "M-d-yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy"]


def bind(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it: a repeated expression may be run again in every branch."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def null_if_blank(c: Column) -> Column:
    """The trimmed text, or null for an empty cell."""
    t = F.trim(c.cast("string"))
    return F.when(~t.rlike(_BLANK), t)


def money_text(c: Column, strip_letters: bool = True) -> Column:
    """Digits, point and sign of a money text: $, commas and spaces go, (x) is negative, letters behind it go."""
    t = F.regexp_replace(null_if_blank(c), r"[$,\s]", "")
    t = F.when(t.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(t, r"[()-]", ""))).otherwise(t)
    return F.regexp_replace(t, r"[A-Za-z]+$", "") if strip_letters else t


#: Texts without a digit are no number, plain ones need no cleaning, and what Java can't read as a decimal isn't given to the cast:
#: a failed cast raises an exception inside, which costs more than all patterns together.
_PLAIN = r"^-?[0-9]{1,12}(?:\.[0-9]{1,4})?$"
_GROUPED = r"^-?[0-9]{1,3}(?:,[0-9]{3}){1,3}\.[0-9]{2}\z"
_DECIMAL = r"^[\x00-\x20]*[+-]?[\p{Nd}.]+(?:[eE][+-]?\p{Nd}+)?[\x00-\x20]*$"


def parse_money(c: Column, strip_letters: bool = True) -> Column:
    """DECIMAL(18,2) of a money text such as $1,234.56, (100.50) or 2,184.79 W; grouping may be of any kind."""
    decimal = lambda t: F.when(t.rlike(_DECIMAL), t).try_cast("decimal(18,2)")

    def read(t: Column) -> Column:
        return F.when(t.rlike(_PLAIN), t.try_cast("decimal(18,2)")).when(t.rlike(_GROUPED), F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(18,2)")).when(t.rlike(r"\p{Nd}"), bind(money_text(t, strip_letters), decimal))

    return bind(c.cast("string"), read)


def clean_numeric(c: Column) -> Column:
    """The text's digits, points and minus signs alone."""
    return F.regexp_replace(c, r"[^\d.\-]", "")


def money_or_text(c: Column) -> Column:
    """The number as text, or the trimmed text itself if it is none."""
    return F.coalesce(parse_money(c).cast("string"), null_if_blank(c))


def two_digit_year(y: Column) -> Column:
    """30 and below is 20xx, others 19xx; four digits stay."""
    n = y.try_cast("int")
    return F.when(n > 99, n).when(n <= 30, n + 2000).otherwise(n + 1900)


def _slash_date(t: Column) -> Column:
    part = lambda k: F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})$", k)
    text = F.concat_ws("-", two_digit_year(part(3)).cast("string"), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))
    return F.when(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-](\d{2}|\d{4})$"), F.try_to_date(text, "yyyy-MM-dd"))


def serial_date(c: Column) -> Column:
    """Spreadsheet serial numbers between 1 and 100000, in days from 1899-12-30."""
    n = c.try_cast("double")
    return F.when((n > 1) & (n < 100000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """DATE of a text in month-first slashes or dashes, ISO, month names, or a serial number; else null."""
    t = F.regexp_replace(null_if_blank(c), r"[\s$]+$", "")
    return F.coalesce(_slash_date(t), *[F.try_to_date(t, f) for f in formats or DATE_FORMATS], F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"), serial_date(t))


def date_text(c: Column) -> Column:
    """MM/dd/yyyy; 'Various' stays; what is no date stays as it is; blank is ''."""
    t = null_if_blank(c)
    return F.when(t.isNull(), "").when(F.upper(t) == "VARIOUS", "Various").otherwise(F.coalesce(F.date_format(parse_date(c), "MM/dd/yyyy"), t))


def is_date(c: Column) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[\s$]+$", "")
    return t.rlike(r"(?i)^(\d{1,2}[/-]\d{1,2}[/-](\d{2}|\d{4})|\d{4}-\d{2}-\d{2}.*|various)$")


#: is_date for some line of a text, as one pattern.
_DATE_LINE = r"(?i)(?:^|\n) *(?:\d{1,2}[/-]\d{1,2}[/-](?:\d{2}|\d{4})|\d{4}-\d{2}-\d{2}.*|various)[\s$&&[^\n]]*[\u0085\u2028\u2029]?[\s$&&[^\n]]*(?:\n|\z)"


def has_date(c: Column) -> Column:
    """Some line of the cell is a date."""
    return F.coalesce(c.rlike(_DATE_LINE), F.lit(False))


def is_money(c: Column) -> Column:
    return parse_money(c).isNotNull()


def iso_date(c: Column, fmt: str) -> Column:
    """ISO text of a date in one known format, or null."""
    return F.date_format(F.try_to_date(F.trim(c), fmt), "yyyy-MM-dd")


def term(c: Column) -> Column:
    """L or S for texts that name a long or short term, else ''."""
    u = F.upper(F.coalesce(c, F.lit("")))
    return F.when(u.contains("LONG") | (u == "L"), "L").when(u.contains("SHORT") | (u == "S"), "S").otherwise("")


def wash_sale(merged: Column) -> tuple[Column, Column]:
    """(accrued discount, wash sale loss) of a column that holds either: what isn't zero is a wash sale."""
    n = parse_money(merged)
    return F.lit(None).cast("decimal(18,2)"), F.when(n != 0, n)


def month_label(c: Column) -> Column:
    """Three-letter month of a date text; 'Jan' if none can be read."""
    return F.coalesce(F.date_format(parse_date(c), "MMM"), F.lit("Jan"))


#: Month names in full and in three letters.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
MONTH = "(?:" + "|".join(MONTHS) + ")"
MONTH_WORD = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + ")"
#: How statements print their period, in the order in which they are tried; and years.
PERIODS = [(rf"(?i)AS OF\s+(\w+ \d+,?\s*\d{{4}})", 1), (rf"(?i)({MONTH}\s+\d+\s+-\s+{MONTH}\s+\d+,\s*\d{{4}})", 1), (rf"(?i){MONTH}\s+\d+,\s*\d{{4}}\s+through\s+\S+\s+\d+,\s*\d{{4}}", 0), (r"(?i)Statement Period[:\s]+(\S+ .+?\d{4})", 1)]
YEARS = [r"©\s*(20\d{2})", rf"(?i){MONTH}\s+\d+,?\s*(20\d{{2}})"]


def statement_period(c: Column) -> Column:
    """The period that a text states, as it is printed, or null."""
    found = [F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit("")) for pattern, group in PERIODS]
    return F.coalesce(*found)


def statement_year(c: Column) -> Column:
    """The year of a copyright line or of a date with a month's name, or null."""
    return F.coalesce(*[F.regexp_extract(c, pattern, 1).try_cast("int") for pattern in YEARS])


def period_label(c: Column) -> Column:
    """'Apr 2025' of a text with the word of a month and a year behind it, or null."""
    pattern = rf"(?is)\b({MONTH_WORD})\b.*?\b((?:19|20)\d{{2}})\b"
    month, year = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(month != "", F.concat(F.initcap(F.substring(month, 1, 3)), F.lit(" "), year))


def period_order(label: Column) -> Column:
    """First day of a period label; labels that name none sort last as 9999-12-01."""
    return F.coalesce(F.try_to_date(F.concat(F.lit("1 "), label), "d MMM yyyy"), F.lit("9999-12-01").cast("date"))


def natural_key(c: Column) -> Column:
    """A sort key under which page-2 comes before page-10: every number is filled up with zeros."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 12, "0")).otherwise(F.lower(x))), "")


def duration_text(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def slug(c: Column) -> Column:
    """Lower-case letters and digits with _ between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def strip_chain(c: Column, patterns: list[str]) -> Column:
    """Removes each pattern once, in order, trimming after each."""
    return reduce(lambda x, p: F.trim(F.regexp_replace(x, p, "")), patterns, c)


def first_rule(text: Column, rules: list[tuple[str, Column | str]], otherwise: Column | None = None) -> Column:
    """The value of the first (pattern, value) whose pattern is found in the text."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def _alternation(words: list[str]) -> str:
    """A pattern of the words under (?i), dealt by their first character: most places of a text are passed by one look at a class."""
    quoted = lambda t: r"\Q" + t + r"\E"
    if not all(words):
        return "|".join(map(quoted, words))
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0].lower() if w[0].isascii() else w[0], []).append(quoted(w[1:]))
    return f"(?=[{quoted(''.join(groups))}])(?:" + "|".join(f"{quoted(c)}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


def contains_any(text: Column, words: list[str], whole: bool = False) -> Column:
    """One case-insensitive alternation over the words; `whole` asks for no word character beside them."""
    body = _alternation(words)
    return text.rlike(rf"(?i)(?:^|[^A-Za-z0-9_])(?:{body})(?:$|[^A-Za-z0-9_])" if whole else f"(?i)(?:{body})")


def unfence(c: Column) -> Column:
    """A model's JSON answer without the code fence around it."""
    return F.trim(F.regexp_replace(c, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def parse_answers(c: Column) -> Column:
    """Array of (vendor, tag, subcategory, confidence, reason) of a model's JSON answer; bad JSON is null."""
    return F.from_json(unfence(c), "array<struct<vendor:string,tag:string,subcategory:string,confidence:double,reason:string>>")


def ocr_amount(tokens: Column) -> Column:
    """The amount of digit groups that recognition split: ["248","04"] is 248.04, "048" is 0.48."""
    t = F.array_join(F.transform(tokens, lambda x: F.regexp_replace(x, r"[^\d.]", "")), " ")
    two = F.regexp_extract(t, r"^(\d+) (\d{2})$", 1)
    return F.when(two != "", F.concat(two, F.lit("."), F.regexp_extract(t, r"^(\d+) (\d{2})$", 2)).try_cast("decimal(18,2)")).when(t.rlike(r"^0\d{2}$"), F.concat(F.lit("0."), F.substring(t, 2, 2)).try_cast("decimal(18,2)")).otherwise(t.try_cast("decimal(18,2)"))


def label(c: Column, names: dict[str, str]) -> Column:
    """The fixed name of a text, looked up in lower case, or the trimmed text with capitals; unlike a join it stays in the row."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(c))), F.initcap(F.trim(c)))


def plain_number(c: Column) -> Column:
    """A number in its natural precision: 5.0 is 5, 5.50 is 5.5."""
    t = c.cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
