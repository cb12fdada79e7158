import pytest

from tallyspark.operators.lots import lots

GRID = "file string, sheet_idx int, sheet string, row_idx int, cells array<string>"


def run(spark, layout, *sheets):
    rows = [("f", k, f"s{k}", i, c) for k, sheet in enumerate(sheets) for i, c in enumerate(sheet)]
    out = lots(spark.createDataFrame(rows, GRID), layout).orderBy("sheet_idx", "row_idx", "proceeds").collect()
    return [(r.description, r.date_acquired, r.date_sold, *[None if x is None else str(x) for x in (r.proceeds, r.cost, r.wash_sale_loss)]) for r in out]


A, B, S = "01/02/2024", "02/03/2024", "03/04/2025"


def LOT(first, second, proceeds, third=""):  # noqa: N802
    return [first, second, third, "", "1", A, S, str(proceeds), "9", "", "", "1"]



@pytest.mark.parametrize("layout,sheets,want", [
    ("morgan_stanley", [[["ACME INC CUSIP: 123"], ["", "10", A, S, "$1,000.00", "(900.50)", "", "2,184.79 W", "99"], ["Total", "", A, S, "1", "1"]], [["", "5", "Various", S, "7", "8"]]],
     [("ACME INC CUSIP: 123", A, S, "1000.00", "-900.50", "2184.79"), ("ACME INC CUSIP: 123", "Various", S, "7.00", "8.00", None)]),
    ("fidelity", [[["", "", A, S, "1", "2"], ["ACME CORP"], ["Sale", "3", A, S, "11", "9", "", "", "2"]]], [("ACME CORP", A, S, "11.00", "9.00", None)]),
    ("apex_clearing", [[["ACME", ""], [S, "1", "10", "", A, "9", "1.5", "1"], ["Totals", "", "10"]]], [("ACME", A, S, "10.00", "9.00", "1.50")]),
    ("robinhood", [[["1c- Date", "Quantity", "1d- Proceeds", "1b-", "1e-"], [S, "1", "10", A, "9"], ["Acme Corp CUSIP: 1"], [S, "1", "10", A, "9", "156.26 W", "1"], ["Totals", "", "10"]], [["Acme Corp CUSIP: 1"], [S, "1", "10", A, "9", "", "1"]]], [("Acme Corp CUSIP: 1", A, S, "10.00", "9.00", "156.26")]),
    ("robinhood", [[["1a- Description"], ["", "1d-", "1f- accrued"], ["sold / disposed quantity", "Proceeds", "market discount", "cost basis", "1b- date acquired"], ["APPLE INC. COMMON STOCK (cont'd) / Symbol:"], [S, "10", "2", "9", A]]], [("APPLE INC. COMMON STOCK", A, S, "10.00", "9.00", None)]),
    ("pershing", [[["Description (Box 1a): ACME"]], [["SELL", "2", f"{A}\n{A}", f"{S}", "66.74 \n148.24 ", "1"], ["", "", A, S, "9", "8"], ["", "", "no date", S, "9", "8"], ["BUY", "", A, S, "9", "8"]]],
     [("ACME", A, S, "66.74", "1.00", None), ("ACME", A, S, "148.24", None, None), ("ACME", A, S, "9.00", "8.00", None)]),
    ("pershing", [[["LIQUIDATION", "2", "", "", "5\n6\n\n7", ""]]], [("UNKNOWN", None, None, "5.00", None, None), ("UNKNOWN", None, None, "6.00", None, None), ("UNKNOWN", None, None, "7.00", None, None)]),
    # Two dates acquired and one sold: two lots; amounts that stand alone repeat, a date doesn't.
    ("merrill", [[["ACME", "", "100"], ["CLASS A"], ["1", "", f"{A}\n{B}", f"{S}\nx", "5.00\n6.00", "4.00", "", "1.00\n2.00"], ["Security Subtotal", "", A, S, "1.00", "1.00"]]],
     [("ACME CLASS A", A, S, "5.00", "4.00", "1.00"), ("ACME CLASS A", B, None, "6.00", "4.00", "2.00")]),
    # A merged row names the security itself; a text without cells behind it continues what stands, also behind lots and over sheets.
    ("merrill", [[["ACME", "Sale", "100"], ["OWN NAME\n1.0000 Sale", "7", f"{A}\n{A}", f"{S}\n{S}", "5.00\n6.00", "4.00\n3.00"], ["MORE"]], [["", "", A, S, "$7", "1.00"], ["NEXT", "REG", "50"], ["", A, S, "8.00", "2.00"], ["1 of 9", "", A, S, "1.00"]]],
     [("OWN NAME", A, S, "5.00", "4.00", None), ("OWN NAME", A, S, "6.00", "3.00", None), ("OWN NAME MORE", A, S, "7.00", "1.00", None), ("NEXT REG", A, S, "8.00", "2.00", None)]),
    ("charles_schwab", [[["ACME", "1", A, "$ 10.00 $ 9.00", "", "", "1.00"], ["INC", "", S, "", "", "3.00", ""], ["Total", "", A, "1", "1", "", ""]]], [("ACME INC", A, S, "10.00", "9.00", "3.00")]),
    ("jpmorgan", [[["ACME CORP"], LOT("", "", 1), ["BETA INC"], LOT("", "", 2), LOT("", "", 3)]], [("ACME CORP", A, S, "1.00", "9.00", None), ("BETA INC", A, S, "2.00", "9.00", None), ("BETA INC", A, S, "3.00", "9.00", None)]),
    # Options take the company from the row before, from rows of text after them and from the company of the next lot, within the sheet.
    ("jpmorgan", [[["ACME CORP"], LOT("CALL", "X 50", 1), ["BETA INC", "CL A"], LOT("", "PUT X", 2), LOT("GAMMA", "N V", 3, "TECH"), LOT("", "", 4)], [LOT("PUT", "Y", 5)], [["DELTA"], LOT("", "", 6)]],
     [("CALL X 50 ACME CORP BETA INC CL A", A, S, "1.00", "9.00", None), ("PUT X BETA INC CL A GAMMA N V TECH", A, S, "2.00", "9.00", None), ("GAMMA N V TECH", A, S, "3.00", "9.00", None), ("GAMMA N V TECH", A, S, "4.00", "9.00", None), ("PUT Y GAMMA N V TECH", A, S, "5.00", "9.00", None), ("DELTA", A, S, "6.00", "9.00", None)]),
    # An option's description can itself be carried; a row without any name is unknown; headers and subtotals are nobody's text.
    ("jpmorgan", [[LOT("", "", 1), ["CALL Z"], LOT("", "", 2), ["", "CUSIP", "(Box 1a)"], ["", "", "", "Subtotals"], ["OMEGA"], LOT("PUT", "Q", 3)]], [("UNKNOWN", A, S, "1.00", "9.00", None), ("CALL Z OMEGA", A, S, "2.00", "9.00", None), ("PUT Q OMEGA", A, S, "3.00", "9.00", None)]),
    ("jpmorgan", [[["ACME", "", "", "", "1", A, S, "10", "9", "", "", "1", "", "", "2.50"], ["Grand total", "", "", "", "", A, S, "1", "1"]]], [("ACME", A, S, "10.00", "9.00", "2.50")]),
    ("csv_betterment", [[["Description", "", "", "Date Acquired"], ["1.8 sh. Fund", "F", "C", "01-02-2024", "03-04-2025", "$1,168.86 ", "$1,000.00", "", "$0.00 ", "$0.00 ", "Long-term"]]], [("1.8 sh. Fund", "01-02-2024", "03-04-2025", "1168.86", "1000.00", "0.00")]),
])
def test_layout(spark, layout, sheets, want):
    assert run(spark, layout, *sheets) == want


def test_columns_are_guessed_from_headers():
    from tallyspark.operators.grid import guess_columns

    assert guess_columns(["Txn Date", "Long DESC", "Amount Subtracted", "Added"]) == {"description": "Long DESC", "date": "Txn Date", "debit": "Amount Subtracted", "credit": "Added"}
    assert guess_columns(["a", "b"]) == {"description": "a", "date": "a", "debit": "a", "credit": None}
