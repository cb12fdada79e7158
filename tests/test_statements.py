import pytest

from tallyspark.operators import statements as s


def lines(spark, *pages):
    return spark.createDataFrame([("f", p, i, t) for p, page in enumerate(pages) for i, t in enumerate(page)], "file string, page_idx int, line_idx int, text string")


@pytest.mark.parametrize("page,want", [
    (["04/01 ACH Electronic Credit PAYROLL 1,000.00 5,000.00", "ref 12 more"], [("04/01", "ACH Electronic Credit PAYROLL | ref 12 more", None, "1000.00", "5000.00")]),
    (["04/02 Debit Card Purchase SHOP", "9.50 4,990.50", "Totai Subtracted 9.50", "late"], [("04/02", "Debit Card Purchase SHOP", "9.50", None, "4990.50")]),
    (["04/03/25 Odd thing 1.00 2.00 3.00"], [("04/03/25", "Odd thing", "1.00", "2.00", "3.00")]),
    (["04/03 Odd thing 1.00 2.00 words behind"], [("04/03", "[CHECK TYPE] Odd thing", "1.00", None, "2.00")]),
    (["04/03 Deposit 1.00"], [("04/03", "Deposit", None, "1.00", None)]),
    (["04/03 Nobody knows 7.00"], [("04/03", "Nobody knows", None, None, "7.00")]),
    (["04/03 Purchase 1.00 2.00 3.00 4.00"], [("04/03", "Purchase", None, None, "4.00")]),
    # No amounts: dropped by a date or furniture, left without any after two lines or at the page's end.
    (["04/03 Purchase", "04/04 Deposit 2.00 3.00"], [("04/04", "Deposit", None, "2.00", "3.00")]),
    (["04/03 Purchase", "x", "IF YOU HAVE questions 1.00", "1.00"], []),
    (["04/03 Purchase", "x", "y", "1.00", "04/04 Deposit 2.00"], [("04/03", "Purchase | x | y", None, None, None), ("04/04", "Deposit", None, "2.00", None)]),
    (["04/03 Purchase", "x", "1.00 2.00", "y", "z", "w"], [("04/03", "Purchase | x | y | z", "1.00", None, "2.00")]),
    (["04/03 Purchase", "x"], [("04/03", "Purchase | x", None, None, None)]),
    (["04/01 Opening Balance 5.00", "x 1.00", "04/30 closing  balance 5.00"], []),
    (["04/01 Deposit 5.00 6.00", "long " * 25, "a", "", "b", "c"], [("04/01", "Deposit | a | b", None, "5.00", "6.00")]),
    (["04/01 ref 123.456 Deposit 5.00"], [("04/01", "ref 123.456 Deposit", None, "5.00", None)]),
    (["04/01 FDIC 5.00", "x"], []),
])
def test_dated_lines(spark, page, want):
    got = [(r.date_text, r.description, *(None if v is None else str(v) for v in (r.subtracted, r.added, r.balance))) for r in s.dated_lines(lines(spark, page)).orderBy("line_idx").collect()]
    assert got == want


def test_card_and_accounts(spark):
    rows, totals = s.card_activity(lines(spark, ["01/01 before 1.00", "ACCOUNT ACTIVITY", "01/05 STORE 12.00", "x"], ["01/06 PAYMENT -2.00", "TRANSACTIONS THIS CYCLE $10.00", "01/07 after 3.00"]))
    assert [(r.description, str(r.amount)) for r in rows.orderBy("page_idx", "line_idx").collect()] == [("STORE", "12.00"), ("PAYMENT", "-2.00")]
    assert str(totals.first().total) == "10.00"
    df = lines(spark, ["Jan 1 lost - $1.00 $1.00", "Simply Checking - 1234567", "Jan 6 Purchase - $88.29 $1,000.00", "Fees Summary", "Jan 7 fee - $1.00 $9.00"], ["Jans Deposit + $2,400.00"])
    got = [(r.account, r.date_text, r.description, str(r.amount)) for r in s.account_lines(df, r"Simply Checking - \d{7,}").orderBy("page_idx", "line_idx").collect()]
    assert got == [("Simply Checking - 1234567", "Jan 6", "Purchase", "-88.29"), ("Simply Checking - 1234567", "Jan ??", "Deposit", "2400.00")]
    assert [r.period for r in s.with_periods(lines(spark, ["a"], ["AS OF MARCH 31, 2025"], ["b"])).orderBy("page_idx").collect()] == ["Unknown", "Mar 2025", "Mar 2025"]
    assert [(r.check, r.date_text, str(r.amount)) for r in s.check_rows(lines(spark, ["1042 ** 01/16 $50.00", "1043 xx 5.00"])).collect()] == [("1042", "01/16", "-50.00"), ("1043", "??/??", "-5.00")]
