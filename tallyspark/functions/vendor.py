"""Vendor names and personal tags from bank descriptions: ordered patterns over one expression, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import bind, first_rule, strip_chain

# The patterns by which results must agree, in their order.
PURCHASE = r"(?i)^(?:Recurring\s+)?(?:Debit\s+)?(?:Card|Mobile|Debit|Online|PIN)\s+Purchase(?:\s+(?:With\s+Pin|Return))?"
MERCHANT_PREFIX = r"(?i)^(?:SQ\s*\*|SQSP\*\s*|TST\*|FSI\*|MSFT\s*\*\s*\S+\s+|Z[A-Za-z]?IP\*\s*)"
BANK_PREFIX = r"^(?:[A-Z]{2}|\d{2,3})\s+[A-Z][a-z]{1,3}\s+(?:#\d{3,5}\s+)?(?=\S)"
CLEANUP = [
    r"\s+\d{6,}\s+\d{2}/\d{2}\s*$",
    r"\s+\d{2}/\d{2}\s*$",
    r"\s+\d{5,}\s*$",
    r"\s+\d{3}[-.\s]\d{3}[-.\s]\d+(?:[-.\s]\d+)?\s*$",
    r"\s+\d{3}-\d{7}\s*$",
    r"\s+#\s*\d{2,}$",
    r"(?i)\s+NO\.?\s*\d{3,}$",
    r"\s+MV/\d+\s*$",
    r",?\s+US\s*$",
    r",\s*$",
]
CARD_NOISE = [
    r"(?i)^Nst\s+",
    r"(?i)\s+Car(?:d\s+\d+)?\s*$",
    r"\s+\d{3}[-.\s]\d{3}[-.\s]\d+(?:[-.\s]\d+)?\s*$",
    r"(?:\s+\d+){2,}\s*$",
    r"\s+MV/\d+\s*$",
    r"\s+#\s*\d+\s*$",
]
LAST_STRIPS = [r"\s+\d{5,}\s*$", r"(?<=[A-Z])\d{5,}$", r"(?:\s+\d+){3,}\s*$", r"\s+\d{2}/\d{2}\s*$"]
LABELS = [
    (r"(?i)^Cash\s+Withdrawal\b", "ATM Withdrawal"),
    (r"(?i)^ONLINE TRANSFER\b", "Online Transfer"),
    (r"(?i)^ATM\b", "ATM Withdrawal"),
    (r"(?i)^CHECK\s+#?\d+", "Check"),
    (r"(?i)^WIRE TRANSFER\b", "Wire Transfer"),
    (r"(?i)^SERVICE CHARGE\b", "Bank Service Charge"),
    (r"(?i)^BANK FEE\b", "Bank Fee"),
]
PERSONAL = [
    (r"(?i)^ATM\b", "Personal - ATM"),
    (r"(?i)\bBANK FEE\b|\bSERVICE CHARGE\b|\bMONTHLY (MAINTENANCE|SERVICE)\b", "Personal - Bank Charges"),
    (r"(?i)\bOVERDRAFT\b|\bNSF\b|\bINSUFFICIENT FUNDS\b", "Personal - Bank Charges"),
    (r"(?i)^CONTRA\b", "Personal - Contra"),
    (r"(?i)\bRETURNED ITEM\b|\bREVERSAL\b", "Personal - Reversal"),
]
ALWAYS_TAGS = ["Personal - Not Deductible", "Personal - ATM", "Personal - Bank Charges", "Personal - Contra", "Personal - Reversal", "Review with Client"]
ACH = r"(?i)^ACH:\s+(.+)$"
ELECTRONIC = r"(?i)^ACH\s+Electronic\s+(?:Debit|Credit)\s+(.+)$"
MOVED = r"(?i)^(?:Withdrawal|Deposit)\s+(?:from|to)\s+(.+)$"
BOUGHT = r"(?i)\bPurchase\s*-\s*(.+)"
ORIGIN = r"(?i)ORIG CO NAME:\s*(.*?)(?:\s+ORIG\s+ID:|\s+CO ENTRY|\s+ID:|$)"
ZELLE = r"(?i)^ZELLE\b(?:\s+(?:PAYMENT|CREDIT|DEBIT))?\s+(?:(?:TO|FROM)\s+)?(.+)"
MARKET = r"(?i)^AMAZON\s+\S*\*\s*[A-Z0-9]{4,}\s+(.*)"
AMAZON = r"(?i)^AMAZON\s*\*?\s*(.+)"
TO_CARD, TO_DATE = r"^.*?#\d{3,5}\s*", r"^.*?\b\d{2}/\d{2}\s+"
JOINTS, LEADS, ENDS, REFERENCE = r"\s*[=_]\s*", "^[—–]\\s*", "[—– ]+$", r"[A-Z]{2}US[A-Z0-9]{3,}$"


def _before(c: Column, delimiter: str) -> Column:
    return F.trim(F.substring_index(c, delimiter, 1))


def _transfers(c: Column) -> Column:
    """The clean name of the first transfer pattern that the text has, or null."""
    got = lambda p: F.trim(F.regexp_extract(c, p, 1))
    return first_rule(c, [
        (ACH, F.substring(F.substring_index(got(ACH), " | ", 1), 1, 50)),
        (ELECTRONIC, got(ELECTRONIC)),
        (MOVED, F.regexp_replace(_before(got(MOVED), " | "), r"\s+X{3,}\d+$", "")),
        (BOUGHT, F.trim(F.regexp_replace(_before(got(BOUGHT), " | "), r",\s*", " "))),
        (ORIGIN, F.substring(F.trim(F.regexp_replace(got(ORIGIN), r"\s+ORIG$", "")), 1, 50)),
        (ZELLE, F.concat(F.lit("Zelle: "), F.substring(F.regexp_replace(got(ZELLE), r"\s+[A-Za-z0-9]{8,}$", ""), 1, 50))),
        (MARKET, F.trim(F.concat(F.lit("Amazon "), got(MARKET)))),
        (AMAZON, F.trim(F.concat(F.lit("Amazon "), got(AMAZON)))),
        *LABELS,
    ])


def card_merchant(c: Column) -> Column:
    """Merchant and place of a card purchase, in the layout '- MERCHANT CITY, ST' or 'ref #card | MERCHANT | kind'."""

    def after(s: Column) -> Column:
        dash = F.trim(F.regexp_replace(_before(F.trim(F.substring(s, 3, 4000)), " | "), r",\s*", " "))
        rest = F.when(s.rlike(TO_CARD), F.regexp_replace(s, TO_CARD, "")).otherwise(F.regexp_replace(s, TO_DATE, ""))
        return F.when(s.rlike(r"^-\s"), dash).otherwise(_before(F.trim(F.regexp_replace(F.trim(rest), r"^\|\s*", "")), " | "))

    t = bind(F.trim(F.regexp_replace(c, PURCHASE, "")), after)
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, JOINTS, " ")), LEADS, ""))
    t = reduce(lambda x, p: F.regexp_replace(x, p, ""), CARD_NOISE, t)
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, REFERENCE, ""), ENDS, "")), 1, 80)


def _card_vendor(d: Column) -> Column:
    return bind(card_merchant(d), lambda card: F.coalesce(_transfers(card), strip_chain(F.trim(F.regexp_replace(card, MERCHANT_PREFIX, "")), CLEANUP)))


def _first_part(c: Column) -> Column:
    """The text before the first kind of delimiter that it has."""
    out = c
    for delimiter in (" / ", " | ", " - ", "  "):
        out = F.when(c.contains(delimiter), _before(c, delimiter)).otherwise(out)
    return out


def _plain_vendor(d: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(d, MERCHANT_PREFIX, "")), BANK_PREFIX, ""))
    other = bind(bare, lambda x: F.coalesce(F.when(x != d, _transfers(x)), bind(strip_chain(x, CLEANUP), _first_part)))
    return F.coalesce(_transfers(d), other)


def vendor_name(description: Column) -> Column:
    """The vendor with its place, without dates, references, phone numbers and payment words; at most 80 characters."""

    def of(d: Column) -> Column:
        name = F.when(d.rlike(PURCHASE), _card_vendor(d)).otherwise(_plain_vendor(d))
        return bind(F.substring(strip_chain(name, LAST_STRIPS), 1, 80), lambda x: F.when(x != "", x).otherwise(F.substring(d, 1, 80)))

    return bind(F.trim(description), of)


def personal_tag(vendor: Column) -> Column:
    """The personal sub-type that a vendor's name shows, or ''."""
    return first_rule(F.coalesce(vendor, F.lit("")), PERSONAL, F.lit(""))
