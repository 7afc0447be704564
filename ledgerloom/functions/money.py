"""Amounts: text or major units in, integer cents out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def round_half_up(c: Column) -> Column:
    """Round halves towards plus infinity (-2.5 -> -2)."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def to_cents(major: Column | str) -> Column:
    x = col(major).cast("double")
    cents = round_half_up((x + F.lit(EPSILON) * F.signum(x)) * F.lit(100))
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(cents)


def from_cents(cents: Column | str) -> Column:
    return col(cents) / F.lit(100)


def format_cents_plain(cents: Column | str) -> Column:
    """``340075`` -> ``3,400.75``; exact for any bigint."""
    return F.format_number(col(cents).cast("decimal(20,0)") / F.lit(100), 2)


def number_or_null(c: Column | str) -> Column:
    """Plain decimal text to double; empty text counts as zero, other text is null."""
    t = strip(c)
    return F.when(t == "", F.lit(0.0)).when(t.rlike(PLAIN_NUMBER), t.try_cast("double"))


def csv_amount(c: Column | str) -> Column:
    """Bank CSV cell: currency signs, separators and blanks dropped, ``(x)`` negative."""
    v = col(c)
    n = number_or_null(F.regexp_replace(v, r"[(),$£€\s]", ""))
    signed = F.when(strip(v).rlike(r"^\([\s\S]*\)$"), -F.abs(n)).otherwise(n)
    return F.when(v != "", to_cents(signed))


def uk_amount(c: Column | str) -> Column:
    """Statement column: blank or a dash is no amount."""
    t = strip(F.regexp_replace(col(c), ",", ""))
    return F.when((t != "") & (t != "-"), to_cents(number_or_null(t)))


def extract_amount(c: Column | str) -> Column:
    """Extract cell to cents; anything unreadable is zero."""
    return F.coalesce(to_cents(number_or_null(F.regexp_replace(col(c), ",", ""))), F.lit(0).cast("bigint"))


def ap_invoice_amount(header: Column | str, discountable: Column | str, tax: Column | str) -> Column:
    h = extract_amount(header)
    return F.when(h != 0, h).otherwise(extract_amount(discountable) + extract_amount(tax))


# Narrow currency symbols as an en-US locale prints them.
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹", "AUD": "A$", "CAD": "CA$", "NZD": "NZ$", "CNY": "CN¥"}


def _symbol(currency: Column) -> Column:
    out = F.concat(currency, F.lit(" "))
    for code, sign in CURRENCY_SYMBOLS.items():
        out = F.when(currency == code, F.lit(sign)).otherwise(out)
    return out


def format_currency(cents: Column | str, currency: Column | str) -> Column:
    c = col(cents)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), _symbol(col(currency)), format_cents_plain(F.abs(c)))


def format_compact(cents: Column | str, currency: Column | str) -> Column:
    """One decimal at most with K / M / B / T, e.g. ``$4.8M``."""
    c = col(cents)
    major = F.abs(c) / F.lit(100.0)
    shown = None
    for limit, divisor, suffix in ((1e3, 1.0, ""), (1e6, 1e3, "K"), (1e9, 1e6, "M"), (1e12, 1e9, "B"), (None, 1e12, "T")):
        tenth = F.round(major / F.lit(divisor), 1)
        text = F.concat(F.regexp_replace(F.format_number(tenth, 1), r"\.0$", ""), F.lit(suffix))
        branch = text
        fits = F.lit(True) if limit is None else F.round(major / F.lit(divisor), 1) < F.lit(1000.0)
        shown = F.when(fits, branch) if shown is None else shown.when(fits, branch)
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), _symbol(col(currency)), shown)


def format_percent(fraction: Column | str) -> Column:
    return F.concat(F.format_string("%.1f", col(fraction) * F.lit(100.0)), F.lit("%"))
