"""Date text to ISO ``YYYY-MM-DD`` strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col, strip

# English month names, cut to three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Textual dates the bank CSV reader accepts besides ISO and D/M/Y.
LENIENT_FORMATS = ("d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d")


def month_number(name: Column) -> Column:
    """Two-digit month for an English month name of three or more letters."""
    short = F.lower(F.substring(name, 1, 3))
    out = F.lit(None).cast("string")
    for i, m in enumerate(MONTHS, 1):
        out = F.when(short == m, F.lit(f"{i:02d}")).otherwise(out)
    return out


def iso_text(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def csv_date(c: Column | str) -> Column:
    """ISO as is, ``D/M/Y`` without a range check, then a short list of textual formats."""
    v = strip(c)
    slash = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    timestamp_head = r"^(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}"
    textual = F.coalesce(*[
        F.date_format(F.try_to_timestamp(v, F.lit(fmt)), "yyyy-MM-dd") for fmt in LENIENT_FORMATS
    ])
    return (
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v)
        .when(v.rlike(slash), iso_text(F.regexp_extract(v, slash, 3), F.regexp_extract(v, slash, 2), F.regexp_extract(v, slash, 1)))
        .when(v.rlike(timestamp_head), F.regexp_extract(v, timestamp_head, 1))
        .otherwise(textual)
    )


def uk_date(c: Column | str) -> Column:
    """``28 Aug 2026`` -> ``2026-08-28``."""
    v = strip(c)
    shape = r"^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})$"
    month = month_number(F.regexp_extract(v, shape, 2))
    return F.when(v.rlike(shape) & month.isNotNull(), iso_text(F.regexp_extract(v, shape, 3), month, F.regexp_extract(v, shape, 1)))


def extract_date(c: Column | str) -> Column:
    """Leading ``Y-M-D`` or ``Y/M/D`` of an extract cell, else empty."""
    v = F.coalesce(strip(c), F.lit(""))
    shape = r"^(\d{4})[-/](\d{2})[-/](\d{2})"
    return F.when(v.rlike(shape), F.regexp_replace(F.substring(v, 1, 10), "/", "-")).otherwise(F.lit(""))


def days_between(a: Column | str, b: Column | str) -> Column:
    return F.abs(F.datediff(col(a).try_cast("date"), col(b).try_cast("date")))
