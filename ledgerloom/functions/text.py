"""Identifiers, references and bank free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import blank_to_null, col, strip

# Reference patterns and words too general to identify a payment.
SO_PO_TOKEN = r"(?i)\b((?:SO|PO)-\d+)\b"
INVOICE_TOKEN = r"(?i)\b((?:INV[-/ ]?)?[A-Z]{0,6}\d{5,12})\b"
GENERIC_REFERENCES = ("ABI", "BACS", "CHAPS", "FASTER", "CASH", "CHECK", "CHEQUE", "DD", "DIRECTDEBIT")
GB_COUNTRIES = ("GB", "UK", "GBR")
# What a regular expression takes as white space; single characters are dropped without one.
WHITE_SPACE = " \t\n\x0b\f\r"

COUNTRY_COLUMNS = ("taxation_country", "country", "bill_to_country", "ship_to_country", "bill_country")
UNIT_COLUMNS = (
    "operating_unit", "operating_unit_name", "business_unit", "org_name", "bill_to_location",
    "ship_to_location", "bill_to_bu", "procurement_bu", "requisitioning_bu",
)


def norm_key(c: Column | str) -> Column:
    """Upper case without white space: the form in which references are compared."""
    return F.upper(F.translate(col(c), WHITE_SPACE, ""))


def compact_id(c: Column | str) -> Column:
    """``167497.000`` -> ``167497``."""
    return strip(F.regexp_replace(col(c), r"\.0+$", ""))


def integer_id(c: Column | str) -> Column:
    """As :func:`compact_id` but only when all that precedes is digits."""
    return F.regexp_replace(F.coalesce(strip(c), F.lit("")), r"^(\d+)\.0+$", "$1")


def base_name(c: Column | str) -> Column:
    return F.nullif(strip(F.element_at(F.split(col(c), "/"), -1)), F.lit(""))


def source_locator(file: Column | str, row: Column | str, page: Column | str | None = None) -> Column:
    parts = [F.nullif(col(file), F.lit("")), F.concat(F.lit("row "), col(row).cast("string"))]
    if page is not None:
        parts.append(F.concat(F.lit("page "), col(page).cast("string")))
    return F.concat_ws(" ", *parts)


def first_filled(*cols: Column | str) -> Column:
    """First non-empty of several columns, else empty text."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cols], F.lit(""))


def join_filled(*cols: Column | str) -> Column:
    """Non-blank fields joined by one space, each kept as it stands."""
    return F.concat_ws(" ", *[F.when(F.translate(col(c), WHITE_SPACE, "") != "", col(c)) for c in cols])


def match_tokens(*cols: Column | str) -> Column:
    """Distinct upper-case document references found in bank text; never null."""
    hay = F.concat_ws(" ", *[F.nullif(col(c), F.lit("")) for c in cols])
    found = F.concat(F.regexp_extract_all(hay, F.lit(SO_PO_TOKEN)), F.regexp_extract_all(hay, F.lit(INVOICE_TOKEN)))
    # all at once, as a text: no token holds a line break
    listed = F.upper(F.translate(F.array_join(found, "\n"), " ", ""))
    return F.array_distinct(F.when(listed == "", F.array().cast("array<string>")).otherwise(F.split(listed, "\n")))


def norm_keys(keys: Column) -> Column:
    """The different :func:`norm_key` of an array of texts without nulls, in order; most lists are in that form already and stay as they are."""
    listed = F.array_join(keys, "")
    return F.when(norm_key(listed) == listed, keys).otherwise(F.transform(keys, norm_key))


def is_distinctive_reference(c: Column | str) -> Column:
    v = F.coalesce(strip(c), F.lit(""))
    return (F.length(v) >= 5) & ~F.upper(v).isin(*GENERIC_REFERENCES)


def is_gb_country(c: Column | str) -> Column:
    return F.coalesce(F.upper(strip(c)).isin(*GB_COUNTRIES), F.lit(False))


def is_uk_org_row(field) -> Column:
    """UK row when geography says so, or when the row has no geography at all.

    ``field(name)`` gives the column of that name, or null where the extract has none.
    """
    countries = [field(n) for n in COUNTRY_COLUMNS]
    units = [F.coalesce(field(n), F.lit("")) for n in UNIT_COLUMNS]
    org = F.coalesce(field("org_id"), F.lit(""))
    places = F.concat_ws(" ", *units)
    none_given = (first_filled(*countries) == "") & (org == "") & (first_filled(*units) == "")
    return (
        is_gb_country(first_filled(*countries))
        | (org == "112")
        | places.rlike(r"(?i)\b(uk|gb|gbr|united kingdom)\b")
        | none_given
    )


def po_status(c: Column | str) -> Column:
    v = F.upper(F.coalesce(col(c), F.lit("")))
    return (
        F.when(v.contains("CANCEL"), "cancelled")
        .when(v.rlike("PAID|FINALLY CLOSED"), "paid")
        .when(v.rlike("BILL|CLOSED"), "billed")
        .otherwise("open")
    )


def po_document_id(c: Column | str) -> Column:
    v = col(c)
    return F.when(v.rlike(r"(?i)^PO"), v).otherwise(F.concat(F.lit("PO-"), v))


def bank_narrative(narrative: Column | str, description: Column | str) -> Column:
    return F.coalesce(blank_to_null(narrative), strip(description), F.lit(""))


def natural_sort_key(c: Column | str) -> Column:
    """Sort key in which digit runs compare as numbers and case is ignored.

    Each digit run is written as its length (three digits) and then itself
    without leading zeros, so text order equals numeric order.
    """
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\d+|\D+)"))
    bare = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    return F.array_join(
        F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(r)).cast("string"), 3, "0"), bare(r))).otherwise(r)),
        "",
    )


def join_prefix(*parts: Column | str) -> Column:
    """Object-prefix segments joined by one slash, with a trailing slash."""
    cleaned = F.filter(F.array(*[F.regexp_replace(col(p), r"^/+|/+$", "") for p in parts]), lambda p: p != "")
    return with_trailing_slash(F.array_join(cleaned, "/"))


def strip_trailing_slash(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"/+$", "")


def with_trailing_slash(c: Column | str) -> Column:
    return F.when(col(c).endswith("/"), col(c)).otherwise(F.concat(col(c), F.lit("/")))


def is_safe_key(c: Column | str) -> Column:
    """Relative keys of at most 1024 characters, without ``..``, back slashes or NUL."""
    v = F.coalesce(col(c), F.lit(""))
    return (v != "") & (F.length(v) <= 1024) & ~v.startswith("/") & ~v.rlike(r"\\|\.\.|\x00")
