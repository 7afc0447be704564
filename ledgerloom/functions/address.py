"""Address quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .money import text_or_empty

# Country codes seen before a postcode, and postcode formats.
COUNTRY_PREFIX = r"(?i)^(AT|BE|BG|CY|CZ|DE|DK|EE|EL|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|PL|PT|RO|SE|SI|SK|UK)\s+"
POSTAL = {
    "NL": r"(?i)^\d{4}\s?[A-Z]{2}$", "GB": r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$", "DE": r"^\d{5}$", "FR": r"^\d{5}$",
    "IT": r"^\d{5}$", "ES": r"^\d{5}$", "BE": r"^\d{4}$", "PT": r"^\d{4}(-\d{3})?$", "SE": r"^\d{3}\s?\d{2}$",
    "DK": r"^\d{4}$", "AT": r"^\d{4}$", "PL": r"^\d{2}-\d{3}$", "LU": r"^\d{4}$", "IE": r"(?i)^[A-Z]\d{2}\s?[A-Z0-9]{4}$",
}
CITY_POSTAL = r"(?i)\b(\d{4,6}|[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2})\b"


def _issue(test: Column, kind: str, field: str, message: Column | str, suggestion: Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    hint = F.lit(None).cast("string") if suggestion is None else suggestion
    return F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), text.alias("message"), hint.alias("suggestion")))


def assess_address(country: Column | str, line1: Column | str, city: Column | str, postal: Column | str) -> Column:
    """Issues of an address as an array of structs, in a fixed order."""
    nation, street, town, code = F.upper(text_or_empty(country)), text_or_empty(line1), text_or_empty(city), text_or_empty(postal)
    bare = F.trim(F.regexp_replace(code, COUNTRY_PREFIX, ""))
    expected = F.lit(None).cast("boolean")
    for land, pattern in POSTAL.items():
        expected = F.when(nation == land, bare.rlike(pattern)).otherwise(expected)
    in_city = F.nullif(F.trim(F.regexp_extract(town, CITY_POSTAL, 1)), F.lit(""))
    # Only the first postcode in the city counts, so the text is cut around it.
    before, after = F.regexp_extract(town, r"(?i)^([\s\S]*?)" + CITY_POSTAL[4:], 1), F.regexp_replace(town, r"(?i)^[\s\S]*?" + CITY_POSTAL[4:], "")
    city_only = F.nullif(F.trim(F.regexp_replace(F.concat(before, after), r"[,-]+$", "")), F.lit(""))
    stuffed = (code == "") & in_city.isNotNull()
    return F.array_compact(F.array(
        _issue(street == "", "missing_line", "addressLine1", "Address line 1 is missing."),
        _issue(town == "", "missing_city", "city", "City is missing."),
        _issue(code == "", "missing_postal", "postalCode", "Postal code is missing."),
        _issue(code.rlike(COUNTRY_PREFIX), "postal_has_country_prefix", "postalCode", "Postal code includes a country prefix.", F.nullif(bare, F.lit(""))),
        _issue(stuffed, "city_contains_postal", "city", "City field appears to contain a postal code.", F.coalesce(city_only, in_city)),
        _issue(stuffed, "missing_postal", "postalCode", "Postal code looks embedded in the city field.", in_city),
        _issue((bare != "") & ~expected, "postal_format", "postalCode", F.concat(F.lit("Postal code does not match the expected "), nation, F.lit(" format."))),
    ))


# Postal codes looked for in a registered address, in order.
REGISTERED_POSTAL = (r"(?i)\b(\d{4}\s*[A-Z]{2})\b", r"\b(\d{5})\b", r"\b(\d{2}\s*\d{3})\b")


def split_registered(address: Column | str) -> Column:
    """``street, postal_code, city`` of an address in one line, cut around its first postal code; all street without one."""

    def parts(line: Column) -> Column:
        code = F.coalesce(*(F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in REGISTERED_POSTAL), F.lit(""))

        def around(c: Column) -> Column:
            at = F.instr(F.upper(line), F.upper(c))
            before = F.trim(F.regexp_replace(F.substring(line, F.lit(1), at - 1), r"[/.,]+$", ""))
            after = F.trim(F.regexp_replace(F.substring(line, at + F.length(c), F.length(line)), r"^[/,\s]+", ""))
            full = lambda v: F.nullif(v, F.lit(""))
            return F.struct(
                F.when(c == "", full(line)).otherwise(full(before)).alias("street"), full(F.trim(F.regexp_replace(c, r"\s+", " "))).alias("postal_code"),
                F.when(c != "", full(after)).alias("city"),
            )

        return let(code, around)

    return let(F.trim(F.regexp_replace(F.coalesce(address, F.lit("")) if not isinstance(address, str) else F.coalesce(F.col(address), F.lit("")), r"\s+", " ")), parts)
