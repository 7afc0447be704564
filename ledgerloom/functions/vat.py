"""VAT numbers: normal form, country prefix, format and check digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .money import col, text_or_empty

# Published VAT body format per country prefix (prefix removed).
BODY = {
    "AT": r"^U\d{8}$", "BE": r"^\d{10}$", "BG": r"^\d{9,10}$", "CY": r"^\d{8}[A-Z]$", "CZ": r"^\d{8,10}$",
    "DE": r"^\d{9}$", "DK": r"^\d{8}$", "EE": r"^\d{9}$", "EL": r"^\d{9}$", "ES": r"^[A-Z0-9]\d{7}[A-Z0-9]$",
    "FI": r"^\d{8}$", "FR": r"^[A-Z0-9]{2}\d{9}$", "GB": r"^\d{9}$|^\d{12}$|^GD\d{3}$|^HA\d{3}$", "HR": r"^\d{11}$",
    "HU": r"^\d{8}$", "IE": r"^\d{7}[A-Z]{1,2}$|^\d[A-Z+*]\d{5}[A-Z]$", "IT": r"^\d{11}$", "LT": r"^\d{9}$|^\d{12}$",
    "LU": r"^\d{8}$", "LV": r"^\d{11}$", "MT": r"^\d{8}$", "NL": r"^\d{9}B\d{2}$", "PL": r"^\d{10}$", "PT": r"^\d{9}$",
    "RO": r"^\d{2,10}$", "SE": r"^\d{12}$", "SI": r"^\d{8}$", "SK": r"^\d{10}$",
}
# Other spellings of two prefixes.
ALIASES = {"GR": "EL", "UK": "GB"}
# Check-digit weights.
NL_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2)
PT_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2)
GB_WEIGHTS = (8, 7, 6, 5, 4, 3, 2)


def normalise_vat(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\s.\-/]", ""))


def alias_country(c: Column | str) -> Column:
    v = F.upper(col(c))
    out = v
    for code, prefix in ALIASES.items():
        out = F.when(v == code, prefix).otherwise(out)
    return out


def vat_prefix(normal: Column) -> Column:
    """Country prefix a normalised number starts with, or null."""
    known = alias_country(F.substring(normal, 1, 2))
    return F.when(known.isin(*BODY), known)


def vat_body(prefix: Column, normal: Column) -> Column:
    """The number without its prefix; a prefix written in its other spelling stays."""
    return F.when(normal.startswith(prefix), F.substring(normal, F.length(prefix) + 1, F.length(normal))).otherwise(normal)


def format_ok(prefix: Column, body: Column) -> Column:
    chain = F.lit(False)
    for code, pattern in BODY.items():
        chain = F.when(prefix == code, body.rlike(pattern)).otherwise(chain)
    return chain


def _digit(body: Column, i: int) -> Column:
    return F.substring(body, i, 1).try_cast("int")


def _weighted(body: Column, weights) -> Column:
    return reduce(lambda a, b: a + b, [_digit(body, i) * F.lit(w) for i, w in enumerate(weights, 1)])


def checksum_fails(prefix: Column, body: Column) -> Column:
    """True where a format-valid body has the wrong check digits (five countries have a rule)."""
    number = lambda start, n: F.substring(body, start, n).try_cast("int")
    nl = _weighted(body, NL_WEIGHTS) % 11
    pt = _weighted(body, PT_WEIGHTS) % 11
    # Every second digit doubled, the digits of the product added.
    luhn = reduce(lambda a, b: a + b, [
        _digit(body, i) if i % 2 else (_digit(body, i) * 2 - F.when(_digit(body, i) > 4, 9).otherwise(0)) for i in range(1, 11)
    ])
    gb = _weighted(body, GB_WEIGHTS)
    gb_check = number(8, 2)
    good = (
        F.when(prefix == "BE", F.lit(97) - number(1, 8) % 97 == number(9, 2))
        .when(prefix == "NL", (nl != 10) & (nl == _digit(body, 9)))
        .when(prefix == "PT", F.when(pt < 2, 0).otherwise(F.lit(11) - pt) == _digit(body, 9))
        .when(prefix == "IT", (F.lit(10) - luhn % 10) % 10 == _digit(body, 11))
        .when((prefix == "GB") & ~body.rlike(r"^[GH]"), (gb_check == F.lit(97) - gb % 97) | (gb_check == F.lit(97) - (gb + 55) % 97))
        .otherwise(F.lit(True))
    )
    return ~F.coalesce(good, F.lit(True))


def with_vat_assessment(df: DataFrame, value: Column | str, country: Column | str, out: str) -> DataFrame:
    """Add ``out``: status, normalised number, country, message and suggestion of a VAT number.

    Staged in columns so that each step is evaluated once per row.
    """
    t = lambda name: f"_{out}_{name}"
    c = lambda name: F.col(t(name))
    staged = df.withColumns({t("raw"): text_or_empty(value), t("home"): F.nullif(alias_country(country), F.lit(""))})
    staged = staged.withColumn(t("norm"), normalise_vat(c("raw")))
    staged = staged.withColumn(t("prefix"), vat_prefix(c("norm")))
    staged = staged.withColumns({
        t("country"): F.coalesce(c("prefix"), c("home")),
        t("body"): F.when(c("prefix").isNotNull(), vat_body(c("prefix"), c("norm"))).otherwise(c("norm")),
    })
    staged = staged.withColumn(t("ok"), F.coalesce(format_ok(c("country"), c("body")), F.lit(False)))
    staged = staged.withColumn(t("bad_check"), c("ok") & checksum_fails(c("country"), c("body")))
    has_prefix = c("prefix").isNotNull()
    status = (
        F.when(c("raw") == "", "missing")
        .when(~c("ok"), "invalid_format")
        .when(has_prefix & (c("home") != c("prefix")), "country_mismatch")
        .when(c("bad_check"), "checksum_failed")
        .when(~has_prefix, "missing_prefix")
        .otherwise("ok")
    )
    staged = staged.withColumn(t("status"), status)
    s = c("status")
    with_prefix = F.concat(c("country"), c("norm"))
    suggestion = F.when(~has_prefix & s.isin("missing_prefix", "checksum_failed"), with_prefix).when((s == "ok") & (c("raw") != c("norm")), c("norm"))
    message = (
        F.when(s == "missing", "VAT ID is missing.")
        .when((s == "invalid_format") & has_prefix, F.concat(F.lit("VAT ID does not match the "), c("prefix"), F.lit(" format.")))
        .when((s == "invalid_format") & c("home").isNotNull(), F.concat(F.lit("VAT ID does not match a recognised "), c("home"), F.lit(" format.")))
        .when(s == "invalid_format", "VAT ID does not match a recognised EU/GB format.")
        .when(s == "country_mismatch", F.concat(F.lit("VAT prefix "), c("prefix"), F.lit(" does not match address country "), c("home"), F.lit(".")))
        .when(s == "checksum_failed", F.concat(F.lit("VAT ID checksum failed for "), c("country"), F.lit(".")))
        .when(s == "missing_prefix", F.concat(F.lit("VAT ID is missing the "), c("country"), F.lit(" country prefix.")))
        .when(c("raw") != c("norm"), "VAT ID has extra spacing or punctuation.")
        .otherwise("VAT ID format looks valid.")
    )
    found = F.when(has_prefix | s.isin("missing_prefix", "checksum_failed"), c("country"))
    result = F.struct(s.alias("status"), c("norm").alias("normalized"), found.alias("vat_country"), message.alias("message"), suggestion.alias("suggestion"))
    helpers = [t(n) for n in ("raw", "home", "norm", "prefix", "country", "body", "ok", "bad_check", "status")]
    return staged.withColumn(out, result).drop(*helpers)


def split_vat(value: Column | str, country: Column | str) -> Column:
    """Country code and body for a registry request; null where neither can be told."""
    normal = normalise_vat(value)
    prefix = vat_prefix(normal)
    home = F.nullif(alias_country(country), F.lit(""))
    parts = lambda code, body: F.struct(code.alias("country_code"), body.alias("vat_number"))
    return F.when(prefix.isNotNull(), parts(prefix, vat_body(prefix, normal))).when((normal != "") & format_ok(home, normal), parts(home, normal))
