"""Field extraction from document text: labels, money, dates, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .dates import MONTHS
from .money import col, strip, to_cents

# Patterns and lists the extractors look for.
MONEY_TOKEN = r"(?i)(\(?(?:[$£€]\s*)?-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,4})?\)?(?:\s*CR)?)"
DATE_TOKEN = r"(\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s*\/?\s*[A-Za-z]{3,9}\s*\/?\s*\d{2,4})"
CURRENCIES = ("AUD", "USD", "EUR", "GBP", "NZD", "CAD", "SGD", "JPY", "CHF", "HKD")
LABELLED_CURRENCY = r"(?i)(?:total\s*(?:\(|amount)?[^%\n]{0,24}|currency[:\s]+)\b(AUD|USD|EUR|GBP|NZD)\b"
CURRENCY_ORDER = ("USD", "AUD", "EUR", "GBP")
SYMBOLS = {"£": "GBP", "€": "EUR"}
VAT_NUMBER = r"(?i)\bVAT(?:\s+Number)?[:\s]*([A-Z]{1,3}\s?\d[A-Z0-9]{6,14})\b"
TAX_ID = r"(?i)\bABN[:\s]*([\d\s]{11,18})"
IBAN = r"\b([A-Z]{2}\d{2}[A-Z0-9]{10,30})\b"
BIC = r"(?i)\b(?:BIC|SWIFT)[:\s]*([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
BSB = r"(?i)\bBSB[:\s]*(\d{3}-?\d{3})\b"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, trimmed, or null."""
    return let(strip(F.regexp_extract(text, pattern, group)), lambda v: F.when(v != "", v))


def labelled(text: Column, labels: str, value: str) -> Column:
    return found(text, rf"(?i)(?:{labels})[:\s]+({value})")


def normalise_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(c), " ", " "), r"\s+", " "))


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+", "")


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\D", "")


def lines_of(text: Column | str) -> Column:
    """Non-empty lines with white space normalised."""
    return F.filter(F.transform(F.split(F.regexp_replace(col(text), r"\r", ""), "\n"), normalise_space), lambda x: x != "")


def parse_money(c: Column | str) -> Column:
    """Money text to cents; ``CR`` or parentheses make it negative, other text is null."""

    def cents(raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"[A-Za-z$£€,\s()]", "")
        value = let(bare, lambda b: to_cents(F.when(b.rlike(r"^-?\d+(\.\d{1,4})?$"), b.try_cast("double"))))
        return let(value, lambda v: F.when(v.isNotNull() & (raw.rlike(r"(?i)\bCR\b") | raw.rlike(r"^\(.*\)$")), -F.abs(v)).otherwise(v))

    return let(strip(c), cents)


def money_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(MONEY_TOKEN))


def last_money(c: Column | str) -> Column:
    return parse_money(F.try_element_at(money_tokens(c), F.lit(-1)))


def first_money(c: Column | str) -> Column:
    return parse_money(F.try_element_at(money_tokens(c), F.lit(1)))


def detect_currency(text: Column | str) -> Column:
    """Labelled code, then a code in the order of likelihood, then any code, then a symbol."""
    t = col(text)
    out = F.upper(found(t, LABELLED_CURRENCY))
    candidates = [F.when(t.rlike(rf"(?i)\b{code}\b"), code) for code in CURRENCY_ORDER]
    candidates.append(F.upper(found(t, rf"(?i)\b({'|'.join(CURRENCIES)})\b")))
    candidates += [F.when(t.contains(sign), code) for sign, code in SYMBOLS.items()]
    return F.coalesce(out, *candidates, F.when(t.contains("$"), "AUD"))


def currency_from_symbol(text: Column | str) -> Column:
    """Currency of the first known sign, the dollar before the others; null without one."""
    t = col(text)
    return F.coalesce(F.when(t.contains("$"), "AUD"), *(F.when(t.contains(sign), code) for sign, code in SYMBOLS.items()))


def document_date(c: Column | str) -> Column:
    """Four date layouts with a two-digit-year pivot at 70 and a range check."""

    def from_parts(y: Column, m: Column, d: Column, named: bool) -> Column:
        month = full_month(m) if named else F.lpad(m, 2, "0")
        century = F.when(y.try_cast("int") >= 70, "19").otherwise("20")
        year = F.when(F.length(y) == 4, y).when(F.length(y) == 3, F.concat(century, y)).otherwise(F.concat(century, F.lpad(y, 2, "0")))
        text = let(month, lambda mm: F.when(mm.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31), F.concat_ws("-", year, mm, F.lpad(d, 2, "0"))))
        return text

    def layout(raw: Column, pattern: str, y: int, m: int, d: int, named: bool) -> Column:
        parts = F.array(*(F.regexp_extract(raw, pattern, i) for i in (y, m, d)))
        return F.when(raw.rlike(pattern), let(parts, lambda p: from_parts(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2)), named)))

    def any_layout(raw: Column) -> Column:
        return F.when(raw.rlike(r"\d"), F.coalesce(
            layout(raw, r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", 1, 2, 3, False),
            layout(raw, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$", 3, 2, 1, False),
            layout(raw, r"^(\d{1,2})\s*/?\s*([A-Za-z]{3,9})\s*/?\s*(\d{2,4})$", 3, 2, 1, True),
            layout(raw, r"^([A-Za-z]{3,9})\s+(\d{1,2})\s+(\d{2,4})$", 3, 1, 2, True),
        ))

    return let(strip(F.regexp_replace(col(c), r"[.,\s]+", " ")), any_layout)


# Month names written out.
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def full_month(name: Column) -> Column:
    """Number of a month written short or in full; other words are no month."""
    numbers = {m: f"{i:02d}" for names in (MONTHS, FULL_MONTHS) for i, m in enumerate(names, 1)} | {"sept": "09"}
    return F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))[F.lower(name)]


def first_date(c: Column | str) -> Column:
    return document_date(found(col(c), DATE_TOKEN))


def vat_number(text: Column | str) -> Column:
    return F.upper(squeeze(found(col(text), VAT_NUMBER)))


def tax_id(text: Column | str) -> Column:
    """Eleven digits; a longer run of digits is no tax id."""
    return let(digits_only(found(col(text), TAX_ID)), lambda d: F.when(F.length(d) == 11, d))


def iban(text: Column | str) -> Column:
    return let(found(squeeze(F.upper(col(text))), IBAN), lambda v: F.when(F.length(v).between(15, 34), F.regexp_replace(v, r"(BIC|SWIFT)$", "")))


def bic(text: Column | str) -> Column:
    return F.upper(found(col(text), BIC))


def value_after_label(lines: Column, label: str, value: str, window: int = 3) -> Column:
    """Value on the line of a label, else on one of the next lines; first label that yields one.

    Only the first label of a line is cut out before the line is searched.
    """
    pattern, label_re = rf"(?i)({value})", rf"(?i){label}"
    first_label = rf"(?is)^(.*?)(?:{label})"

    def near(line: Column, i: Column) -> Column:
        here = found(F.regexp_replace(line, first_label, "$1 "), pattern)
        following = F.transform(F.slice(lines, i + 2, F.lit(window)), lambda nxt: found(nxt, pattern))
        return F.when(line.rlike(label_re), F.coalesce(here, F.get(F.array_compact(following), F.lit(0))))

    return F.get(F.array_compact(F.transform(lines, near)), F.lit(0))


def grounded(value: Column | str, text: Column | str) -> Column:
    """The value appears in the text: as it stands, or without blanks and hyphens if four characters are left."""
    v, t = F.lower(strip(col(value))), F.lower(F.regexp_replace(col(text), r"\s+", " "))
    bare = F.regexp_replace(v, r"[\s-]", "")
    return (F.length(v) >= 2) & (t.contains(v) | ((F.length(bare) >= 4) & F.regexp_replace(t, r"[\s-]", "").contains(bare)))


def money_cents(text: Column | str) -> Column:
    """All amounts a text holds, in cents."""
    return F.array_compact(F.transform(money_tokens(text), parse_money))


def align_amount(cents: Column, tokens: Column) -> Column:
    """An amount that the text holds only a hundredfold was given in major units."""
    return F.when(~F.array_contains(tokens, cents) & (F.abs(cents) <= 90071992547409) & F.array_contains(tokens, cents * 100), cents * 100).otherwise(cents)


def pick_currency(known: Column, offered: Column, text: Column | str) -> Column:
    """The known currency, unless there is none, the text labels the offered one, or the dollar sign was only taken for AUD."""
    has, offer = F.upper(known), F.upper(offered)
    labelled_code, usable = F.upper(detect_currency(text)), offer.isin(*CURRENCIES)
    named = F.expr("true")
    for code in CURRENCIES:
        named = named & ((offer != code) | col(text).rlike(rf"(?i)\b{code}\b"))
    better = F.coalesce((offer == labelled_code) & (has != labelled_code), F.lit(False)) | ((has == "AUD") & (offer != "AUD") & named & ~col(text).rlike(r"(?i)\bAUD\b"))
    return F.when(usable & (has.isNull() | better), offer).otherwise(has)


# Bounds of an overview written by a model.
SYNOPSIS_LEAST, SYNOPSIS_MOST = 12, 4000


def synopsis(value: Column | str, source: Column | str) -> Column:
    """A short overview in own words: blanks collapsed, clipped at a word, null if too short or if it is the source pasted back."""
    one = strip(F.regexp_replace(col(value), r"\s+", " "))

    def kept(text: Column) -> Column:
        src, syn = F.lower(strip(F.regexp_replace(F.coalesce(col(source), F.lit("")), r"\s+", " "))), F.lower(text)
        long_copy = (F.length(src) >= 40) & (F.length(syn) >= F.floor(F.length(src) * 0.75)) & (src.contains(syn) | syn.contains(F.substring(src, 1, 80)))
        dump = (src != "") & ((syn == src) | ((F.length(syn) >= 160) & src.contains(syn)) | long_copy)
        return F.when((F.length(text) >= SYNOPSIS_LEAST) & ~dump, text)

    clipped = lambda t: F.when(F.length(t) > SYNOPSIS_MOST, strip(F.regexp_replace(F.substring(t, 1, SYNOPSIS_MOST), r"\s+\S*$", ""))).otherwise(t)
    return let(one, lambda t: F.when(F.length(t) >= SYNOPSIS_LEAST, let(clipped(t), kept)))
