"""Canonical payment terms, pay groups, methods and supplier types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col, text_or_empty

# Known spellings and what they stand for.
TERMS = {
    "30 days": "30 Days", "30jours": "30 Days", "30 jours": "30 Days", "30 jours fm": "30 Days EOM", "30 tn": "30 Days",
    "net 30": "30 Days", "60 days": "60 Days", "45 days": "45 Days", "90 days": "90 Days", "25 days": "25 Days",
    "sofort": "Immediate", "prompt": "Immediate", "immediate": "Immediate", "due on receipt": "Immediate",
}
METHODS = {"check": "CHECK", "cheque": "CHECK", "eft": "EFT", "wire": "WIRE", "bacs": "BACS", "sepa": "SEPA"}
TYPES = {
    "corporation": "CORPORATION", "foreign corporation": "FOREIGN CORPORATION", "individual": "INDIVIDUAL",
    "partnership": "PARTNERSHIP", "government": "GOVERNMENT",
}
STANDARD_TERMS = ("7 Days", "14 Days", "30 Days", "45 Days")
UPPER_WORDS = ("EUR", "GBP", "USD", "AUD", "GB", "EFT", "BACS")
RARE_BELOW = 3
RARE_POPULATION = 8


def _lookup(value: Column, table: dict[str, str], compact_too: bool) -> Column:
    spaced = F.regexp_replace(F.lower(value), r"\s+", " ")
    squeezed = F.regexp_replace(F.lower(value), r"[\s._-]+", "")

    def find(key: Column) -> Column:
        chain = F.lit(None).cast("string")
        for k, v in table.items():
            chain = F.when(key == k, v).otherwise(chain)
        return chain

    return F.coalesce(find(spaced), find(squeezed)) if compact_too else find(spaced)


def canonical_terms(c: Column | str) -> Column:
    return _lookup(text_or_empty(c), TERMS, True)


def canonical_method(c: Column | str) -> Column:
    return _lookup(text_or_empty(c), METHODS, True)


def canonical_type(c: Column | str) -> Column:
    return _lookup(text_or_empty(c), TYPES, False)


def canonical_pay_group(c: Column | str) -> Column:
    """Each word with a capital first letter, except the known abbreviations."""
    words = F.split(text_or_empty(c), r"\s+")
    shaped = F.transform(words, lambda w: F.when(F.upper(w).isin(*UPPER_WORDS), F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    return F.nullif(F.array_join(shaped, " "), F.lit(""))


def is_standard_terms(c: Column | str) -> Column:
    return text_or_empty(c).isin(*STANDARD_TERMS)


def is_rare(count: Column | str, population: Column | str) -> Column:
    return (col(population) >= RARE_POPULATION) & (col(count) < RARE_BELOW)


def rationalise_hits(terms, group, method, kind, term_count, group_count, population) -> Column:
    """Values that could be standardised or merged, as an array of structs."""
    q = lambda label, v: F.concat(F.lit(f'{label} "'), v, F.lit('"'))

    def hit(test: Column, field: str, value: Column, suggestion: Column | None, reason: Column) -> Column:
        hint = F.lit(None).cast("string") if suggestion is None else suggestion
        return F.when(test, F.struct(F.lit(field).alias("field"), value.alias("value"), hint.alias("suggestion"), reason.alias("reason")))

    def standard(label: str, v: Column, canon: Column) -> Column:
        return F.concat(q(label, v), F.lit(' can be standardised to "'), canon, F.lit('".'))

    t, g, m, k = (text_or_empty(x) for x in (terms, group, method, kind))
    ct, cg, cm, ck = canonical_terms(t), canonical_pay_group(g), canonical_method(m), canonical_type(k)
    other = lambda v, canon: (v != "") & canon.isNotNull() & (canon != v)
    plain_t, plain_g = (t != "") & ~F.coalesce(other(t, ct), F.lit(False)), (g != "") & ~F.coalesce(other(g, cg), F.lit(False))
    return F.array_compact(F.array(
        F.coalesce(
            hit(other(t, ct), "paymentTerms", t, ct, standard("Payment terms", t, ct)),
            hit(plain_t & is_rare(term_count, population), "paymentTerms", t, None,
                F.concat(q("Payment terms", t), F.lit(f" is used on fewer than {RARE_BELOW} sites — review for rationalisation."))),
        ),
        F.coalesce(
            hit(other(g, cg), "payGroup", g, cg, standard("Pay group", g, cg)),
            hit(plain_g & is_rare(group_count, population), "payGroup", g, None,
                F.concat(q("Pay group", g), F.lit(" is rare — review whether it should merge into a standard group."))),
        ),
        hit(other(m, cm), "paymentMethod", m, cm, standard("Payment method", m, cm)),
        F.coalesce(
            hit(other(k, ck), "type", k, ck, standard("Supplier type", k, ck)),
            hit((k != "") & ck.isNull(), "type", k, None, F.concat(q("Supplier type", k), F.lit(" is not in the canonical set."))),
        ),
    ))
