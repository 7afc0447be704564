"""Party names: normal form, loose comparison and blocking keys for joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let
from .money import col

# Legal-form words dropped from names, and words too common to tell parties apart.
LEGAL_WORDS = r"\b(LTD|LIMITED|PLC|LLC|NHS|TRUST|UHB|ULHB|LHB|FT|FOUNDATION|HOSPITALS?|UNIVERSITY|THE|AND)\b"
GENERIC_WORDS = (
    "HEALTH", "CARE", "GROUP", "BOARD", "BANK", "GBS", "NATWEST", "PAYMENT", "TRANSFER", "RECEIPT",
    "INVOICE", "REMI", "SREF", "DBACCT", "NONREF", "ADVICE", "CONFIRMS", "BACS", "CHAPS", "FASTER",
    "PAYROLL", "WAGES", "HMRC", "VAT", "CASH", "CHECK", "CHEQUE", "DIRECT", "DEBIT", "CREDIT",
    "CENTRE", "CENTER", "AUTHORITY", "AUTH", "UNI", "FOUND", "HEALTHCARE", "SERVICES", "SERVICE", "T", "A",
)
PREFIX_LEN = 6


def normalise_party(c: Column | str) -> Column:
    v = F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9]+", " ")
    return F.trim(F.regexp_replace(v, " ?" + LEGAL_WORDS, ""))  # a word goes with the one blank before it


def distinctive_words(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC_WORDS))


def _short_single(word: Column, other: Column) -> Column:
    one_word = F.length(word).between(4, 5) & ~word.contains(" ")
    return one_word & F.array_contains(F.split(other, " "), word)


def loosely_match(na: Column, nb: Column, words_b: Column | None = None) -> Column:
    """Loose comparison of two *normalised* names.

    True for containment of names of six or more characters, for a short name
    standing as a whole word in the other, or when enough distinctive words agree
    (equal, or one a prefix of the other with at least six characters shared).
    """
    contained = (F.length(na) >= 6) & (F.length(nb) >= 6) & (na.contains(nb) | nb.contains(na))

    def agrees(w: Column, h: Column) -> Column:
        shares_prefix = (F.least(F.length(w), F.length(h)) >= PREFIX_LEN) & (h.startswith(w) | w.startswith(h))
        return (w == h) | shares_prefix

    def sides(p: Column) -> Column:
        pair = lambda few, many: F.struct(few.alias("fewer"), many.alias("more"))
        return F.when(F.size(p["a"]) <= F.size(p["b"]), pair(p["a"], p["b"])).otherwise(pair(p["b"], p["a"]))

    def enough(p: Column) -> Column:
        hits = F.filter(p["fewer"], lambda w: F.exists(p["more"], lambda h: agrees(w, h)))
        # A single distinctive word needs eight characters, which the first test already covers.
        return let(hits, lambda v: F.exists(v, lambda w: F.length(w) >= 8) | ((F.size(p["fewer"]) >= 2) & (F.size(v) >= 2)))

    # Words are split once for all comparisons: inside a lambda nothing is shared by itself.
    words = F.struct(distinctive_words(na).alias("a"), (distinctive_words(nb) if words_b is None else words_b).alias("b"))
    overlap = let(let(words, sides), enough)
    given = (na != "") & (nb != "")
    return given & (contained | _short_single(na, nb) | _short_single(nb, na) | overlap)


def names_loosely_match(a: Column | str, b: Column | str) -> Column:
    return loosely_match(normalise_party(a), normalise_party(b))


def _grams(text: Column) -> Column:
    n = F.length(text) - (PREFIX_LEN - 1)
    starts = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(PREFIX_LEN))))


# Every generic word between blanks; two blanks in a row never stand in a normalised name.
_GENERIC_TEXT = " " + "  ".join(GENERIC_WORDS) + " "


def _telling_gram(text: Column) -> Column:
    """One gram that stands for the whole name: if possible none that lies in a generic word."""
    ranked = F.transform(_grams(text), lambda g: F.struct(F.contains(F.lit(_GENERIC_TEXT), g).alias("generic"), F.xxhash64(g).alias("at"), g.alias("gram")))
    best = F.array_min(ranked)["gram"]
    return F.when(best.isNotNull(), F.array(best)).otherwise(F.array().cast("array<string>"))


def _tagged(keys: Column, tag: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def block_keys(normal: Column, name_side: bool) -> Column:
    """Keys such that any two names that loosely match share at least one.

    Distinctive words cover equal words and shared prefixes. A name that is one short word, generic or not, meets the
    names that hold that word. For containment the inner name gives one telling gram and the outer one all its grams.
    Generic words alone bring no two names together.
    """
    words = F.split(normal, " ")
    short = F.filter(words, lambda w: F.length(w).between(4, 5))
    alone = F.when(F.length(normal).between(4, 5) & ~normal.contains(" "), F.array(normal)).otherwise(F.array().cast("array<string>"))
    own, other = ("n", "t") if name_side else ("t", "n")
    return F.array_distinct(F.concat(
        F.transform(distinctive_words(normal), lambda w: F.concat(F.lit("w:"), F.substring(w, 1, PREFIX_LEN))),
        _tagged(alone, f"{own}s:"), _tagged(short, f"{other}s:"), _tagged(_telling_gram(normal), f"{own}g:"), _tagged(_grams(normal), f"{other}g:"),
    ))
