"""Greek and Cyrillic text in Latin letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import col

# Scripts that count as foreign, and what their letters become.
FOREIGN = r"[Ͱ-Ͽἀ-῿Ѐ-ӿԀ-ԯ]"
PAIRS = {
    "αι": "ai", "ει": "ei", "οι": "oi", "ου": "ou", "αυ": "av", "ευ": "ev", "ηυ": "iv", "μπ": "b", "ντ": "d", "γκ": "gk", "γγ": "ng", "γχ": "nch",
    "γξ": "nx", "τσ": "ts", "τζ": "tz",
}
LETTERS = {
    "α": "a", "ά": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "έ": "e", "ζ": "z", "η": "i", "ή": "i", "θ": "th", "ι": "i", "ί": "i", "ϊ": "i", "ΐ": "i",
    "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "ό": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "ύ": "y", "ϋ": "y",
    "ΰ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o", "ώ": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "", "ю": "yu", "я": "ya",
}


def has_non_latin(text: Column | str) -> Column:
    return col(text).rlike(FOREIGN)


def _cased() -> dict[str, str]:
    """Every spelling of the pairs and letters with its Latin form: small, with a capital first, all capitals."""
    out: dict[str, str] = {}
    for source, latin in PAIRS.items():
        out |= {source.upper(): latin.upper(), source[0].upper() + source[1]: latin.capitalize(), source[0] + source[1].upper(): latin, source: latin}
    for source, latin in LETTERS.items():
        if len(source.upper()) == 1 and source.upper() != source:
            out[source.upper()] = latin.capitalize()
        out[source] = latin
    return out


def transliterate(text: Column | str) -> Column:
    """Pairs before single letters, from left to right; other characters stay. Case is kept."""
    table = _cased()
    pieces = F.regexp_extract_all(col(text), F.lit("(?s)(" + "|".join(k for k in table if len(k) == 2) + "|.)"))
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(known[p], p)), "")
