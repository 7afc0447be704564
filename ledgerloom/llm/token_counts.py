"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is merged on its own; those that come out as one token form the proven set. A pre-token
in the set counts one without any merging. Only the rest is merged, by the vocabulary's own merge list, and remembered
in a bounded memo.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe_merges import Memo, merge_piece
from .rows import map_texts


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: visible Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: Pieces up to so many bytes are scanned for their lowest pair; longer ones go through a heap. Both give the same tokens.
SCANNED = 48
#: Stands for "no such merge", above every rank.
NEVER = 1 << 62


class CountModel:
    """What tasks need of a byte-level BPE file: merges, proven whole tokens, special strings. Its size is the vocabulary's."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("token counts need a byte-level BPE file without a normaliser")
        if spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("token counts need the byte-level splitting pattern without an added space")
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        # the same by number: a byte is its value, the result of a merge 256 + the first merge that makes it
        number = {bytes((b,)): b for b in range(256)}
        for (a, b), i in self.ranks.items():
            number.setdefault(a + b, 256 + i)
        self.by_number = {number[a] << 32 | number[b]: i for (a, b), i in self.ranks.items()}
        self.makes = [number[a + b] for a, b in self.ranks]
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special strings that take in their surroundings are not supported")
        known = {t["content"] for t in spec["added_tokens"]}
        self.whole = frozenset(b for v in model["vocab"] if v not in known and self.parts(b := as_bytes(v)) == 1)

    def parts(self, piece: bytes) -> int:
        """How many tokens the merges leave of a piece."""
        if len(piece) > SCANNED:
            return len(merge_piece(piece, lambda a, b: self.ranks.get((a, b))))
        rank_of, makes, tokens = self.by_number.get, self.makes, list(piece)
        ranks = [rank_of(a << 32 | b, NEVER) for a, b in zip(tokens, tokens[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            made = makes[best]
            tokens[i : i + 2] = (made,)
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(tokens[i - 1] << 32 | made, NEVER)
            if i < len(ranks):
                ranks[i] = rank_of(made << 32 | tokens[i + 1], NEVER)
        return len(tokens)


#: Compiled models of this worker by file text.
_MODELS: dict[str, tuple] = {}


def late_characters():
    """A search for characters that Unicode 3.2 did not know: on those, splitting libraries of different age disagree."""
    import regex

    old = unicodedata.ucd_3_2_0
    spans: list[list[int]] = []
    for cp in range(0x250, sys.maxunicode + 1):
        if old.category(chr(cp)) == "Cn":
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
    late = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")
    beyond = regex.compile("[^\\u0000-\\u024f]")
    return lambda text: not text.isascii() and beyond.search(text) is not None and late.search(text) is not None


def counter(model: CountModel, pattern: str):
    """text -> number of tokens."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    whole = model.whole
    counts = Memo(lambda piece: 1 if (b := piece.encode()) in whole else model.parts(b), 200_000)
    lettered = Memo(lambda piece: 1 if (b := bytes(letters[c] for c in piece)) in whole else model.parts(b))
    split, letters, is_late = regex.compile(pattern).findall, byte_letters(), late_characters()
    library = ByteLevel(add_prefix_space=False, use_regex=True)
    special = regex.compile("|".join(map(regex.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None

    def of(text: str) -> int:
        if special is not None and (found := len(special.findall(text))):
            return found + sum(map(of_plain, special.split(text)))
        return of_plain(text)

    def of_plain(text: str) -> int:
        if is_late(text):
            return sum(lettered[piece] for piece, _ in library.pre_tokenize_str(text))
        return sum(map(counts.__getitem__, split(text)))

    return of


def count_tokens(
    df: DataFrame, vocabulary: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text.

    `vocabulary` is the path of a byte-level BPE .json file, read once on the driver; `pattern` its splitting pattern.
    Special strings inside a text count as one token each, none are added. Null and empty texts: 0, 0, false. Ids may be
    null or repeat; each row is counted. Other columns are not read. An empty table gives an empty result.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(CountModel(f.read()))  # size: the vocabulary's, some MB

    def work():
        key = (vocabulary, pattern)
        if key not in _MODELS:
            _MODELS[key] = counter(shared.value, pattern)
        of = _MODELS[key]

        def counted(texts: list[str]) -> list[pa.Array]:
            n = [of(t) for t in texts]
            return [
                pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([x > limit for x in n], pa.bool_()),
            ]

        return counted

    return map_texts(df, [id_col], text_col, "n_bytes bigint, n_tokens bigint, over_limit boolean", work)
