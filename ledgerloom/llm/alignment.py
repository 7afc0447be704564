"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often ids meet in a corpus.

Per text both id lists become dictionaries from the byte offset where a token ends to its index. The intersection of the two key sets
are the offsets where both end; sorted, they slice both lists into groups; inside a slice every pair of overlapping tokens is a link.
Counts of id pairs are sums over documents. To bring them back to the documents no document is sent to a pair: pairs above a threshold
that at most FREQUENT pairs can reach go to every task, the others, each in few documents, are joined.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .rows import CHUNK, map_texts, type_of
from .token_counts import byte_letters, late_characters

#: Most id pairs that are sent to every task, as numbers.
FREQUENT = 1 << 18
#: A text with so long a run without blanks, or of blanks, goes to the file's own library.
RUN = 1000


def ranked(byte_level_json: bytes, pattern: str | None):
    """An encoder by ranks with the vocabulary of a byte-level file; None if the file says more than ranks can."""
    import tiktoken

    spec, letters = json.loads(byte_level_json), byte_letters()
    vocabulary, splitter = spec["model"].get("vocab", {}), spec.get("pre_tokenizer") or {}
    plain = spec["model"].get("type") == "BPE" and not spec.get("normalizer") and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    if pattern is None or not plain:
        return None
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word not in added}
    if any(x >= y for x, y in zip(made, made[1:])) or len(ranks) != 256 + len(made) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """The two tokenizers with the bytes of every id; the files come as bytes.

    With the splitting pattern of the byte-level file, and if its merges stand in the order of their ids, they are ranks and a faster library
    applies them; texts with characters on which splitting libraries may disagree, or with very long runs, are left to the file's own one.
    """

    def __init__(self, byte_level_json: bytes, piece_model: bytes, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(byte_level_json)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.ranked, self.is_late, self.blanks = ranked(byte_level_json, pattern), late_characters(), re.compile(rf"\s{{{RUN}}}").search
        letters = byte_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        words = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w in words]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.width = self.b.get_piece_size()
        self.bytes_b = []
        for i in range(self.width):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.length_a, self.length_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = [str(i) for i in range(size)], [str(i) for i in range(self.width)]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of ` ` + text by the byte-level tokenizer."""
        spaced = [" " + t for t in texts]
        whole = [self.ranked is None or self.is_late(t) or max(map(len, t.split()), default=0) >= RUN or self.blanks(t) is not None for t in spaced]
        rest = iter(self.a.encode_batch_fast([t for t, w in zip(spaced, whole, strict=True) if w], add_special_tokens=False))
        return [next(rest).ids if w else self.ranked.encode_ordinary(t) for t, w in zip(spaced, whole, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        return list(zip(self.encode_a(texts), self.b.encode(texts, num_threads=1), strict=True))

    def fits(self, text: str, ids_a: list[int], ids_b: list[int]) -> bool:
        raw = b" " + text.encode()
        spelled_a = self.ranked is not None or b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw  # ranks spell every text
        return bool(text) and spelled_a and b"".join(map(self.bytes_b.__getitem__, ids_b)) == raw

    def align(self, ids_a: list[int], ids_b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of from, to in A and from, to in B for each group, A and B ids of the links); both lists spell the same bytes."""
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = self.length_a[a].cumsum().tolist(), self.length_b[b].cumsum().tolist()
        # of tokens without bytes the last one keeps the offset
        at_a, at_b = dict(zip(ends_a, range(1, len(a) + 1))), dict(zip(ends_b, range(1, len(b) + 1)))
        shared = sorted(at_a.keys() & at_b.keys())
        to_a, to_b = (np.fromiter(map(at.__getitem__, shared), np.int64, len(shared)) for at in (at_a, at_b))
        from_a, from_b = np.r_[0, to_a[:-1]], np.r_[0, to_b[:-1]]
        alone = (to_a - from_a == 1) & (to_b - from_b == 1)
        groups, left, right = np.stack([from_a, to_a, from_b, to_b]), [], []
        for i, j, k, m in groups[:, ~alone].T.tolist():
            if j - i == 1 or m - k == 1:
                left += ids_a[i:j] * (m - k)
                right += ids_b[k:m] * (j - i)
                continue
            while i < j and k < m:  # no inner end is shared, so the ranges interlock: on from the token that ends first
                left.append(ids_a[i])
                right.append(ids_b[k])
                if ends_a[i] < ends_b[k]:
                    i += 1
                else:
                    k += 1
        return groups, np.concatenate([a[from_a[alone]], np.array(left, np.int64)]), np.concatenate([b[from_b[alone]], np.array(right, np.int64)])

    def spelled(self, ids_a: list[int], ids_b: list[int], groups: np.ndarray) -> str:
        """Groups as `a1,a2|b1;a3|b2,b3`."""
        a, b = list(map(self.text_a.__getitem__, ids_a)), list(map(self.text_b.__getitem__, ids_b))
        out = [f"{a[i]}|{b[k]}" for i, k in zip(groups[0].tolist(), groups[2].tolist(), strict=True)]
        longer = (groups[1] - groups[0] > 1) | (groups[3] - groups[2] > 1)
        for at, (i, j, k, m) in zip(np.flatnonzero(longer).tolist(), groups[:, longer].T.tolist(), strict=True):
            out[at] = f"{','.join(a[i:j])}|{','.join(b[k:m])}"
        return ";".join(out)


@functools.lru_cache(maxsize=2)
def _pair(byte_level_json: bytes, piece_model: bytes, pattern: str | None) -> Pair:
    return Pair(byte_level_json, piece_model, pattern)


def _shared_pair(df: DataFrame, byte_level_path: str, piece_path: str, pattern: str | None):
    with open(byte_level_path, "rb") as f, open(piece_path, "rb") as g:
        return df.sparkSession.sparkContext.broadcast((f.read(), g.read(), pattern))  # two vocabulary files


def align(
    df: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", spell: bool = True, pattern: str | None = None,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, groups, pairs, times) of every whole text.

    `groups` is the alignment as text (null unless `spell`), `pairs` the different linked id pairs as a * (size of B) + b in ascending
    order, `times` how many links each has. A text that is null, empty or not spelled by both tokenizers has no tokens: zeros, '' and empty
    lists. `pattern` is the splitting pattern of the byte-level file, if it is known. Ids may be null or repeat; other columns are not read; an empty table gives an empty result.
    """
    shared = _shared_pair(df, byte_level_path, piece_path, pattern)

    def work():
        pair = _pair(*shared.value)

        def aligned(texts: list[str]) -> list[pa.Array]:
            gc.disable()  # only lists of numbers are made, which hold no cycles
            try:
                return columns(texts)
            finally:
                gc.enable()

        def columns(texts: list[str]) -> list[pa.Array]:
            rows = []
            for text, (ids_a, ids_b) in zip(texts, pair.encode(texts), strict=True):
                if not pair.fits(text, ids_a, ids_b):
                    rows.append((0, 0, 0, 0, "", "", [], []))
                    continue
                groups, link_a, link_b = pair.align(ids_a, ids_b)
                spelled = pair.spelled(ids_a, ids_b, groups)
                pairs, times = np.unique(link_a * pair.width + link_b, return_counts=True)
                rows.append((len(ids_a), len(ids_b), groups.shape[1], len(link_a), hashlib.sha256(spelled.encode()).hexdigest(), spelled if spell else None, pairs, times.astype(np.int32)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
            return [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]

        return aligned

    schema = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<int>"
    return map_texts(df, [id_col], text_col, schema, work)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether no pair of its A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy(F.expr(f"pair div {size_b}").alias("_a")).agg(F.max("n").alias("_most"))  # at most A's vocabulary
    counts = counts.withColumn("_a", F.expr(f"pair div {size_b}"))
    return counts.join(F.broadcast(most), "_a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def _frequent_sums(rows: DataFrame, key_cols: list[str], frequent) -> DataFrame:
    """The key columns with the sums over frequent pairs, and the other pairs with their times."""

    def run(batches):
        pairs, counts, best = frequent.value
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                lists, times = part.column(len(key_cols)), part.column(len(key_cols) + 1)
                flat, each = lists.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
                hit = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
                sums = np.zeros(len(part), np.int64)
                wins = np.zeros(len(part), np.int64)
                if len(pairs):
                    np.add.at(sums, row[hit], each[hit] * counts[at[hit]])
                    np.add.at(wins, row[hit], each[hit] * best[at[hit]])
                left = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(part)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(i) for i in range(len(key_cols))), pa.array(wins), pa.array(sums),
                    pa.ListArray.from_arrays(pa.array(left), pa.array(flat[~hit])), pa.ListArray.from_arrays(pa.array(left), pa.array(each[~hit])),
                ], names=[*key_cols, "n_best", "count_sum", "rare", "rare_times"])

    schema = ", ".join([f"`{c}` {type_of(rows, c)}" for c in key_cols] + ["n_best bigint, count_sum bigint, rare array<bigint>, rare_times array<bigint>"])
    return rows.select(*key_cols, "pairs", "times").mapInArrow(run, schema)


def link_counts(
    df: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", frequent_pairs: int = FREQUENT, pattern: str | None = None,
) -> DataFrame:
    """`align` with n_best (links whose pair no other pair of the A id exceeds) and count_sum (documents of the pair, over links).

    Alignments are written once to the shared folder, with a number for each row, so that ids may be null or repeat. A pair that more
    than (all pairs of all documents) / `frequent_pairs` documents hold is frequent: there are at most `frequent_pairs` of them, at any
    size. No other pair can make a hot key of the join.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/alignment-{uuid.uuid4().hex}"
    size_b = _pair(*_shared_pair(df, byte_level_path, piece_path, pattern).value).width
    plain = align(df, byte_level_path, piece_path, id_col, text_col, spell=False, pattern=pattern).drop("groups")
    plain.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    pair_counts(rows, size_b).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    bar = (counts.agg(F.sum("n")).first()[0] or 0) // max(frequent_pairs, 1)
    top = counts.where(F.col("n") > bar).orderBy("pair").toArrow()  # at most `frequent_pairs` rows
    frequent = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    summed = _frequent_sums(rows, ["_row"], frequent)
    rare = summed.select("_row", F.explode(F.arrays_zip("rare", "rare_times")).alias("_r")).select("_row", F.col("_r.rare").alias("pair"), F.col("_r.rare_times").alias("_t"))
    met = rare.join(counts.where(F.col("n") <= bar), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("_t")).otherwise(0)).alias("_wins"), F.sum(F.col("_t") * F.col("n")).alias("_sum"),
    )
    kept = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    both = summed.select("_row", "n_best", "count_sum").unionByName(met.select("_row", F.col("_wins").alias("n_best"), F.col("_sum").alias("count_sum")))
    totals = both.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select("_row", *kept).join(totals, "_row").select(*kept, "n_best", "count_sum")
