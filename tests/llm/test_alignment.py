"""Alignment and link counts against a direct reading of their definition."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import alignment
from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.token_counts import byte_letters

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "a", "  two  spaces ", "naïve café 日本語 한국어 \U0001f600", "<|endoftext|> <s> </s> <unk>", "tab\tand\nline\r\n", "ﬁne ½ ①", "x" * 400, "the cat sat on the mat", "the cat sat on the mat", "▁ ▁▁", "\x00\x01", "word " * 4000]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = byte_letters()
    docs = []
    for doc_id, text in rows:
        raw = b" " + (text or "").encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((doc_id, [], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = [sum(map(len, parts[:i + 1])) for i in range(len(parts))] if len(parts) < 3000 else list(__import__("itertools").accumulate(map(len, parts)))
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in both:
            groups.append([[i for i, (s, e) in zip(ids, sp, strict=True) if start <= s and e <= end] for ids, sp in ((ids_a, spans[0]), (ids_b, spans[1]))] if len(both) < 800 else None)
            start = end
        first, links = 0, []
        for i, (s, e) in zip(ids_a, spans[0], strict=True):
            while spans[1][first][1] <= s:
                first += 1
            k = first
            while k < len(ids_b) and spans[1][k][0] < e:
                links.append((i, ids_b[k]))
                k += 1
        docs.append((doc_id, ids_a, ids_b, groups, links))
    counts = Counter(p for d in docs for p in set(d[4]))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, ids_a, ids_b, groups, links in docs:
        sha = hashlib.sha256(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups).encode()).hexdigest() if ids_a and None not in groups else None if ids_a else ""
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return out


def same(got, want):
    got, want = (sorted(rows, key=lambda r: str(r[:7])) for rows in (got, want))
    assert [r[:7] for r in got] == [r[:7] for r in want]
    # the brute-force groups of long texts are left out
    checked = [(g[7], w[7]) for g, w in zip(got, want, strict=True) if w[7] is not None]
    assert all(g == w for g, w in checked) and len(checked) > 10


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same([tuple(r[n] for n in NAMES) for r in QUERIES["op13_cross_tokenizer_alignment"](spark, SF).collect()], brute(rows))


@pytest.mark.parametrize(("frequent", "pattern"), [(1, None), (40, public_tokenizers.PATTERN), (1 << 18, public_tokenizers.PATTERN)])
def test_odd_texts_and_thresholds(spark, frequent, pattern):
    """Null and repeated ids, equal texts, long texts, clashing columns; all pairs joined, some, none."""
    rows = [(i if i % 7 else None, t) for i, t in enumerate(ODD + ODD[5:12])] + [(3, "the cat")] * 3
    frame = spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], "doc_id bigint, text string, n_a int, _row int, pairs string, n int").repartition(3)
    same([tuple(r[n] for n in NAMES) for r in alignment.link_counts(frame, A, B, frequent_pairs=frequent, pattern=pattern).collect()], brute(rows))
    assert alignment.link_counts(frame.where("false"), A, B, frequent_pairs=frequent, pattern=pattern).collect() == []


def test_groups_are_spelled(spark):
    frame = spark.createDataFrame([(1, "naïve tokenization, unbelievable"), (2, None)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in alignment.align(frame, A, B).collect()}
    groups = [[side.split(",") for side in g.split("|")] for g in rows[1]["groups"].split(";")]
    assert sum(len(g[0]) for g in groups) == rows[1]["n_a"] and sum(len(g[1]) for g in groups) == rows[1]["n_b"] and len(groups) == rows[1]["n_groups"]
    assert hashlib.sha256(rows[1]["groups"].encode()).hexdigest() == rows[1]["groups_sha256"] and rows[2]["groups"] == rows[2]["groups_sha256"] == ""
    assert sum(rows[1]["times"]) == rows[1]["n_links"] and frame.where(F.col("doc_id") == 1).count() == 1


def test_ranks_give_the_ids_of_the_file():
    """The encoder by ranks against the file's own library: quotes, runs of blanks, signs, digits, young characters, long runs."""
    import random

    rnd, parts = random.Random(3), ["'", "''", "'s", "'ll", " ", "  ", "\n", "\t \n", "a", "Word", "é", "١2", "...", "$%", "\u00a0", "\u3000", "日本", "ࡠ", "\U0001f9ff", "_", "don't", "x'REx", "\u0301", "z" * 1200]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40))) for _ in range(3000)]
    with open(A, "rb") as f, open(B, "rb") as g:
        pair = alignment.Pair(f.read(), g.read(), public_tokenizers.PATTERN)
    assert pair.ranked is not None and alignment.Pair(open(A, "rb").read(), open(B, "rb").read()).ranked is None
    assert pair.encode_a(texts) == [e.ids for e in pair.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
