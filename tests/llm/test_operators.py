"""The other operators against brute force, libraries, round trips and held-out rows."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe_transducer, exact_dedup, language_id, packing, pii, quality_model, quality_rules, token_counts
from ledgerloom.llm.bpe_merges import merge_piece, rank_table
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Columns that outputs also use, so clashing names are always there.
SCHEMA = "doc_id bigint, text string, source string, lang string, score double, kept boolean, n_tokens string, shard int, digest string"
ODD = [
    None, "", " ", "\n\n", "a", "Don't stop, we'll go.  <|endoftext|> x<|endoftext|>", "é" * 40, "日本語のテキスト 한국어 \U0001f600‍", "x" * 3000,
    " " * 500, "word " * 3000, "՘ ࡟ 1١ \x1c\x85\xa0 end", "A\r\nB\tC\x0bD\x0cE",
]


def frame(spark, texts, parts=3):
    rows = [(i, t, f"s{i % 3}", "en", 0.5, True, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def texts(spark):
    return ODD + ODD[:6] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]


def multi_ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return rank_table(f)


def test_bpe_round_trip(spark, texts):
    ranks = multi_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = frame(spark, texts)
    got = {r["doc_id"]: r for r in bpe_transducer.round_trip(df, path, public_tokenizers.PATTERN).collect()}
    encoded = bpe_transducer.encode(df, path, public_tokenizers.PATTERN)
    ids = {r["doc_id"]: r["token_ids"] for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe_transducer.decode(encoded, path, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode_ordinary(text or "")
        assert ids[i] == want and got[i]["n_tokens"] == len(want) and back[i] == (text or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_transducer.round_trip(df.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_transducer_with_small_tables():
    ranks, rnd = multi_ranks(), random.Random(1)
    machine = bpe_transducer.Transducer(ranks, most_states=20, most_known=20)
    tokens = list(ranks)
    for _ in range(300):
        piece = "".join(rnd.choice("ethansio") for _ in range(rnd.randrange(1, 60))).encode()
        merged = b"".join(ranks[p].to_bytes(4, "little") for p in merge_piece(piece, lambda a, b: ranks.get(a + b)))
        assert machine.encode(piece) == merged
        left, right = rnd.choice(tokens[:4000]), rnd.choice(tokens[:4000])
        assert machine.neighbours.apart(left, right) == (merge_piece(left + right, lambda a, b: ranks.get(a + b)) == [left, right])


def test_stream_decoder_replaces_like_python():
    rnd = random.Random(2)
    decoder = bpe_transducer.StreamDecoder({i: bytes([i]) for i in range(256)})
    for _ in range(2000):
        data = bytes(rnd.choice([65, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(8))
        assert "".join(decoder.feed([b]) for b in data) + decoder.finish() == data.decode(errors="replace")


def test_token_counts(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512)
    model = token_counts.CountModel(open(path, encoding="utf-8").read())
    for piece in ("thhanting", "unwhatever", "x" * 47, "ab" * 40, "é" * 30):
        assert model.parts(piece.encode()) == len(merge_piece(piece.encode(), lambda a, b: model.ranks.get((a, b))))


def repeated(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def test_quality_rules(spark, texts):
    made = [*texts[:80], "a b c d e " * 5, "one two three four five six seven eight nine ten " * 2, "x\nx\ny", "GO NOW " * 9, "no no no no no no no no no no yes"]
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = frame(spark, made)
    got = {r["doc_id"]: r for r in quality_rules.judge(df, measures=base).collect()}
    for i, text in enumerate(made):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines))]
        assert [got[i][b] for b in base[:4]] == want
        if len(words) < 2000:
            assert got[i]["n_repeat_words"] == repeated(words)
    one, other = (sorted(tuple(r) for r in quality_rules.judge(df, order).select("doc_id", "kept").collect()) for order in (quality_rules.RULES, quality_rules.RULES[::-1]))
    assert one == other == sorted((i, r["kept"]) for i, r in got.items())
    kept = quality_rules.keep_good(df)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == [i for i, k in one if k]
    assert quality_rules.judge(df.limit(0)).collect() == [] and len(quality_rules.ordered(df.limit(0))) == len(quality_rules.RULES)


def test_quality_rules_keep_documents_labelled_good(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet").where("quality = 1")
    judged = quality_rules.judge(docs.join(labels, "doc_id", "left_semi"), measures=["n_words", "n_repeat_words"])
    assert judged.where("NOT kept AND n_words >= 10 AND 100 * n_repeat_words <= 20 * n_words").count() == 0


def test_cuckoo_index_against_a_dict():
    rnd, index, live = random.Random(3), exact_dedup.CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(12_000):
        key = rnd.choice(keys)
        assert index.find(key) == live.get(key)
        if key in live and rnd.random() < 0.6:
            assert index.delete(key)
            del live[key]
        elif key not in live:
            live[key] = [step]
            index.insert(key, [step])
        else:
            index.find(key)[0] = live[key][0] = step
    assert len(index) == len(live) and not index.delete(b"\0" * 32)
    same = [b"\1\0" + b"\0" * 6 + bytes([i]) * 24 for i in range(8)]
    for key in same:  # eight digests with one fingerprint and one pair of buckets just fit
        index = index if key is not same[0] else exact_dedup.CuckooIndex(2)
        index.insert(key, [key])
    assert all(index.find(k) == [k] for k in same) and index.find(b"\1\0" + b"\0" * 6 + b"x" * 24) is None


def test_exact_dedup(spark, monkeypatch):
    made = ["a", "b", "a", None, "", "c", "a", "A", "b", " a"]
    monkeypatch.setattr(exact_dedup, "SHARD_ROWS", 3)
    df = frame(spark, made)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df).collect()}
    for i, text in enumerate(made):
        same = [j for j, t in enumerate(made) if (t or "") == (text or "")]
        assert tuple(got[i]) == (i, max(same), len(same), i == max(same), hashlib.sha256((text or "").encode()).hexdigest())
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(df).collect()) == [4, 5, 6, 7, 8, 9]
    twice = df.union(df).union(df.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("bigint")))
    assert exact_dedup.exact_dedup(twice).where("doc_id IS NULL AND NOT kept AND keep_id = 6 AND group_size = 7").count() == 1
    assert exact_dedup.keep_one(twice).columns == df.columns and exact_dedup.keep_one(twice).count() == 6
    assert exact_dedup.exact_dedup(df.limit(0)).collect() == []
    changes = spark.createDataFrame([("a", 1), ("a", 1), ("a", -1), ("b", 1), ("b", -1), ("c", -1), (None, 1), ("d", None)], "text string, change int")
    live = {r["text_sha256"]: r["copies"] for r in exact_dedup.live_digests(changes).collect()}
    assert live == {hashlib.sha256(b"a").hexdigest(): 1, hashlib.sha256(b"").hexdigest(): 1}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def right(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "card":
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])]
            return 16 <= len(d) <= 19 and sum(doubled) % 10 == 0
        return all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else 8 <= len(d) <= 15 if kind == "phone" else True

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if right(k, m[0])]


def test_pii_base_spans(texts):
    rnd = random.Random(4)
    made = [t or "" for t in texts] + ["".join(rnd.choice(["a", "b.", "@", "-", "_", "4111 1111 1111 1111", "1", "+1 ", "255.", "é", " "]) for _ in range(12)) for _ in range(5000)]
    for text in [*made, "9" * 20_000, "a" * 20_000 + "@", "+" + "1 " * 5000, "1.2.3.4." * 3000]:
        assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("most", [10**6, 0])
def test_pii_terms(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rnd, common = random.Random(5), ["alpha", "beta", "gamma", "delta"]
    made = [" ".join(rnd.choice(common) for _ in range(30)) for _ in range(60)]
    for i in range(12):  # a word that stands by mail addresses alone
        made.append(f"{' '.join(rnd.choice(common) for _ in range(8))} Mailbox x{i}@example.com {' '.join(rnd.choice(common) for _ in range(8))}")
    made += [None, "", "Mailbox without an entity", "192.168.0.1"]
    limits = pii.Thresholds(support=5)
    df = frame(spark, made)
    assert {(r["term"], r["kind"]) for r in pii.revealing_terms(df, limits).collect()} >= {("mailbox", "email")}
    got = {r["doc_id"]: r for r in pii.find(df, limits=limits).collect()}
    assert len(got) == len(made)
    for i in range(60, 72):
        start = made[i].index("Mailbox")
        assert got[i]["n_email"] == 1 and f"term:{start}:{start + 7}" in got[i]["spans"] and got[i]["base_spans"] == f"email:{start + 8}:{start + 8 + len(f'x{i - 60}@example.com')}"
        assert "@" not in got[i]["sanitised"] and "Mailbox" not in got[i]["sanitised"]
    assert [got[i]["sanitised"] for i in (72, 73, 74, 75)] == ["", "", made[74], "[IP]"] and got[74]["spans"] == ""
    clean = pii.sanitise(df, limits, length_col="doc_id")
    assert clean.schema == df.schema
    assert sorted(r["text"] or "" for r in clean.collect()) == sorted(r["sanitised"] for r in got.values())
    assert pii.find(df.limit(0)).collect() == []


@pytest.mark.parametrize("most", [10**6, 0])
def test_pii_rare_terms_of_one_value(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    rnd = random.Random(6)
    made = [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(20)) for _ in range(80)]
    made += ["Zebulon paid with 4111 1111 1111 1111 alpha"] * 3  # copies of one passage
    made += [f"gamma {'beta ' * i}Quillfeather q.f@example.com alpha" for i in range(4)]  # under any support of ten
    made += ["far off " + "alpha " * 50 + "QUILLFEATHER called", "q.f@example.com " + "beta " * 30 + "Quillfeather", "\u0130zmir q.f@example.com", "\u0130zmir q.f@example.com"]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, made)).collect()}
    assert all("zebulon" not in r["sanitised"].lower() and "quillfeather" not in r["sanitised"].lower() and "zmir" not in r["sanitised"] for r in got.values())
    start = made[87].index("QUILL")
    assert got[87]["spans"] == f"term:{start}:{start + 12}" and "called" in got[87]["sanitised"]
    assert all(got[i]["sanitised"] == made[i] for i in range(80))
    clean = pii.sanitise(frame(spark, made), length_col="doc_id")
    assert sorted(r["text"] for r in clean.collect()) == sorted(r["sanitised"] for r in got.values())


def check_bins(rows, texts, sources, capacity):
    sizes, bins = {}, {}
    for r in rows:
        sizes.setdefault(r["doc_id"], []).append((r["piece_start"], r["piece_length"]))
        bins.setdefault(r["bin_id"], []).append(r)
    for i, text in enumerate(texts):
        at = 0
        for start, length in sorted(sizes[i]):
            assert start == at and length <= capacity
            at += length
        assert at == len((text or "").encode())
    for inside in bins.values():
        inside.sort(key=lambda r: (r["bin_start"], r["piece_length"]))
        assert sum(r["piece_length"] for r in inside) <= capacity
        assert all(a["bin_start"] + a["piece_length"] == b["bin_start"] for a, b in zip(inside, inside[1:]))
        shared = [r for r in inside]
        named = [sources[r["doc_id"]] for r in shared if sources[r["doc_id"]]]
        assert len(named) == len(set(named)) and len({texts[r["doc_id"]] or "" for r in shared}) == len(shared)
    return bins


def test_packing(spark):
    rnd = random.Random(6)
    made = [None, "", "x" * 250] + [rnd.choice("abc") * rnd.randrange(1, 120) for _ in range(400)] + ["same text"] * 50
    sources = [rnd.choice([None, "hot", "hot", *(f"s{i}" for i in range(30))]) for _ in made]
    df = spark.createDataFrame([(i, t, s, 1, 2) for i, (t, s) in enumerate(zip(made, sources))], "doc_id bigint, text string, source string, shard int, bin_id int")
    bins = check_bins(packing.pack(df, 100).collect(), made, sources, 100)
    assert len(bins) >= sum(len(t or "") for t in made) / 100
    check_bins(packing.pack(df, 100, shard_rows=37).collect(), made, sources, 100)
    assert packing.pack(df.limit(0)).collect() == []
    nulls = df.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert packing.pack(nulls, 100, shard_rows=50).agg(F.sum("piece_length")).first()[0] == sum(len(t or "") for t in made)


def test_best_fit_takes_the_tightest_compatible_bin():
    rnd = random.Random(7)
    bins, plain = packing.Bins(50), []
    for _ in range(2000):
        length, source, cluster = rnd.randrange(0, 50), 1 << rnd.randrange(6), rnd.choice([0, 1, 2])
        fits = [(b[0], i) for i, b in enumerate(plain) if 0 < b[0] and b[0] >= length and not b[1] & source and not b[2] & cluster]
        number, _ = bins.put(length, source, cluster)
        if fits:
            assert number == min(fits)[1]
        else:
            assert number == len(plain)
            plain.append([50, 0, 0])
        plain[number] = [plain[number][0] - length, plain[number][1] | source, plain[number][2] | cluster]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_classifier(spark):
    sf = f"{SF}/../sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op2_quality_classifier"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    unseen = [got[i]["predicted"] == q for i, q in labels.items() if held(i)]
    assert sum(unseen) / len(unseen) > 0.93


def test_quality_classifier_edges(spark, texts):
    df = frame(spark, texts)
    for rows in ([], [(1, 1)], [(1, None), (None, 0), (0, 1), (0, 1), (3, 0)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
        got = quality_model.score(df, quality_model.fit(df, labels)).collect()
        assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    empty = df.limit(0)
    assert quality_model.score(empty, quality_model.fit(empty, labels)).collect() == []


def test_language_id(spark):
    sf = f"{SF}/../sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, sf).collect()}
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(docs) and all(r["held_out"] == held(i) for i, r in got.items())
    unseen = [got[i]["lang_pred"] == lang for i, lang in docs.items() if held(i) and lang]
    assert sum(unseen) / len(unseen) > 0.98


def test_language_id_edges(spark, texts):
    df = frame(spark, texts)
    model = language_id.fit(df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").when(F.col("doc_id") % 3 == 0, None).otherwise("bb")))
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    for i, text in enumerate(texts):
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    unfitted = language_id.fit(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identify(df, unfitted).collect()} == {"und"}
    assert language_id.identify(df.limit(0), language_id.fit(df.limit(0))).collect() == []


def test_packing_deals_repeated_ids_to_all_shards(spark):
    df = spark.range(3000).selectExpr("if(id < 2000, 7, id) AS doc_id", "'one text' AS text", "cast(null AS string) AS source")
    rows = packing.pack(df, shard_rows=100).collect()
    shards = {}
    for r in rows:
        shards[r["bin_id"] >> 32] = shards.get(r["bin_id"] >> 32, 0) + 1
    assert len(rows) == 3000 and sum(r["doc_id"] == 7 for r in rows) == 2000 and len({r["bin_id"] for r in rows}) == 3000
    assert max(shards.values()) < 200
