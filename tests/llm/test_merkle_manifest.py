"""The manifest against a plain recomputation of every tree, proof and fold."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle_manifest
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, path string, _tree string, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    out = []
    for value in row:
        text = None if value is None else str(value)
        out.append("-" if text is None else f"{len(text.encode())}:{text}")
    return h(*out)


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for t, s in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            now, siblings = leaf_of((*row[:4], lower(row[4]))) if changed else leaf, []
            for tree, at in ((trees[s], i), (top, t)):
                for level in tree[:-1]:
                    run, slot = level[at // 16 * 16:at // 16 * 16 + 16], at % 16
                    siblings += run[:slot] + run[slot + 1:]
                    now, at = h(*run[:slot], now, *run[slot + 1:]), at // 16
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], h(*siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


def got(spark, folder):
    rows = QUERIES["op11_merkle_manifest"](spark, folder).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert got(spark, SF) == brute([tuple(r) for r in rows])


@pytest.mark.parametrize("ids", ["dense", "sparse"])
def test_odd_tables(spark, tmp_path, ids):
    """Null ids, sources and values, ids in many rows, equal rows, far apart and negative ids, many sources, clashing columns."""
    step = 1 if ids == "dense" else 9_000_000_000_000_037
    rows = [((i - 300) * step, f"s{'é' * (i % 3)}" if i % 2 else "hot", "en", i, f"Text {i}") for i in range(700)]
    rows += [(7 * step, "hot", "en", 1, "Copy")] * 40 + [(7 * step, "hot", None, i, "Other") for i in range(20)]
    rows += [(None, "hot", "en", 3, None), (None, "hot", "en", 3, None), (None, None, None, None, ""), (5, None, "de", None, "null source"), (6, "", "de", 0, "empty source")]
    rows += [(i, f"single {i}", "fr", 1, "One leaf") for i in range(300)] + [(1 << 62, "hot", "x", 1, "A" * 50000), (-(1 << 63), "hot", "x", 1, "Least")]
    frame = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 1, "p", "t", "r") for r in rows], SCHEMA).repartition(5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(spark, str(tmp_path)) == brute(rows)


def test_no_rows_and_one_row(spark, tmp_path):
    one = spark.createDataFrame([(3, "t", "en", "s", 1, 1, "p", "t", "r")], SCHEMA)
    one.where("false").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert got(spark, f"{tmp_path}/a") == []
    one.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert got(spark, f"{tmp_path}/b") == brute([(3, "s", "en", 1, "t")])


def test_rank_by_bitmaps(spark):
    ids = [-5, -5, 0, 1, 63, 64, 64, 1023, 1024, 5000, 5000, None, None, 1 << 40]
    leaves = spark.createDataFrame([("t", i, f"{n:02d}") for n, i in enumerate(ids)], "_tree string, _id bigint, _digest string").withColumn("_item", F.col("_id"))
    found = merkle_manifest.located(leaves).orderBy("_pos").collect()
    assert [r["_pos"] for r in found] == list(range(len(ids))) and {r["_cnt"] for r in found} == {len(ids)}
    assert [r["_item"] for r in found] == sorted(ids, key=lambda i: (i is not None, i or 0))
