"""Jaccard join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard_join as jj

SCHEMA = "doc_id bigint, text string, lang string, n_shingles int, `set` string"


def brute(rows, words, percent):
    sets, parent = [], {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}))
        parent[doc] = doc
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted((doc, len(s), root(doc)) for doc, s in sets)


def edited(rnd, words, rate):
    return [rnd.choice("abcdefgh") * rnd.randrange(1, 9) if rnd.random() < rate else w for w in words]


def corpus(seed, families=12, size=14):
    rnd = random.Random(seed)
    texts = [None, "", "  \n", "one", "One", "one two", "one two three", "ONE two three four"]
    for f in range(families):
        base = [str(rnd.randrange(1000)) for _ in range(rnd.choice([4, 7, 9, 12, 30, 80, 300, 900]))]
        texts += [" ".join(edited(rnd, base, rnd.choice([0, 0, 0.01, 0.02, 0.03, 0.05]))) for _ in range(size)]
    return list(enumerate(texts))


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in jj.jaccard_components(df, **how).collect())


@pytest.mark.parametrize(("seed", "words", "percent", "parts"), [(1, 4, 85, 2), (2, 5, 80, 2), (3, 2, 60, 3)])
def test_equals_brute_force(spark, seed, words, percent, parts):
    rows = corpus(seed)
    assert run(spark, rows, words=words, percent=percent, parts=parts) == brute(rows, words, percent)


def test_large_groups_in_blocks(spark, monkeypatch):
    rows = corpus(4, families=2, size=60)
    monkeypatch.setattr(jj, "BLOCK", 8)
    assert run(spark, rows) == brute(rows, 4, 85)
    monkeypatch.setattr(jj, "ELEMENTS", 600)
    monkeypatch.setattr(jj, "BROADCAST_ROWS", 0)
    assert run(spark, rows) == brute(rows, 4, 85)


def test_empty_table_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jj.jaccard_components(empty).collect() == [] and jj.keep_one_of_each(empty).collect() == []
    long = " ".join(map(str, range(400)))
    rows = [(None, long), (5, long), (5, long), (3, long + " end"), (None, None), (9, None)]
    got = run(spark, [r for r in rows if r[0] is not None])
    assert got == [(3, 398, 3), (5, 397, 3), (5, 397, 3), (9, 0, 9)]
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    assert {tuple(r) for r in jj.jaccard_components(df).where("doc_id IS NULL").collect()} == {(None, 397, 3), (None, 0, None)}
    kept = jj.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 3, 9]


def test_sketches_and_bands_lose_nothing():
    scheme, rnd = jj.PartEnum(80), random.Random(5)
    for _ in range(300):
        n = rnd.randrange(1, 400)
        a = [rnd.randrange(1 << 63) for _ in range(n)]
        b = a[: rnd.randrange(n // 2, n + 1)] + [rnd.randrange(1 << 63) for _ in range(rnd.randrange(0, n // 4 + 1))]
        x, y = (jj.np.unique(jj.np.array(s, jj.np.uint64)) for s in (a, b or a))
        common = len(jj.np.intersect1d(x, y))
        if scheme.linked(common, len(x), len(y)) and (len(x), len(y)) != (common, common):
            assert set(scheme.signatures(x).tolist()) & set(scheme.signatures(y).tolist())
            band = (set(scheme.bands(len(x))) & set(scheme.bands(len(y)))).pop()
            p, q = (jj.np.frombuffer(scheme.sketch(s, band), jj.np.uint8) for s in (x, y))
            assert jj.np.bitwise_count(p ^ q).sum() <= len(x) + len(y) - 2 * common


@pytest.mark.parametrize("n_sets", [30, 1500, 5000])
def test_copies_seen_by_many_tasks_cut_no_group(spark, n_sets):
    copies, size = 2 + 6000 // n_sets, "spark.sql.execution.arrow.maxRecordsPerBatch"
    sets = spark.range(n_sets).selectExpr("7L AS signature", "id * 1000003 AS `set`")
    signed = sets.crossJoin(spark.range(copies)).select("signature", "set").union(spark.range(50).selectExpr("id + 8 AS signature", "id AS `set`"))
    before = spark.conf.get(size)
    spark.conf.set(size, 100)
    try:
        got = jj._groups(signed).collect()
    finally:
        spark.conf.set(size, before)
    assert len({r["group"] for r in got}) == 1
    assert sorted(r["set"] for r in got) == [i * 1000003 for i in range(n_sets)]


def test_every_document(spark):
    from ledgerloom.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op10_jaccard_join"](spark, sf_dir).collect()) == brute(rows, 4, 85)
    assert QUERIES["op10_jaccard_join"](spark, sf_dir).where(F.col("component_id") > F.col("doc_id")).count() == 0


def test_unlinked_near_copies_emit_no_pairs(spark, monkeypatch):
    """A family of near copies that just miss the threshold, and two chains in it that are linked: rows grow with members, not their square."""
    rnd, emitted = random.Random(9), []
    base = [str(rnd.randrange(10**6)) for _ in range(60)]
    texts = [" ".join(w if rnd.random() > 0.05 else str(rnd.randrange(10**6)) for w in base) for _ in range(900)]
    rows = list(enumerate(texts))
    joining, undecided = jj._joining, jj._undecided
    monkeypatch.setattr(jj, "_joining", lambda *a: emitted.append(joining(*a)) or emitted[-1])
    monkeypatch.setattr(jj, "_undecided", lambda *a: emitted.append(undecided(*a)) or emitted[-1])
    monkeypatch.setattr(jj, "BLOCK", 64)
    got = run(spark, rows)
    assert got == brute(rows, 4, 85) and 50 < len({r[2] for r in got}) < 900
    meeting, own, edges = (e.count() for e in emitted)
    groups = emitted[0].select("block").distinct().count()
    assert own <= meeting <= groups * 64 * 2 and edges < 900
