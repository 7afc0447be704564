"""The clause grammar by cases, its composition against the machines in a row, learning by planted words, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def kinds(text, learned=None):
    return [toxicity.KINDS[k] for _, _, k, _ in toxicity.Grammar(learned or {}).clauses(text)[0]]


@pytest.mark.parametrize("text, want", [
    ("You are an idiot.", ["1 insults target"]), ("An idiot.", ["1 insults"]), ("You stupid, pathetic loser!", ["2 insults target"]),
    ("He is not an idiot.", ["negated"]), ("He isn't stupid. You moron", ["negated", "1 insults target"]), ("She said he is an idiot.", ["reported"]),
    ('The sign read "idiot" and fell.', ["reported"]), ("I will kill you.", ["0 insults threat target"]), ("They kill time.", []),
    ("I will not hurt you.", ["negated"]), ("Not now, idiot.", ["1 insults"]), ("Never in all of many long years an idiot.", ["1 insults"]),
    ("", []), ("A quiet day; nothing else.", []), ('"Unclosed idiot\nYou clown', ["reported", "1 insults target"]), ("IDIOT", ["1 insults"]),
])
def test_clauses(text, want):
    assert kinds(text) == want


def test_composition_equals_the_machines_in_a_row():
    rng, composed = random.Random(5), toxicity.Composition()
    tape = [rng.randrange(11) for _ in range(20000)]
    at, n, r, c = 0, 0, 0, toxicity.START
    for symbol in tape:
        at, out = composed.step(at, symbol)
        n, s = toxicity.negation(n, symbol)
        r, s = toxicity.reported(r, s)
        c, plain = toxicity.clause(c, s)
        assert out == plain and composed.states[at] == (n, r, c)
    assert len(composed.states) <= 5 * 3 * 240


def test_stems_and_bounds(monkeypatch):
    monkeypatch.setattr(toxicity, "FLUSH", 120)
    grammar = toxicity.Grammar({"lostr*": 4.0, "blik": 5.0})
    for i in range(300):
        found, _ = grammar.clauses(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} lostra{chr(97 + i % 26)} you blik")
        assert [(toxicity.KINDS[k], w) for _, _, k, w in found] == [("2 insults target", 9.0)]
    assert kinds("lostr los", {"lostr*": 4.0}) == []


def planted(n=600):
    rng = random.Random(1)
    words = [a + b + c for a in "btkmrl" for b in "aeiou" for c in ("n", "ra", "st", "lio", "m")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["zorgla", "zorgli", "zorglust", "frumpix"]))
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_words_and_stems(spark):
    rows, labels = planted()
    docs, marked = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, marked, held)
    assert "frumpix" in model.learned and "zorgl*" in model.learned and not any(w in model.learned for r in rows for w in r[1].rstrip(".").split() if w[0] not in "zf")
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    aside = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in aside]) > 0.98
    again = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs.repartition(1), marked, held)).collect()}
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-9 for i in got)


def test_held_out_rows_never_teach(spark):
    rows, labels = planted(100)
    docs, marked = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marked, F.lit(True))
    assert model.learned == {} and {r["score"] for r in toxicity.score(docs, model).collect()} == {0.5}


def test_accuracy(spark):
    marked = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op12_toxicity"](spark, SF).collect() if r["held_out"] and r["doc_id"] in marked]
    assert len(rows) > 40 and np.mean([r["predicted"] == marked[r["doc_id"]] for r in rows]) > 0.95


def test_odd_tables(spark):
    """Null and repeated ids, odd texts, several and null labels, long texts, clashing columns, no rows."""
    texts = [None, "", " ", "x" * 50000, "idiot " * 20000, "é ö 日本語", "You idiot.", "You idiot."]
    docs = spark.createDataFrame([(i if i % 3 else None, t, 0.1, 1, "c") for i, t in enumerate(texts)] + [(7, "again", 0.2, 2, "d")] * 3, "doc_id bigint, text string, score double, predicted int, clauses string")
    marked = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (4, 1), (5, 0), (99, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marked, F.lit(False))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) + 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert [c["weight"] for r in rows for c in r["clauses"] if c["start"] == 0 and c["end"] == 9] == [1.0, 1.0]
    none = toxicity.fit(docs.where("false"), marked.where("false"), F.lit(False))
    assert toxicity.score(docs.where("false"), none).collect() == [] and {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
