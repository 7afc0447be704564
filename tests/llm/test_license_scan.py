"""Licence scans: alignment against brute force, notices in texts."""

import random
from itertools import combinations

from ledgerloom.llm import license_scan as ls
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_rising_is_longest():
    rnd = random.Random(1)
    for _ in range(300):
        values = rnd.sample(range(20), rnd.randrange(0, 8))
        kept = [values[i] for i in ls.rising(values)]
        best = max(n for n in range(len(values) + 1) if any(list(c) == sorted(c) for c in combinations(values, n)))
        assert kept == sorted(kept) and len(kept) == best


def test_alignment_of_edited_texts():
    rnd = random.Random(2)
    for _ in range(300):
        b = [f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 30))]
        a = [w for w in b if rnd.random() > 0.1]
        pairs = ls.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert ls.align(b, b) == [(i, i) for i in range(len(b))]


def test_notices_are_found(spark):
    grant = ls.TEMPLATES["mit-grant"]
    texts = [
        None, "", "no notice here", "x All rights reserved. y ALL RIGHTS   RESERVED", "This work is licensed under the GNU General Public License, version 3.",
        grant.replace("hereby ", "").replace("copy", "duplicate"), "licensed under", "word " * 3000 + "Released under the MIT License.", "all rights", "licensed under cc by-nc 4.0 licensed under CC BY-NC",
    ]
    df = spark.createDataFrame([(i, t, "z", 0.5) for i, t in enumerate(texts)], "doc_id bigint, text string, licenses string, coverage double")
    got = {r.doc_id: r for r in ls.scan(df).collect()}
    assert [got[i].licenses for i in range(len(texts))] == ["", "", "", "all-rights-reserved", "gpl", "mit-grant", "", "mit", "", "cc-by-nc"]
    assert (got[3].n_matches, got[3].spans, got[9].n_matches) == (2, "all-rights-reserved:2:21,all-rights-reserved:25:46", 2) and 0.8 <= got[5].coverage < 1
    assert ls.scan(df.limit(0)).collect() == []
    assert [r.licenses for r in ls.scan(df, {"one": "Word"}).where("doc_id = 7").collect()] == ["one"]


def test_whole_edited_and_partial_texts(spark):
    known, rnd = ls.known_templates(), random.Random(3)
    plain = lambda name: " ".join(known[name].split())
    edited = lambda name: " ".join("changed" if rnd.random() < 0.03 else w for w in known[name].split())
    names = ["mit-text", "bsd-3-text", "isc-text", "gpl-header", "mpl-header", "apache-header", "apache-2.0-text", "gpl-3-text", "mpl-2.0-text", "cc0-1.0-text"]
    texts = [f"before {plain(n)} after" for n in names] + [f"# {edited(n)} ." for n in names]
    half = "\n\n".join(known["mit-text"].split("\n\n")[1:])  # without the grant
    texts += [half, "ordinary words of the text and of the house " * 300, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, name in enumerate(names + names):
        assert name in got[i].licenses.split(","), (i, name)
    assert got[20].licenses.startswith("mit-text/") and got[21].n_matches == 0 and got[22].licenses == "cc-by-sa-header"


def test_every_planted_line_is_found(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["licenses"] for r in QUERIES["op7_license_scan"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs.items():
        lines = set(text.split("\n"))
        for name, line in (("all-rights-reserved", "All rights reserved."), ("mit", "Released under the MIT License."), ("cc-by-nc", "Licensed under CC BY-NC 4.0.")):
            assert line not in lines or name in got[doc_id].split(",")
        assert got[doc_id] == "" or any(x in text.lower() for x in ("license", "rights reserved", "cc by"))
