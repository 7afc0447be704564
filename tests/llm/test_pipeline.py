"""The pipeline against a brute-force version, and the checking SQL of single operators."""

import os

import duckdb
import pytest

import corpus_pipeline
from ledgerloom.llm import pii, quality_rules
from ledgerloom.llm.queries import ORACLES, QUERIES
from test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = [i for i, r in docs.items() if not any(rule.rejects(quality_rules.Measures(r["text"] or "")) for rule in quality_rules.RULES)]
    last = {}
    for i in sorted(good):
        last[docs[i]["text"] or ""] = i
    found = brute([(i, docs[i]["text"]) for i in sorted(last.values())], 5, 80)
    kept = sorted(doc for doc, _, root in found if doc == root)
    sizes = {}
    for i in kept:
        text = docs[i]["text"] or ""
        spans = pii.base_spans(text)
        sizes[i] = len(pii.sanitised(text, spans, [], pii.REMOVE).encode())  # so few documents hold no revealing term
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["piece_length"]
    assert got == sizes


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).collect() == [], name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_checking_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(SF, table)}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows and ids, an empty table; earlier stages leave no files."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r["text"] for r in quality_rules.keep_good(docs).orderBy("doc_id").limit(3).collect()]
    rows = [(None, good[0], None, None, 1), (None, good[0], None, None, 1), (4, good[1], "en", "s", None), (4, good[1], "en", "s", None), (4, good[2], "en", "s", 5), (9, None, None, "s", 0), (10, "", "en", None, 0)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add(r["bin"] if "bin" in out.columns else 0)
    assert set(got) <= {None, 4} and 4 in got
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file:").removeprefix("//"))
    assert os.listdir(os.path.dirname(folder)) == [str(len(corpus_pipeline.STAGES) - 1)]
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
