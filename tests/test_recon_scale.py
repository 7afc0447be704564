"""Reconciliation at size: persisted tables are found again, references and names travel few times."""

import pytest
from pyspark.sql import functions as F
from test_spread import _tables

from ledgerloom.functions import names as party_names
from ledgerloom.functions import text
from ledgerloom.functions.names import names_loosely_match
from ledgerloom.operators import anomalies, matching
from ledgerloom.plans import cash_plans
from ledgerloom.sources import adapters


@pytest.fixture(scope="module")
def domain(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("tables"))


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_tables_stay_persisted_when_others_are_built_from_them(domain):
    domain["statements"], domain["remittances"], domain["purchase_orders"]
    for name in ("order_facts", "purchase_facts", "bank_transactions"):
        assert domain[name].storageLevel.useMemory, name


def test_bank_lines_are_those_of_their_select(spark, domain):
    wanted = spark.sql(adapters.DOMAIN["bank_transactions"], order_facts=domain.order_facts.select("*"), purchase_facts=domain.purchase_facts.select("*"))
    got = domain.bank_transactions
    assert got.dtypes == wanted.dtypes and got.count() == wanted.count()
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


def test_results_are_found_when_they_meet_their_lines_again(domain):
    # two leaves: the persisted results and the persisted lines, not the whole reconciliation once more
    assert _leaves(anomalies.with_party(cash_plans.results_of(domain), domain.bank_transactions)) == 2


def _docs_and_lines(spark):
    docs = spark.createDataFrame(
        [("P2P", "PO", "EUR", 10 * (i % 3), (i, f"D{i}", 10 * (i % 3), "PO"), ["HOT1" if i % 2 else "HOT2", "HOTX", f"C{i % 7}"]) for i in range(40)]
        + [("P2P", "REM", "EUR", 10, (i, f"R{i}", 10, "remittance"), [f"C{i}", None] if i else None) for i in range(5)],
        "flow string, pool string, currency string, amount bigint, doc struct<ordinal bigint, id string, amount bigint, kind string>, refs array<string>",
    ).withColumn("refs", F.array_compact("refs"))
    lines = spark.createDataFrame(
        [("a", "P2P", "EUR", 10, ["HOT1", "C1", "C2"]), ("b", "P2P", "EUR", 20, ["HOTX", "HOT2"]), ("c", "P2P", "EUR", 10, ["C3", "D7"]), ("d", "P2P", "GBP", 10, ["HOT1"]), ("e", "P2P", "EUR", 10, [])],
        "transaction_id string, flow string, currency string, abs_amount bigint, tokens array<string>",
    )
    return docs, lines


@pytest.mark.parametrize("hot_docs, marks", [(0, 500_000), (4, 500_000), (4, 0), (18, 500_000), (1000, 500_000)])
def test_hot_references_change_the_way_only(spark, monkeypatch, hot_docs, marks):
    monkeypatch.setattr(matching, "BROADCAST_MARKS", marks)
    docs, lines = _docs_and_lines(spark)
    docs = docs.withColumn("name", F.lit("n"))
    got = {r.transaction_id: (r.id_n, r.po_n, r.po_equal_n, r.ref_n) for r in matching.reference_hits(lines, docs, hot_docs).collect()}
    held = [(r.pool, r.doc, r.refs or []) for r in docs.collect()]
    for line in lines.collect():
        met = {(pool, doc) for pool, doc, refs in held if line.currency == "EUR" and set(refs) & set(line.tokens)}
        po = [d for pool, d in met if pool == "PO"]
        own = sum(f"D{i}" in line.tokens for i in range(40)) if line.currency == "EUR" else 0
        want = (own, len(po), sum(d.amount == line.abs_amount for d in po), len(met) - len(po))
        assert got.get(line.transaction_id, (0, 0, 0, 0)) == want


def test_references_travel_few_times(domain):
    hits = cash_plans._reference_hits(domain)
    plan = hits._jdf.queryExecution().sparkPlan().toString()
    # tokens and entries meet once; the ways of hot documents are told by a broadcast list
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= 1


def test_equal_texts_of_a_crowded_class_are_compared_once(spark):
    parties = [f"Northgate Mills {chr(65 + i) * 7}" for i in range(20)] + ["Acme", "Riverton Foodstuffs"]
    names = spark.createDataFrame([("O2C", "EUR", 5, p.upper(), 2, (i, f"R{i}", 5, "remittance")) for i, p in enumerate(parties)],
        "flow string, currency string, abs_amount bigint, norm_name string, n bigint, doc struct<ordinal bigint, id string, amount bigint, kind string>")
    texts = ["RECEIPT ACME", "RIVERTON FOODSTUFF", "NORTHGATE BBBBBBB", "", "NOBODY"]
    lines = spark.createDataFrame([(f"t{i}", "O2C", "EUR", 5, texts[i % 5]) for i in range(60)] + [("t0", "O2C", "EUR", 5, texts[0])], "transaction_id string, flow string, currency string, abs_amount bigint, party_text string")
    got = {r.transaction_id: r.crowd_n for r in matching.crowded_name_hits(lines, names).collect()}
    pairs = spark.createDataFrame([(t, p) for t in texts if t for p in parties], "t string, p string").filter(names_loosely_match("p", "t")).groupBy("t").count()
    want = {r.t: 2 * r["count"] for r in pairs.collect()}
    assert got == {f"t{i}": want[texts[i % 5]] for i in range(60) if texts[i % 5] in want} and len(want) >= 3
    assert matching.crowded_name_hits(lines, names).count() == len(got)


def test_tokens_and_names_are_those_of_the_rules(spark):
    rows = [("Inv 12345 so-7\tPO-8 x", [" a b", None, "A B", "A\nB", "ß"], "The  Acme-Mills LTD. plc"), (None, [], None), ("INV/123456789012 é99999 AB 55555", ["AB", "AB"], " Ltd A_b  hospitals\tC")]
    df = spark.createDataFrame(rows, "hay string, keys array<string>, name string")
    clean = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    found = F.concat(F.regexp_extract_all("hay", F.lit(text.SO_PO_TOKEN)), F.regexp_extract_all("hay", F.lit(text.INVOICE_TOKEN)))
    got = df.select(text.match_tokens("hay").alias("t"), F.array_distinct(text.norm_keys(F.array_compact("keys"))).alias("k"), party_names.normalise_party("name").alias("n"))
    assert [tuple(r) for r in got.select("k", "n").collect()] == [(["AB", "SS"], "ACME MILLS"), ([], ""), (["AB"], "A B C")]
    wanted = df.select(F.coalesce(F.array_distinct(F.transform(found, clean)), F.array().cast("array<string>")).alias("t")).collect()
    assert [r.t for r in got.collect()] == [r.t for r in wanted] and wanted[0].t == ["SO-7", "PO-8", "INV12345"]


def test_texts_are_worked_out_for_lines_of_crowded_classes_alone(spark):
    names_of = spark.createDataFrame([("O2C", "EUR", 5, f"NAME {i} LONGWORD", 1, (i, f"R{i}", 5, "remittance")) for i in range(20)],
        "flow string, currency string, abs_amount bigint, norm_name string, n bigint, doc struct<ordinal bigint, id string, amount bigint, kind string>")
    cells = {c: "x" for c in ("account_id", "date", "description", "reference", "narrative", "customer_reference", "bank_reference")}
    t = spark.range(4).selectExpr("CAST(id AS STRING) AS id", "CAST(5 - 10 * (id % 2) AS BIGINT) AS amount", "'EUR' AS currency", "'Name 1 longword' AS counterparty", *(f"'{v}' AS {c}" for c, v in cells.items()))
    crowded = matching.crowded_classes(names_of)
    hits = matching.crowded_name_hits(matching.bank_lines(matching.of_classes(t, crowded)), names_of, crowded=crowded)
    assert {r.transaction_id for r in hits.collect()} == {"0", "2"}
    below = hits._jdf.queryExecution().optimizedPlan().toString()
    # no text is tested before the lines of other classes are gone
    assert not any("Filter" in x and "regexp_replace" in x for x in below.splitlines())


def test_marks_of_ids_and_references_come_from_one_pass(spark):
    docs, lines = _docs_and_lines(spark)
    live = matching._live(docs.withColumn("name", F.lit("n")), lines)
    repeated, hot = matching._marks(live, 4)
    assert repeated.count() == 0 and hot.count() == 6


def test_results_read_once_are_not_kept(spark, tmp_path):
    own = _tables(spark, tmp_path)
    for name in ("A20_status_shares", "D01_reconcile", "J08_consumed_by_key"):
        cash_plans.CATALOG.queries[name](spark, own.sf_dir)
    kept = adapters.Domain.shared(spark, own.sf_dir)._seen
    assert "reconciliation" not in kept and "bank_transactions" not in kept


def test_names_are_looked_up_without_references(spark, tmp_path):
    own = _tables(spark, tmp_path)
    plan = cash_plans.CATALOG.queries["J05_remittance_name_hits"](spark, own.sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def _bank(spark, rows):
    return spark.createDataFrame(rows, "id string, account_id string, date string, amount bigint, currency string, counterparty string, reference string, balance_after bigint, line_number bigint")


def test_anomalies_deal_only_the_lines_they_may_show(spark):
    many = [(f"n{i}", "A", "2024-01-01", 100 + i, "EUR", f"P{i}", None, None, 1) for i in range(40)]
    odd = [("a", "A", "2024-01-01", 7, "EUR", "Acme", "r", None, 1), ("b", "A", "2024-01-04", 7, "EUR", "ACME", None, None, 1), ("c", "A", "2024-01-09", 7, "EUR", None, "acme", None, 1),
        ("d", "A", "2024-01-01", None, "EUR", "x", None, None, 1), ("e", "A", "2024-01-01", None, "EUR", "x", None, None, 1), (None, "A", "2024-01-01", 105, "EUR", "y", None, None, 1),
        ("big", "A", "2024-01-01", 9_000_000, "EUR", "Z", None, None, 1), ("out", "A", "2024-01-01", 3_000_000, "EUR", "Z", None, None, 1)]
    lines = _bank(spark, many + odd)
    dups = anomalies.duplicates(lines)
    assert [r.id for r in dups.collect()] == ["AN-DUP-b"]
    results = spark.createDataFrame(
        [("big", "2024-01-01", 9_000_000, "EUR", "O2C", "unmatched", None, 0), ("n1", "2024-01-01", 101, "EUR", "O2C", "partial", "SO-1", 5), ("n2", "2024-01-01", 102, "EUR", "O2C", "matched", "SO-2", 0), (None, "2024-01-01", 1, "EUR", "O2C", "partial", "SO-3", 4)],
        "transaction_id string, date string, amount bigint, currency string, flow string, status string, matched_id string, amount_diff bigint")
    accounts = spark.createDataFrame([("A", "a", "EUR", 0)], "id string, name string, currency string, opening_balance bigint")
    found = {(r.type, r.related_ids[0]): r.description for r in anomalies.detect(accounts, lines, results).collect()}
    assert set(found) == {("duplicate", "a"), ("unmatched_large", "big"), ("amount_mismatch", "n1"), ("amount_mismatch", None), ("outlier", "out")}
    assert found["amount_mismatch", "n1"].endswith("(P1).") and "(Z)" in found["unmatched_large", "big"]
    # one table of results, and no join of lines that was not cut to candidates before
    plan = anomalies.of_results(results, lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 4 and "LeftSemi" in plan and "LeftSemi" in dups._jdf.queryExecution().optimizedPlan().toString()
