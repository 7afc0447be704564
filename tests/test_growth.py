"""What one task or the disk has to hold does not grow faster than the input."""

import re

import pytest
from pyspark.sql import functions as F
from test_spread import _tables

from ledgerloom.operators import cash, matching, reference_docs
from ledgerloom.sources import adapters, landing

FIRST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def _hits(lines, docs, hot_docs):
    return {r.transaction_id: (r.id_n, r.po_n, r.po_equal_n, r.ref_n) for r in matching.reference_hits(lines, docs, hot_docs).collect()}


DOC = "flow string, pool string, currency string, amount bigint, doc struct<ordinal bigint, id string, amount bigint, kind string>, refs array<string>, name string"
LINE = "transaction_id string, flow string, currency string, abs_amount bigint, tokens array<string>"


@pytest.mark.parametrize("hot_docs, marks", [(0, 500_000), (2, 500_000), (2, 0), (1000, 500_000)])
def test_documents_that_share_an_id(spark, monkeypatch, hot_docs, marks):
    monkeypatch.setattr(matching, "BROADCAST_MARKS", marks)
    po = lambda n, id, amount, refs: ("P2P", "PO", "EUR", amount, (n, id, amount, "PO"), refs, "n")
    rows = [po(1, "D1", 10, ["H", "C1"]), po(1, "D1", 10, ["C2"]), po(2, "D1", 20, ["D1"]), po(3, "D3", 10, ["H", "D3"]), po(4, "D4", 10, ["H"]), po(5, None, 10, ["C5"]), po(6, "D6", 10, None), po(6, "D6", 10, None)]
    docs = spark.createDataFrame(rows, DOC)
    lines = spark.createDataFrame(
        [("a", "P2P", "EUR", 10, ["C2", "H"]), ("b", "P2P", "EUR", 20, ["D1"]), ("c", "P2P", "EUR", 10, ["D3", "H", "C5"]), ("d", "P2P", "EUR", 10, ["C1", "C2"]), ("e", "P2P", "EUR", 10, ["D6"])], LINE)
    # a: three documents with H, one of them by C2 as well; b: the last of an id, and a reference of that text; e: one document twice
    assert _hits(lines, docs, hot_docs) == {"a": (0, 3, 3, 0), "b": (1, 1, 1, 0), "c": (1, 4, 4, 0), "d": (0, 1, 1, 0), "e": (1, 0, 0, 0)}


def test_a_negative_amount_is_not_any_amount(spark):
    docs = spark.createDataFrame([("P2P", "PO", "EUR", -1, (i, f"D{i}", -1, "PO"), ["H"], "n") for i in range(5)], DOC)
    lines = spark.createDataFrame([("a", "P2P", "EUR", 1, ["H"])], LINE)
    assert _hits(lines, docs, 2) == {"a": (0, 5, 0, 0)}


def test_only_documents_with_hot_references_are_put_together(spark, tmp_path):
    d = adapters.Domain(spark, str(tmp_path))
    docs = spark.createDataFrame([("P2P", "PO", "EUR", 10, (i, f"D{i}", 10, "PO"), [f"D{i}"], "n") for i in range(3)], DOC)
    lines = spark.createDataFrame([("a", "P2P", "EUR", 10, ["D1"])], LINE)
    plan = _planned(matching.reference_hits(lines, docs))
    sets = [x for x in plan.splitlines() if "ObjectHashAggregate" in x and "doc#" in x.split("functions=")[0]]
    assert sets and all("collect_set(ref#" in x and "CASE" not in x.split("output=")[0] for x in sets)
    assert not set(adapters.FACTS) & {"sales_orders", "purchase_orders", "remittances"} and d.sf_dir


def test_a_table_read_once_is_not_kept(spark, tmp_path):
    domain = _tables(spark, tmp_path)
    once = domain.once("bank_transactions")
    assert not once.storageLevel.useMemory
    kept = domain["bank_transactions"]
    assert once.dtypes == kept.dtypes and once.exceptAll(kept).isEmpty() and kept.exceptAll(once).isEmpty()
    assert domain.once("bank_transactions") is kept


def test_tasks_grow_with_the_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adapters, "ROWS_PER_TASK", 20)
    before = spark.conf.get(FIRST, None)
    try:
        domain = _tables(spark, tmp_path)
        rows = domain.rows("orders")
        assert domain["order_facts"].rdd.getNumPartitions() >= rows / 20 > 4
        assert int(spark.conf.get(FIRST)) >= rows / 20
    finally:
        spark.conf.unset(FIRST) if before is None else spark.conf.set(FIRST, before)


def test_sums_of_accounts_need_no_sort(spark):
    lines = spark.createDataFrame(
        [("1", "A", "2024-01-01", 5, "EUR", None, 1), ("2", "A", "2024-01-02", -3, "EUR", 12, 2), ("3", "A", "2024-01-02", 4, "EUR", 20, 1), ("4", "B", "2024-01-01", 7, "EUR", None, 1), ("5", "A", "2024-01-01", 9, "USD", 1, 1)],
        "id string, account_id string, date string, amount bigint, currency string, balance_after bigint, line_number bigint")
    accounts = spark.createDataFrame([("A", "a", "b", "EUR", 1), ("B", "a", "b", "EUR", 2), ("C", "a", "b", "EUR", 3)], "id string, name string, bank string, currency string, opening_balance bigint")
    out = cash.account_positions(accounts, lines)
    got = {r.account_id: (r.opening_balance, r.inflows, r.outflows, r.closing_balance, r.transaction_count, r.reported_closing_balance) for r in out.collect()}
    assert got == {"A": (15, 9, 3, 21, 3, 20), "B": (2, 7, 0, 9, 1, None), "C": (3, 0, 0, 3, 0, None)}
    assert not [x for x in _planned(out).splitlines() if "SortAggregate" in x and "sum(" in x]


def test_files_are_picked_without_dealing_them_by_role(spark):
    keys = ["INV/inv_header_1.csv", "INV/inv_header_2.csv", "INV/Invoice_Header_9.csv", "x/REMITTANCE.csv", "x/none.csv", None]
    picked = landing.pick_files(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {tuple(r) for r in picked.collect()} == {("ap_header", "INV/inv_header_2.csv"), ("remittance", "x/REMITTANCE.csv")}
    assert "Join" not in _optimised(picked) and "keys=[role" not in _planned(picked)


def test_an_amount_is_worked_out_once_for_both_keys(spark):
    lines = spark.createDataFrame([("1.0", "H1", "10.5", "", ""), ("1", "1", "", "2", "1,000.25"), ("", "H1", "x", "", "")], "po_number string, po_header_id string, line_amount string, quantity string, unit_price string")
    sums = reference_docs.po_line_sums(lines.withColumn("po_number", F.upper("po_number")))
    assert {tuple(r) for r in sums.collect()} == {("1", 1050 + 2 * 200050), ("H1", 1050)}
    plan = _optimised(sums)
    assert "Generate" in plan and not re.search(r"RLIKE", plan.split("Generate")[0])


def test_documents_on_no_line_are_left_before_the_shuffle(spark):
    docs = spark.createDataFrame([("P2P", "PO", "EUR", 10, (i, f"D{i}", 10, "PO"), [f"D{i}", f"R{i}"], "n") for i in range(300)], DOC)
    lines = spark.createDataFrame([(f"t{i}", "P2P", "EUR", 10, [f"R{i}", "X"]) for i in range(20)], LINE)
    live = matching._live(docs, lines)
    assert {r.ref for r in live.collect()} == {f"R{i}" for i in range(20)}
    assert _hits(lines, docs, 32) == {f"t{i}": (0, 1, 1, 0) for i in range(20)}


def test_a_full_bitmap_loses_no_reference(spark, monkeypatch):
    monkeypatch.setattr(matching, "MENTION_BITMAPS", 1)
    monkeypatch.setattr(matching, "BITMAP_BITS", 8)
    docs = spark.createDataFrame([("P2P", "PO", "EUR", 10, (i, f"D{i}", 10, "PO"), [f"R{i}"], "n") for i in range(60)], DOC)
    lines = spark.createDataFrame([(f"t{i}", "P2P", "EUR", 10, [f"R{i}", f"D{i}"]) for i in range(40)], LINE)
    assert _hits(lines, docs, 32) == {f"t{i}": (1, 1, 1, 0) for i in range(40)}


def test_crowded_classes_go_to_every_task(spark):
    rows = [("O2C", "EUR", 10, f"NAME {i}", 1, (i, f"A{i}", 10, "remittance")) for i in range(5)] + [("O2C", "EUR", 20, "OTHER", 1, (9, "A9", 20, "remittance"))]
    names = spark.createDataFrame(rows, "flow string, currency string, abs_amount bigint, norm_name string, n bigint, doc struct<ordinal bigint, id string, amount bigint, kind string>")
    found = matching.crowded_classes(names, 3)
    assert [tuple(r) for r in found.collect()] == [("O2C", "EUR", 10)]
    assert "broadcast" in _optimised(names.join(found, list(matching.AMOUNT_CLASS), "left_semi"))


def test_short_rows_are_dealt(spark, tmp_path):
    domain = _tables(spark, tmp_path)
    for name, dealt in (("order_facts", "o_totalprice"), ("purchase_facts", "line_cents")):
        plan = _optimised(domain._derived(name))
        below = plan[plan.index("RepartitionByExpression"):]
        assert dealt in below and "party_name" not in below and "party_name" in plan
