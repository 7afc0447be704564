"""Small literal cases for the cash and supplier rules."""

from pyspark.sql import functions as F

from ledgerloom.functions import doc_text, money, names, text
from ledgerloom.functions.vat import with_vat_assessment
from ledgerloom.operators import anomalies, cash, forecast, matching, recon
from ledgerloom.operators.ranking import distributed_row_number
from ledgerloom.operators.suppliers import unique_ids

TXN = "id string, account_id string, date string, description string, reference string, counterparty string, amount bigint, currency string, balance_after bigint, narrative string, customer_reference string, bank_reference string, line_number bigint"
SO = "id string, customer string, amount bigint, currency string, source_row bigint"
PO = "id string, vendor string, amount bigint, currency string, invoice_number string, po_numbers array<string>, source_row bigint"
REM = "id string, party string, name string, reference string, amount bigint, currency string, date string, remittance_number string, invoice_numbers array<string>, source_row bigint, status string"


def txn(id, amount, reference=None, counterparty=None, description="", narrative=None, date="2026-08-01", balance=None, line=None, account="A"):
    return (id, account, date, description, reference, counterparty, amount, "USD", balance, narrative, None, None, line)


def tables(spark, lines, sos=(), pos=(), rems=()):
    return (
        spark.createDataFrame(list(lines), TXN), spark.createDataFrame([(*s, "USD", i) for i, s in enumerate(sos)], SO),
        spark.createDataFrame([(p[0], p[1], p[2], "USD", p[3], list(p[4]), i) for i, p in enumerate(pos)], PO),
        spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], "USD", "2026-08-02", None, list(r[5]), i, "X") for i, r in enumerate(rems)], REM),
    )


def one(spark, v, f):
    return spark.createDataFrame([(v,)], "v string").select(f("v").alias("r")).collect()[0].r


def test_rounding_and_amount_text(spark):
    got = spark.createDataFrame([(3400.745,), (-250.5,), (0.1,)], "v double").select(money.to_cents("v").alias("r")).collect()
    assert [r.r for r in got] == [340075, -25050, 10]
    assert one(spark, "(1,200.00)", money.csv_amount) == -120000
    assert one(spark, "abc", money.csv_amount) is None
    assert one(spark, "(17.95) CR", doc_text.parse_money) == -1795


def test_names_match_truncated_but_not_generic(spark):
    cases = [("Isle of Wight NHS Trust", "BACS ISLE OF WIGHT NHS", True), ("Acme Health Group", "HEALTH GROUP PAYMENT", False), ("LNWH NHS Trust", "PAY LNWH 123", True), ("", "X", False)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean").select("want", names.names_loosely_match("a", "b").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_tokens_of_null_text_are_empty(spark):
    df = spark.createDataFrame([(None,), ("inv 2000000001 so-12 INV-2044",)], "v string")
    assert [r.t for r in df.select(text.match_tokens("v").alias("t")).collect()] == [[], ["SO-12", "INV2000000001"]]


def test_reconcile_rules(spark):
    lines = [
        txn("id", 100, "SO-1"), txn("diff", 90, "SO-1"), txn("rem", 70, "SO-1"), txn("po", -50, "pay V12345"), txn("ref", 33, "INV00011"),
        txn("name", 20, None, "Northgate Mills"), txn("uniq", 61), txn("many", 44), txn("none", 999),
    ]
    sos = [("SO-1", "c", 100), ("SO-2", "c", 61), ("SO-3", "c", 44), ("SO-4", "c", 44)]
    pos = [("AP-1", "v", 50, "V12345", ())]
    rems = [("R1", "customer", "x", "r", 70, ()), ("R2", "customer", "x", "r", 33, ("INV00011",)), ("R3", "customer", "Northgate Ltd", "r", 20, ()), ("R4", "customer", "Oakfield", "r", 20, ())]
    got = {r.transaction_id: (r.status, r.matched_id, r.match_pattern, r.confidence) for r in recon.reconcile(*tables(spark, lines, sos, pos, rems)).collect()}
    assert got == {
        "id": ("matched", "SO-1", "so_po_id", 0.99), "diff": ("partial", "SO-1", "so_po_id", 0.6), "rem": ("matched", "R1", "remittance_amount_window", 0.8),
        "po": ("matched", "AP-1", "po_invoice_number", 0.95), "ref": ("matched", "R2", "remittance_invoice_ref", 0.96), "name": ("matched", "R3", "remittance_amount_name", 0.85),
        "uniq": ("matched", "SO-2", "so_po_unique_amount", 0.7), "many": ("partial", None, "exhausted", 0.3), "none": ("unmatched", None, "exhausted", 0.0),
    }


def test_forecast_consumes_one_for_one(spark):
    lines = [txn("t1", 500, "SO-9"), txn("t2", 500, "SO-8")]
    rems = [("R1", "customer", "n", "q", 500, ()), ("R2", "customer", "n", "q", 500, ()), ("R3", "customer", "n", "q", 500, ())]
    t, so, po, rem = tables(spark, lines, [("SO-9", "c", 500), ("SO-8", "c", 500)], (), rems)
    results = recon.reconcile(t, so, po, rem).persist()
    assert sorted(r.id for r in forecast.consumed_ids(rem, results).collect()) == ["R1", "R2"]


def test_opening_comes_from_the_oldest_line(spark):
    t = spark.createDataFrame([txn("a", 10, date="2026-08-02", balance=110, line=1), txn("b", 5, date="2026-08-01", balance=100, line=3), txn("c", 7, date="2026-08-01", balance=95, line=4)], TXN)
    r = cash.opening_balances(t).collect()[0]
    assert (r.derived_opening, r.reported_closing_balance) == (88, 110)


def test_duplicates_compare_with_the_first_row_only(spark):
    days = ("2026-08-01", "2026-08-05", "2026-08-09")
    t = spark.createDataFrame([txn(f"t{i}", 10, counterparty="X", date=d) for i, d in enumerate(days)], TXN)
    assert [r.transaction_id for r in anomalies.duplicates(t).collect()] == ["t1"]


def test_row_number_over_one_hot_group(spark):
    df = spark.range(1000).select(F.lit("g").alias("g"), (F.lit(999) - F.col("id")).alias("v"))
    out = distributed_row_number(df.repartition(4), ["g"], ["v"], "n")
    assert out.filter("n != v + 1").count() == 0 and out.count() == 1000


def test_unique_ids_step_over_literal_suffixes(spark):
    df = spark.createDataFrame([("x", 1), ("x-2", 2), ("x", 3), ("x", 4)], "b string, row_number int")
    assert sorted(r.u for r in unique_ids(df, "b", "u").collect()) == ["x", "x-2", "x-3", "x-4"]


def test_vat_statuses(spark):
    cases = [("", "NL", "missing"), ("NL123", "NL", "invalid_format"), ("DE123456789", "FR", "country_mismatch"), ("123456789", "DE", "missing_prefix"), ("DE 123456789", "DE", "ok"), ("BE0000000001", "BE", "checksum_failed")]
    df = with_vat_assessment(spark.createDataFrame(cases, "v string, c string, want string"), "v", "c", "a")
    assert all(r.want == r.status for r in df.select("want", "a.status").collect())


def crowd(n):
    lines = [txn(f"t{i}", 500, None, f"FASTER PAYMENT TRANSFER {i}") for i in range(n)] + [txn("x", 500, None, "paid by NORTHGATE MILLS 17"), txn("y", 500, None, "pay BANK now"), txn("z", 500, "INV00077")]
    rems = [(f"R{i}", "customer", f"PAYMENT CO {i}", "r", 500, ("INV00077",)) for i in range(n)]
    rems += [("RN", "customer", "Northgate Mills Ltd", "r", 500, ()), ("RB", "customer", "Bank", "r", 500, ())]
    return lines, (), [("AP-1", "v", 50, "V12345", ())], rems


def test_switches_do_not_change_results(spark):
    frames = tables(spark, *crowd(40))
    read = lambda hot, listed: sorted(map(str, recon.line_context(*frames, hot_docs=hot, listed_names=listed).select("transaction_id", *recon.HIT_COLUMNS, "named_doc", "ref_doc").collect()))
    want = read(32, 16)
    assert want == read(0, 0) == read(10**9, 10**9)
    named = {r.transaction_id: r.named_n for r in recon.line_context(*frames).select("transaction_id", "named_n").collect()}
    assert (named["x"], named["y"], named["t1"]) == (1, 1, 0)


def test_generic_words_bring_no_pairs_together(spark):
    lines, sos, pos, rems = crowd(300)
    t, s, p, r = tables(spark, lines[:300], sos, pos, rems[:300])
    docs = matching.documents(s, p, r)
    names = matching.distinct_names(docs)
    context = matching.bank_lines(t).join(matching.name_lists(names), list(matching.AMOUNT_CLASS), "left")
    assert matching.crowded_pairs(context, names).count() < 0.01 * 300 * 300
