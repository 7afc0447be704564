"""Cases that once went wrong: gaps, quotes, scopes, caps, replays."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import doc_text as dt
from ledgerloom.operators import cash, documents, supplier_edits, suppliers
from ledgerloom.sources import csv_records as csv
from ledgerloom.sources import landing
from ledgerloom.streaming import incremental


def test_continuity_looks_past_gaps(spark):
    lines = spark.createDataFrame([("S", 1, 100, 900), ("S", 3, 50, 700), ("S", 4, 0, 700), ("T", 1, 5, 5)], "statement_id string, line_number int, amount bigint, balance_after bigint")
    got = sorted((r.line_number, r.expected_balance) for r in cash.continuity(lines).collect())
    assert got == [(1, 800), (3, 750)]


def test_unclosed_quote_goes_to_the_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,amount,description\n2026-01-01,1,a"b,c"d\n2026-01-02,2,"x ""y"""\n2026-01-03,3,it\'s 5" long\n2026-01-04,4,z\n')
    rows = {r.row_number: r.record for r in csv.csv_records(spark, str(tmp_path)).collect()}
    assert rows[2]["description"] == "ab,cd" and rows[3]["description"] == 'x "y"' and sorted(rows) == [2, 3]
    assert [(r.row_number, r.error) for r in csv.open_quotes(spark, str(tmp_path)).collect()] == [(4, "Row 4: a quote is not closed")]


def test_ingest_reads_only_what_the_plan_takes(spark, tmp_path):
    for name in ("A/x.csv", "A/y.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("date,amount\n2026-01-01,1\n")
    files = spark.createDataFrame([("A/x.csv",), ("A/y.csv",)], "key string")
    accounts = spark.createDataFrame([("A", "EUR")], "id string, currency string")
    plan = landing.plan_statements(files, "", accounts, spark.createDataFrame([("A/y.csv",)], "key string"))
    statements, lines, errors = landing.ingest_statements(spark, str(tmp_path), plan)
    assert [r.storage_key for r in statements.collect()] == ["A/x.csv"] and lines.count() == 1 and errors.count() == 0
    assert len(plan.first().statement_id) == 44


def test_only_the_first_label_of_a_line_is_cut_out(spark):
    df = spark.createDataFrame([(["start date 1 start date 2"],), (["Start date", "3"],)], "lines array<string>")
    got = [r[0] for r in df.select(dt.value_after_label(F.col("lines"), "start date", "[0-9a-z ]+")).collect()]
    assert got == ["1 start date 2", "3"]


def test_every_item_line_is_kept(spark):
    text = "Description Qty Amount\n" + "\n".join(f"Item number {i} £{i + 2}.00" for i in range(45)) + "\nSubtotal £9.00\nNot an item £8.00"
    docs = spark.createDataFrame([("D", "f.pdf", text)], "doc_id string, file_name string, text string")
    items = documents.invoice_fields(docs).first().line_items
    assert len(items) == 45 and (items[44].line_number, items[44].description, items[44].line_total) == (45, "Item number 44", 4600)
    assert len(documents.invoice_fields(docs, item_limit=40).first().line_items) == 40


def test_invoice_header_fields(spark):
    text = (
        "Acme Tools Ltd\nInvoice Number: INV-20045\nInvoice date: 3 Mar 2026\nDue Date: 02/04/2026\nPayment Terms: Net 30\nAccount number: 1234 5678 90\n"
        "Reference Number: AB-77881\nCustomer Number: C-9001\nOur VAT Number: GB123456789 ABN: 12 345 678 901\nIBAN: GB29NWBK60161331926819\nBIC: NWBKGB2L\n"
        "Description Qty Total\nWidget 2 £20.00\nSubtotal £20.00\nVAT @ 20 £4.00\nTotal £24.00\nwww.acme.co.uk"
    )
    r = documents.invoice_fields(spark.createDataFrame([("D", "f.pdf", text)], "doc_id string, file_name string, text string")).first()
    assert (r.invoice_number, r.invoice_date, r.due_date, r.payment_terms) == ("INV-20045", "2026-03-03", "2026-04-02", "Net 30")
    assert (r.account_number, r.reference_number, r.customer_number) == ("1234567890", "AB-77881", "C-9001")
    assert (r.supplier_vat, r.supplier_tax_id, r.supplier_name, r.currency) == ("GB123456789", "12345678901", "Acme Tools Ltd", "GBP")
    # white space goes before the bank account is searched, so the VAT number runs into "ABN" and no bank points are given
    assert (r.subtotal, r.tax_total, r.total, r.confidence, r.status, r.folder) == (2000, 400, 2400, 95, "parsed", "processed")
    assert [(i.description, i.line_total) for i in r.line_items] == [("Widget 2", 2000)]
    apart = text.replace("GB123456789 ABN: 12 345 678 901", "GB123456789.") + "\nABN: 12 345 678 901"
    r = documents.invoice_fields(spark.createDataFrame([("D", "f.pdf", apart)], "doc_id string, file_name string, text string")).first()
    assert (r.iban, r.bic, r.supplier_vat, r.supplier_tax_id, r.confidence) == ("GB29NWBK60161331926819", "NWBKGB2L", "GB123456789", "12345678901", 100)


def test_tax_id_is_eleven_digits(spark):
    df = spark.createDataFrame([("ABN: 12 345 678 901",), ("ABN 123456789012",), ("ABN 12345",)], "t string")
    assert [r[0] for r in df.select(dt.tax_id("t")).collect()] == ["12345678901", None, None]


def test_page_limits_are_refused_not_cut(spark):
    sites = spark.range(3).select(F.col("id").cast("string").alias("id"))
    assert suppliers.page(sites, 500).count() == 3 and suppliers.total(sites).first().total == 3
    for limit, offset in ((501, 0), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            suppliers.page(sites, limit, offset)
    with pytest.raises(ValueError):
        supplier_edits.newest(sites, 0)


def test_site_codes_made_equal_by_the_key_are_reported(spark):
    sites = spark.createDataFrame([("1", "WAREHOUSE NORTH A"), ("1", "Warehouse North B"), ("2", "HQ")], "supplier_number string, site_code string")
    assert [(r.key, r.codes) for r in suppliers.ambiguous_site_codes(sites).collect()] == [("1|WAREHOUSE NORTH", 2)]


def test_package_scope(spark):
    heads = spark.createDataFrame([("1", "N1"), ("2", "N2"), ("3", "N3"), ("4", "N4")], "id string, supplier_number string")
    sites = spark.createDataFrame([("1-a", "1", "HQ"), ("2-a", "2", "hq"), ("3-a", "3", "NEW"), ("4-a", "4", "HQ")], "id string, supplier_id string, site_code string")
    profiles = spark.createDataFrame([("1", "N1", 1), ("x", "N2", 2), ("3", "N3", 3)], "vid string, supplier_number string, row_number int")
    source = spark.createDataFrame([("1-a", "1", "HQ"), ("s", "x", "HQ"), ("4-a", "", "")], "sid string, vid string, supplier_site string")
    audit = spark.createDataFrame([("update", "site", "1-a"), ("update", "supplier", "*"), ("create", "site", "2-a")], "action string, record_type string, record_id string")
    run = lambda *how: {r.id: r.import_action for r in supplier_edits.in_scope(heads, sites, profiles, source, audit, *how).collect()}
    assert run("all") == {"1": "UPDATE", "2": "UPDATE", "3": "UPDATE", "4": "CREATE"}
    assert run("new") == {"3": "CREATE", "4": "CREATE"}
    assert run("changed") == {"1": "UPDATE", "3": "UPDATE", "4": "CREATE"}
    assert run("changed", "CREATE") == {"1": "CREATE", "3": "CREATE", "4": "CREATE"}


def test_append_new_keeps_the_first_by_path_and_survives_a_replay(spark, tmp_path):
    table = str(tmp_path / "t")
    write = incremental.append_new(table, "content_hash")
    batch = spark.createDataFrame([("b", "h1", "two"), ("a", "h1", "one"), ("c", "h2", "three")], "key string, content_hash string, text string")
    later = spark.createDataFrame([("d", "h1", "four"), ("e", "h3", "five")], "key string, content_hash string, text string")
    for number, rows in ((0, batch), (1, later), (1, later), (0, batch)):
        write(rows, number)
    assert sorted(r.text for r in spark.read.parquet(table).collect()) == ["five", "one", "three"]


def test_samples_count_only_while_nothing_is_real(spark):
    sample, real = spark.createDataFrame([("s",)], "x string"), spark.createDataFrame([("r",)], "x string")
    gate = lambda *flags: spark.createDataFrame([(f,) for f in flags], "has_real boolean")
    read = lambda g: sorted(r.x for r in landing.without_samples(sample, real, g).collect())
    assert read(gate(False, False)) == ["r", "s"] and read(gate(False, True)) == ["r"] and read(gate()) == ["r", "s"]
