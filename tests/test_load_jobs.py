"""Load jobs on literal files, package files and manifest, uploads, samples, search export, storage plan, position refresh."""

import json
import os

from pyspark.sql import functions as F

from ledgerloom.operators import details, import_package, search
from ledgerloom.sources import load_jobs, sinks
from ledgerloom.streaming import incremental


def write(root, files):
    for name, body in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", newline="") as f:
            f.write(body)


def test_reference_load_with_report_per_file(spark, tmp_path):
    root, target = str(tmp_path / "land ing"), str(tmp_path / "out")
    write(root, {
        "SO/sales_order_header_1.csv": "source_trans_num,byng_pty_nme,transal_crncy_code,trans_on\n9,Old,GBP,2026-01-01\n", "SO/sales_order_header_2.csv": "source_trans_num,sourcetransid,byng_pty_nme,transal_crncy_code,trans_on\n7,7,Acme,GBP,2026-01-01\n8,8,Beta,EUR,2026-01-02\n",
        "SO/charges_component.csv": "source_trans_id,price_element_code,charge_crncy_extended_amount\n7,QP_NET_PRICE,12.50\n7,OTHER,99\n", "PO/po_header.csv": 'po_number,vendor_name,country,amount,currency_code\n55,"V, Ltd",GB,10.00,GBP\n56,"open quote,GB,1\n',
        "PO/po_line_locations.csv": "po_number\n1\n", "INV/inv_header.txt": "x\n", "INV/ap_invoice_header.CSV": "invoice_id,invoice_number,invoice_amount,supplier_name,taxation_country,invoice_date\n3,V3,5.00,Acme,GB,2026-01-01\n",
    })
    report, errors, counts = load_jobs.load_reference(spark, root, {"ap": "INV/", "po": "PO/", "so": "SO/", "rem": "REM/"}, target)
    assert {(r.role, r.key, r.rows) for r in report.collect()} == {("so_header", "SO/sales_order_header_2.csv", 2), ("so_charge", "SO/charges_component.csv", 2), ("po_header", "PO/po_header.csv", 1), ("ap_header", "INV/ap_invoice_header.CSV", 1)}
    assert [(r.key, r.error) for r in errors.collect()] == [("PO/po_header.csv", "Row 3: a quote is not closed")]
    assert counts == {"sales_orders": 2, "purchase_orders": 2, "remittances": 0, "ap_invoices": 1}
    assert {(r.id, r.amount) for r in spark.read.parquet(f"{target}/sales_orders").collect()} >= {(r.id, r.amount) for r in spark.read.parquet(f"{target}/sales_orders").where("amount = 1250").collect()}
    assert spark.read.parquet(f"{target}/sales_orders").where("amount = 1250").count() == 1
    load_jobs.load_reference(spark, root, {"so": "SO/"}, target)  # a second load replaces the first
    assert spark.read.parquet(f"{target}/purchase_orders").count() == 0


def test_supplier_load_keeps_history_and_falls_back_to_samples(spark, tmp_path):
    root, sample, target = str(tmp_path / "in"), str(tmp_path / "sample"), str(tmp_path / "out")
    files = {"supplier_profile.csv": "vid,supplier_number,supplier_name\n1.00,N1,Acme\n", "supplier_site_x.csv": "vid,sid,supplier_site,address_name\n1,11,MAIN,HQ\n1,12,SIDE,HQ\n", "supplier_site_vat.csv": "vid,sid,supplier_vat\n1,11,GB1\n", "supplier_address.csv": "vid,address_name,city\n1,HQ,Leeds\n", "supplier_address_contact.csv": "vid\n1\n"}
    write(root, {"other/readme.txt": "x", **{f"sup/{n}": b for n, b in files.items()}})
    write(sample, files)
    report, errors, used = load_jobs.load_suppliers(spark, root, "sup/", target, "2026-01-01T00:00:00Z", sample)
    assert {(r.role, r.rows) for r in report.collect()} == {("profile", 1), ("site", 2), ("address", 1), ("vat", 1)} and errors.count() == 0 and not used
    assert [r.city for r in spark.read.parquet(f"{target}/supplier_sites").collect()] == ["Leeds", "Leeds"] and spark.read.parquet(f"{target}/suppliers").first().name == "Acme"
    assert load_jobs.load_suppliers(spark, root, "none/", target, "2026-01-02T00:00:00Z", sample)[2]
    events = spark.read.parquet(f"{target}/audit_events").orderBy("created_at").collect()
    assert [json.loads(e.new_value) for e in events] == [{"suppliers": 1, "sites": 2, "files": 4}] * 2 and {e.action for e in events} == {"ingest"}


def test_baseline_upload_and_samples(spark, tmp_path):
    root, target = str(tmp_path / "in"), str(tmp_path / "out")
    write(root, {"bank/A1/x.csv": "date,amount\n2026-08-01,5\n", "bank/ZZ/y.csv": "date,amount\n2026-08-01,5\n", "SO/so_header.csv": "source_trans_num,trans_on\n1,2026-01-01\n"})
    accounts = spark.createDataFrame([("A1", "CHF")], "id string, currency string")
    taken, errors, report = load_jobs.load_baseline(spark, root, "bank/", accounts, {"so": "SO/"}, target)
    assert [r.account_id for r in taken.collect()] == ["A1"] and [r.key for r in errors.collect()] == ["bank/ZZ/y.csv"] and report.count() == 1
    assert spark.read.parquet(f"{target}/bank_transactions").count() == 1
    write(root, {"up/u.csv": "Date,Amount\n2026-08-02,1.50\nnever,2\n2026-08-01,2\n", "up2/e.csv": "Date,Amount\n"})
    statement, lines, bad = load_jobs.uploaded_statement(spark, f"{root}/up/u.csv", "UP-1", "A1", "CHF", "2026-09-09", "2026-09-09T00:00:00Z")
    s = statement.first()
    assert (s.period_start, s.period_end, s.transaction_count, s.source, s.storage_key) == ("2026-08-01", "2026-08-02", 2, "upload", "statements/UP-1-u.csv")
    assert {r.currency for r in lines.collect()} == {"CHF"} and [r.error for r in bad.collect()] == ['Row 2: unparseable or missing date "never"']
    assert load_jobs.uploaded_statement(spark, f"{root}/up2/e.csv", "UP-2", "A1", "CHF", "2026-09-09", "t")[0].first().period_start == "2026-09-09"
    write(root, {"s/accounts.json": '[{"id": "A", "openingBalance": 250000.5}]', "s/sales-orders.json": '[{"id": "SO-1", "amount": 0.1, "orderDate": "2026-01-01"}]'})
    assert load_jobs.read_samples(spark, f"{root}/s", "accounts").first().opening_balance == 25000050
    assert load_jobs.read_samples(spark, f"{root}/s", "sales-orders").select("id", "amount", "order_date").first() == ("SO-1", 10, "2026-01-01")
    real, none = (spark.createDataFrame(x, "source string") for x in ([("oci",), ("sample",)], [("upload",)]))
    seed, own = spark.createDataFrame([("A", 1), ("B", 1)], "id string, v int"), spark.createDataFrame([("B", 2)], "id string, v int")
    merged = lambda st: sorted(map(tuple, load_jobs.merged_accounts(seed, own, st).collect()))
    assert merged(real) == [("B", 2)] and merged(none) == [("A", 1), ("B", 2)]
    pick = lambda so, po: {n: df.count() for n, df in load_jobs.supporting_documents({"so": seed, "po": seed}, {"so": so, "po": po}).items()}
    empty = own.where("false")
    assert pick(empty, empty) == {"so": 2, "po": 2} and pick(empty, own) == {"so": 0, "po": 1}


def test_package_is_saved_and_listed(spark, tmp_path):
    text = lambda names: ", ".join(f"{n} string" for n in names)
    suppliers = spark.createDataFrame([("1", "SN1", "Acme, Ltd", "CORP", "active", "EL094259216", "", "", False, None), ("2", "", "New", "", "active", "", "", "", True, "2024-01-31")],
                                      text(("id", "supplier_number", "name", "type", "status", "supplier_vat", "tax_registration_number", "taxpayer_id")) + ", one_time boolean, inactive_date string")
    sites = spark.createDataFrame([("1-1", "1", "MAIN", "HQ", "BU", None, "30", "G", "EFT", "EUR", "EUR", "GR", "1 St", "Athens", "1000", ""), ("2-1", "2", "X", "", "BU", None, "", "", "", "", "", "", "", "", "", "")],
                                  text(("id", "supplier_id", "site_code", "address_name", "procurement_bu", "inactive_date", "payment_terms", "pay_group", "payment_method", "invoice_currency", "payment_currency", "country", "address_line1", "city", "postal_code", "site_vat")))
    audit = spark.createDataFrame([], "record_type string, record_id string, action string")
    profiles = spark.createDataFrame([("1", "N1", "Acme", "alias-cell", "odd", 1)], "vid string, supplier_number string, supplier_name string, alias string, never_heard_of string, row_number int")
    source_sites = spark.createDataFrame([("1", "1-1", "Main", "n", 1)], "vid string, sid string, supplier_site string, purchasing string, row_number int")
    addresses = spark.createDataFrame([("1", "other", "GB", 1)], "vid string, address_name string, country string, row_number int")
    package = import_package.build_package(suppliers, sites, audit, profiles, source_sites, addresses, "B-9")
    heads = {r["id"]: r for r in package.sheets["suppliers"].collect()}
    assert (heads["1"]["Taxpayer Country"], heads["1"]["Alias"], heads["1"]["Import Action"], heads["2"]["Import Action"], heads["2"]["Inactive Date"], heads["2"]["One Time Supplier Flag"]) == ("GR", "alias-cell", "UPDATE", "CREATE", "2024/01/31", "Y")
    places = {r["id"]: r for r in package.sheets["sites"].collect()}
    assert (places["1-1"]["Purchasing"], places["2-1"]["Payment Priority"], places["2-1"]["Address Name"]) == ("N", "99", "X")
    assert [len(df.columns) - 1 for df in package.sheets.values()] == [43, 30, 55, 11]
    manifest = sinks.save_package(package, str(tmp_path), "2026-01-05T00:00:00Z", " jo ")
    folder = f"{tmp_path}/B-9"
    lines = spark.read.text(f"{folder}/POZ_SUPPLIERS_INT.csv/rows").count()
    assert manifest["counts"] == {"suppliers": 2, "addresses": 2, "sites": 2, "assignments": 2, "overlayed": 3, "synthesized": 3} and lines == 2 and manifest["overlayCount"] == package.overlays.count()
    assert spark.read.text(f"{folder}/POZ_SUPPLIERS_INT.csv/header").first()[0].startswith("Import Action,Batch ID,Supplier Name") and '"Acme, Ltd"' in spark.read.text(f"{folder}/POZ_SUPPLIERS_INT.csv/rows").agg(F.max("value")).first()[0]
    files = spark.createDataFrame([("p/B-9/a.csv", 3, "2026-02-01"), ("p/B-9/manifest.json", 1, "2026-02-01"), ("p/B-8/a.csv", 2, "2026-01-20"), ("p/loose.zip", 1, "2026-03-01")], "key string, size bigint, last_modified string")
    manifests = spark.read.text(f"{folder}/manifest.json").select(F.lit("p/B-9/manifest.json").alias("key"), F.col("value").alias("content"))
    got = [(r.batch, r.created_at, r.actor, r.counts["sites"] if r.counts else None, len(r.files)) for r in import_package.list_packages(files, manifests, "p").orderBy("rank").collect()]
    assert got == [("B-8", "2026-01-20", None, None, 1), ("B-9", "2026-01-05T00:00:00Z", "jo", 2, 2)]


def test_search_and_its_export(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.pdf", "processed", True, " One needle in " + "hay " * 300), (2, "b.pdf", "anomaly", None, None), (3, "needle.pdf", "processed", False, "x" * 3000)], "doc_id bigint, file_name string, folder string, auto_renew boolean, text string")
    fields = spark.createDataFrame([(2, "entity", "Entity", "Needle & Co", 80)], "doc_id bigint, key string, label string, value string, confidence int")
    ids = lambda word, **how: sorted(r.doc_id for r in search.matching(docs, fields, word, **how).collect())
    assert (ids(" NEEDLE "), ids("yes true"), ids("no false"), ids(None), ids("zzz"), ids("needle", folder="processed")) == ([1, 2, 3], [1], [3], [1, 2, 3], [], [1, 3])
    folder, n = search.save_export(search.matching(docs, fields, "needle"), "needle", "2026-01-02T00:00:00Z", str(tmp_path))
    rows = {r.id: r for r in spark.read.json(f"{folder}/docs").collect()}
    assert n == 3 and folder.endswith("people-docs-needle-2026-01-02.json") and spark.read.json(f"{folder}/head").first().matchCount == 3
    assert rows[1].text_excerpt.startswith("One needle") and rows[1].text_excerpt.endswith("…") and len(rows[1].text_excerpt) == 4 + 6 + 400 + 1 and len(rows[3].text_excerpt) == 2001 and "storage_key" not in rows[1]


def test_regroup_plan(spark):
    objects = spark.createDataFrame([("d/processed/1/a.pdf", 1, "2024-03-05T10:00:00Z"), ("d/anomaly/2/a.pdf", 1, "2024-03-05T10:00:00Z"), ("d/processed/3/a.pdf", 1, "2024-03-05T11:00:00Z"), ("d/processed/05-03-2024/b.pdf", 1, "x"), ("d/processed/b.pdf", 0, "2024-03-05T10:00:00Z"),
                                     ("d/processed/31-02-2024/c.pdf", 1, "2024-03-05T10:00:00Z"), ("d/archived/x", 0, "x"), ("d/landing/z.pdf", 1, "x")], "key string, size bigint, last_modified string")
    docs = spark.createDataFrame([("D3", "d/processed/3/a.pdf", "processed", "a.pdf", "2024-03-05T23:00:00Z"), ("D2", "d/anomaly/2/a.pdf", "processed", None, None)], "doc_id string, storage_key string, folder string, file_name string, processed_at string")
    got = {r.key: (r.to or r.reason) for r in details.regroup_plan(objects, docs, "d").collect()}
    assert got == {
        "d/processed/1/a.pdf": "d/processed/05-03-2024/a.pdf", "d/anomaly/2/a.pdf": "d/processed/05-03-2024/a__D2.pdf", "d/processed/3/a.pdf": "d/processed/05-03-2024/a__D3.pdf", "d/processed/05-03-2024/b.pdf": details.GROUPED,
        "d/processed/b.pdf": "d/processed/05-03-2024/b__b.pdf.pdf", "d/processed/31-02-2024/c.pdf": "d/processed/05-03-2024/c.pdf", "d/archived/x": details.MARKER, "d/landing/z.pdf": details.OUTSIDE,
    }


def test_vat_checks(spark):
    suppliers = spark.createDataFrame([("1", "Acme NV", "BE0000010589")], "id string, name string, supplier_vat string")
    sites = spark.createDataFrame([("1-1", "1", "", "BE", "Main St 1", "Gent", "9000"), ("1-2", "1", "BE0000010589", "BE", "Main St 1", "Gent", "9000")], "id string, supplier_id string, site_vat string, country string, address_line1 string, city string, postal_code string")
    registry = spark.createDataFrame([("BE", "0000010589", True, "ACME", "Main St 1 9000 Gent")], "country_code string, vat_number string, valid boolean, registered_name string, registered_address string")
    got = {r.site_id: r for r in details.vat_check_results(sites, suppliers, registry, "site", " ", "t").collect()}
    assert (got["1-1"].validity, got["1-1"].country_code, got["1-2"].validity, got["1-2"].name_match, got["1-2"].address_match, got["1-2"].actor) == ("unsupported", "BE", "valid", "match", "match", "operator")
    assert {r.validity for r in details.vat_check_results(sites, suppliers, registry, "supplier", "jo", "t").collect()} == {"valid"}
    assert {(r.site_id, r.batch) for r in details.check_batches(sites, suppliers, 1).collect()} == {("1-1", 1), ("1-2", 2)}


def test_statement_stream_refreshes_touched_partitions(spark, tmp_path):
    root, table, ckpt = str(tmp_path / "bank"), str(tmp_path / "tables"), str(tmp_path / "ck")
    accounts = spark.createDataFrame([("A1", "One", "B", "EUR", 100), ("A2", "Two", "B", "USD", 0)], "id string, name string, bank string, currency string, opening_balance bigint")
    run = lambda: incremental.ingest_statement_stream(spark, root, ckpt, accounts, table)
    write(root, {"A1/x.csv": "date,amount,currency\n2026-08-01,5,EUR\n", "ZZ/y.csv": "date,amount\n2026-08-01,5\n", "A2/u.csv": "date,amount,currency\n2026-08-01,7,USD\n"})
    run()
    closing = lambda: {r.currency: r.closing_balance for r in spark.read.parquet(f"{table}/positions").collect()}
    assert closing() == {"EUR": 600, "USD": 700}
    before = {f for f in os.listdir(f"{table}/positions/currency=USD") if f.endswith(".parquet")}
    write(root, {"A1/z.csv": "date,amount,currency\n2026-08-02,1,EUR\n"})
    run()
    assert closing() == {"EUR": 700, "USD": 700} and {f for f in os.listdir(f"{table}/positions/currency=USD") if f.endswith(".parquet")} == before
    lines = spark.read.parquet(f"{table}/bank_transactions").count()
    incremental.replay_batch(spark, root, accounts, table, spark.createDataFrame([("A1/z.csv",)], "key string"), 1)  # the last batch once more
    assert lines == spark.read.parquet(f"{table}/bank_transactions").count() == 3 and closing() == {"EUR": 700, "USD": 700}
    assert {r.key for r in spark.read.parquet(f"{table}/ingest_errors").collect()} == {"ZZ/y.csv"}
