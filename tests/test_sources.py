from pyspark.sql import functions as F

from ledgerloom.sources import csv_records as csv
from ledgerloom.sources import landing
from ledgerloom.sources.sinks import csv_lines
from ledgerloom.streaming import incremental

BANK = 'Date,Description,Debit,Credit,CCY,Running Balance\r\n2026-08-01,"Rent, August",100.50,,EUR,900\r\n\r\n2/8/2026,"two\nlines ""x""",,20,,\r\nsoon,bad,1,,,\r\n28 Aug 2026,none,,,USD,(5.00)\r\n'


def test_records_number_rows_and_join_quoted_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(BANK.encode())
    rows = {r.row_number: r for r in csv.csv_records(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [2, 4, 5, 6]
    assert [rows[n].data_index for n in (2, 4, 5, 6)] == [1, 2, 3, 4]
    assert rows[2].record["description"] == "Rent, August"
    assert rows[4].record["description"] == 'two\nlines "x"'


def test_bank_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(BANK.encode())
    rec = csv.csv_records(spark, str(tmp_path)).withColumns({"statement_id": F.lit("S"), "account_id": F.lit("A")})
    rows = csv.bank_rows(rec, "GBP")
    got = {r.id: (r.date, r.amount, r.currency, r.balance_after) for r in csv.good(rows).collect()}
    assert got == {
        "S-L1": ("2026-08-01", -10050, "EUR", 90000), "S-L2": ("2026-08-02", 2000, "GBP", None), "S-L4": ("2026-08-28", 0, "USD", -500),
    }
    assert [r.error for r in csv.bad(rows).collect()] == ['Row 3: unparseable or missing date "soon"']


def test_statement_ingest_is_idempotent_and_reports_errors(spark, tmp_path):
    root = tmp_path / "bank"
    for name, body in {"ACC-1/x.csv": BANK, "ACC-9/y.csv": BANK, "ACC-1/empty.csv": "date,amount\n", "loose.csv": BANK}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body.encode())
    files = spark.createDataFrame([(k,) for k in ("ACC-1/x.csv", "ACC-9/y.csv", "ACC-1/empty.csv", "loose.csv")], "key string")
    accounts = spark.createDataFrame([("ACC-1", "CHF")], "id string, currency string")
    none = spark.createDataFrame([], "key string")
    statements, lines, errors = landing.ingest_statements(spark, str(root), landing.plan_statements(files, "", accounts, none))
    s = statements.collect()
    assert [(x.account_id, x.transaction_count, x.period_start, x.period_end) for x in s] == [("ACC-1", 3, "2026-08-01", "2026-08-28")]
    assert lines.filter("currency = 'CHF'").count() == 1
    assert {e.key for e in errors.collect()} == {"ACC-9/y.csv", "ACC-1/empty.csv", "loose.csv"}
    again = landing.plan_statements(files, "", accounts, statements.select(F.col("storage_key").alias("key")))
    assert again.filter("outcome = 'take'").select("key").collect()[0].key == "ACC-1/empty.csv"


def test_pick_files_prefers_pattern_then_last_listed(spark):
    files = spark.createDataFrame([("x/INV_Header_1.csv",), ("x/INV_Header_2.csv",), ("x/AP_INVOICE_HEADER.csv",)], "key string")
    got = {r.role: r.key for r in landing.pick_files(files).collect()}
    assert got["ap_header"] == "x/AP_INVOICE_HEADER.csv"


def test_csv_sink_quotes_only_where_needed(spark):
    df = spark.createDataFrame([("a", 'b,"c"', None)], "x string, y string, z string")
    assert csv_lines(df).collect()[0].value == 'a,"b,""c""",'


def test_stream_keeps_one_row_per_content(spark, tmp_path):
    src, table, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.txt").write_text("one")
    (src / "b.txt").write_text("one")
    run = lambda: incremental.run_available(incremental.document_stream(spark, str(src)), ckpt, incremental.append_new(table, "content_hash"))
    run()
    (src / "c.txt").write_text("two")
    (src / "d.txt").write_text("one")
    run()
    assert sorted(r.text for r in spark.read.parquet(table).collect()) == ["one", "two"]
