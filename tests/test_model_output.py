"""Model output: shapes, faults in order, grounding, precedence of the extractor, parts and back."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import doc_text as dt
from ledgerloom.operators import details, documents
from ledgerloom.operators import model_output as mo

GOOD = {"vendor": "generic", "confidence": 90, "header": {"invoiceNumber": "INV-1"}, "lineItems": [], "taxLines": [], "fields": [], "warnings": [], "reviewReasons": []}
TEXT = "Acme Tools Ltd\nOrder 77-12 for Wayne Enterprises\nUSD 189.00\nTotal 189.00 USD\nABC 12345"


def validated(spark, *outputs):
    rows = [(i, o if o is None or isinstance(o, str) else json.dumps(o)) for i, o in enumerate(outputs)]
    return mo.validate_invoice_output(spark.createDataFrame(rows, "doc_id bigint, output string"))


@pytest.mark.parametrize("output, error", [
    (None, "LLM output is not a JSON object"), ("", "LLM output is not a JSON object"), ("{", "LLM output is not a JSON object"), ("[]", "LLM output is not a JSON object"), ('"x"', "LLM output is not a JSON object"),
    ({**GOOD, "confidence": None}, "confidence is required"), ({**GOOD, "confidence": "9"}, "confidence must be a number; confidence is required"), ({**GOOD, "header": 5}, "header must be an object"),
    ({**GOOD, "header": {"total": []}}, "header.total must be a number"), ({**GOOD, "lineItems": {}}, "lineItems must be an array"), ({**GOOD, "lineItems": [{"lineNumber": 1}]}, "lineItems[0].description is required"),
    ({**GOOD, "lineItems": [{"description": "x", "extra": {"b": 1, "a": "s"}}]}, "lineItems[0].extra.b must be a string"), ({**GOOD, "bank": "x"}, "bank must be an object"),
    ({**GOOD, "fields": [{"category": "nope"}]}, "fields[0].category is invalid"), ({**GOOD, "fields": [{"category": "tax", "key": "k"}]}, "fields[0] needs key and value"),
    ({**GOOD, "warnings": "w"}, "warnings must be an array of strings"), ({**GOOD, "reviewReasons": ["a", 1]}, "reviewReasons[1] must be a string"), (GOOD, None),
])
def test_faults(spark, output, error):
    row = validated(spark, output).first()
    assert (row.ok, row.error) == (error is None, error) and (row.header is None) == (error is not None)


def test_values_are_read(spark):
    row = validated(spark, {**GOOD, "confidence": 140, "header": {"subtotal": 189, "total": 189.5, "amountDue": "$1,234.56", "taxTotal": "", "currency": " usd ", "supplierName": 7}, "unknown": 1, "bank": {"iban": " X ", "extra": {"a": "b"}},
                            "lineItems": [{"description": " A ", "quantity": 1.5, "unitPrice": 2.25}, {"lineNumber": 9, "description": "B", "lineTotal": "(5.00)"}], "warnings": [" w ", ""]}).first()
    h = row.header
    assert (h.subtotal, h.total, h.amount_due, h.tax_total, h.currency, h.supplier_name, row.model_confidence) == (189, 18950, 123456, None, "USD", None, 100)
    assert [(i.line_number, i.description, i.quantity, i.unit_price, i.line_total) for i in row.line_items] == [(1, "A", 1.5, 225, None), (9, "B", None, None, -500)]
    assert (row.bank.iban, row.bank.extra, row.warnings, row.tax_lines) == ("X", {"a": "b"}, ["w"], [])
    assert [validated(spark, {**GOOD, "bank": b}).first().bank for b in (None, {}, {"iban": " "})] == [None, None, None]


@pytest.mark.parametrize("value, want", [("wayne  enterprises", True), ("Wayne Enterprises", True), ("7712", True), ("712", False), ("x", False), ("", False), ("77 12", True), ("Nobody", False)])
def test_grounded(spark, value, want):
    assert spark.range(1).select(dt.grounded(F.lit(value), F.lit(TEXT))).first()[0] is want


def test_synopsis(spark):
    source = "Some agreement between two parties about services rendered in the year."
    cases = {"short": None, "An overview: fees of 1,000 a year.": "An overview: fees of 1,000 a year.", f"  {source.upper()} ": None, source[:60]: None, "word " * 1000: ("word " * 800).strip()}
    got = {r.s: r.v for r in spark.createDataFrame([(c,) for c in cases], "s string").select("s", dt.synopsis("s", F.lit(source)).alias("v")).collect()}
    assert got == cases


def test_overlay_fills_gaps_only(spark):
    texts = [(0, "a.pdf", TEXT), (1, "b.pdf", TEXT), (2, "c.pdf", TEXT), (3, "d.pdf", "")]
    static = documents.invoice_fields(spark.createDataFrame(texts, "doc_id bigint, file_name string, text string"))
    said = {**GOOD, "header": {"invoiceNumber": "ABC-12345", "invoiceDate": "3 Mar 2026", "total": 99900, "amountDue": 189, "supplierName": "Other Ltd", "customerName": "wayne enterprises", "poNumber": "NOT THERE", "currency": "eur"},
            "taxLines": [{"label": "VAT", "taxAmount": 1.5}], "fields": [{"category": "site", "key": "m", "value": "1", "confidence": 5}], "warnings": ["Totals were not classified."], "reviewReasons": ["look"]}
    out = {r.doc_id: r for r in mo.overlay_invoice(static, validated(spark, said, "{").union(validated(spark, *["{"] * 3, said).where("doc_id = 3"))).collect()}
    h = out[0].header
    assert (h.invoice_number, h.invoice_date, h.total, h.amount_due, h.supplier_name, h.customer_name, h.po_number, h.currency) == ("ABC-12345", "2026-03-03", 18900, 18900, "Acme Tools Ltd", "wayne enterprises", None, "USD")
    assert (out[0].mode, [t.label for t in out[0].tax_lines], out[0].reasons[-1]) == ("llm", ["VAT"], "look") and "Totals were not classified." not in out[0].warnings
    assert (out[1].mode, out[1].classifier_warning) == ("static-fallback", "LLM output failed schema validation (LLM output is not a JSON object). Using static parser.")
    assert (out[2].mode, out[2].classifier_warning, out[3].mode, out[3].status) == ("static", None, "static", "anomaly")


def test_parts_and_back(spark):
    static = documents.invoice_fields(spark.createDataFrame([(i, "f", TEXT) for i in range(4)], "doc_id bigint, file_name string, text string"))
    lines = [{"description": f"L{n}", "lineNumber": 50 - n, "extra": {"k": "v"} if n % 2 else None} for n in range(40)]
    records = mo.overlay_invoice(static, validated(spark, {**GOOD, "lineItems": lines, "taxLines": [{"label": "a"}, {"label": "a"}]}, GOOD)).withColumn("fields", F.when(F.col("doc_id") < 3, F.col("fields")))
    tables = details.explode_parts(records)
    back = details.rebuild(tables).select(*records.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, records.collect())) and tables["tax_lines"].count() == 2


def test_agreements(spark):
    docs = documents.people_fields(spark.createDataFrame([(0, "nda.pdf", "Confidentiality terms with Acme Ltd\nStart date: 2020-01-01\nThis runs until terminated"), (1, "x.pdf", "text")], "doc_id bigint, file_name string, text string"))
    said = {"confidence": 70, "header": {"agreementId": "AG-1", "agreementType": "NDA", "contractingEntity": "Acme Ltd", "startDate": "1 Feb 2021", "autoRenew": "yes", "perpetual": True}, "warnings": ["w"], "reviewReasons": [], "synopsis": "A secrecy agreement without an end."}
    rows = spark.createDataFrame([(0, json.dumps(said)), (1, '{"confidence": 5, "header": {"autoRenew": 7}}')], "doc_id bigint, output string")
    out = {r.doc_id: r for r in mo.overlay_people(docs, mo.validate_people_output(rows)).collect()}
    a = out[0]
    assert (a.mode, a.agreement_id, a.agreement_type, a.entity, a.start_date, a.auto_renew, a.perpetual, a.synopsis) == ("llm", None, a.agreement_type, "Acme Ltd", "2020-01-01", None, True, "A secrecy agreement without an end.")
    assert out[1].mode == "static-fallback" and "header.autoRenew must be a boolean" in out[1].classifier_warning


def test_readers_ask_for_a_type_once(spark):
    from ledgerloom.functions import json_values as js

    v, name = F.parse_json(F.lit("1.5")), F.lit("x")
    for read, most in ((js.money_of, 1), (js.number_of, 1), (js.boolean_of, 1), (js.integer_of, 2)):  # a number that is no integer is looked at again
        assert str(read(v, name)).count("schema_of_variant") <= most
    said = ["7", "1.5", "\"£1,200.50\"", "\"\"", "null", "\"x\"", "true", "[1]", None]
    read = lambda f: [(r.r.value, r.r.error) for r in spark.createDataFrame([(t,) for t in said], "t string").select(f(F.parse_json("t"), name).alias("r")).collect()]
    bad = (None, "x must be a number")
    assert read(js.money_of) == [(7, None), (150, None), (120050, None), (None, None), (None, None), bad, bad, bad, (None, None)]
    assert read(js.integer_of) == [(7, None), (None, "x must be an integer"), bad, (None, None), (None, None), bad, bad, bad, (None, None)]
