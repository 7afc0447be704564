"""Invoice and agreement fields from document text, with score, status and folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import doc_text as dt
from ..functions.bind import let
from ..functions.money import strip

# Line kinds on an invoice, label and value patterns of each document kind, review texts.
SUBTOTAL = r"(?i)^(?:sub[\s-]?total)\b"
TAX = r"(?i)^(?:total\s+)?(?:gst|vat|tax)(?:\s*@\s*[\d.]+)?\b"
TAX_SIGN = r"(?i)\$|AUD|USD|EUR|GST|VAT"
TOTAL = r"(?i)^(?:invoice\s+)?(?:grand\s+)?total(?:\s+amount)?(?:\s*\([^)]+\))?(?:\s+due)?\b"
SKIP = r"(?i)page \d+|continued|need to get in touch|how to pay"
AMOUNT_DUE = r"(?i)total amount due|amount due|total amount"
ITEM_HEADER_COLUMNS = r"(?i)(qty|quantity|price|amount|total|gst|vat)"
NOT_ITEMS = r"(?i)opening balance|payments received|balance carried|amount due|total amount"
TRAILING_MONEY = r"(?i)\(?(?:[$£€]\s*)?-?\d{1,3}(?:,\d{3})*(?:\.\d{1,4})?\)?(?:\s*CR)?$"
COMPANY = r"(?i)(pty ltd|limited|ltd|inc\.|llc|gmbh|s\.a\.|energy|motors)"
WEBSITE = r"(?i)\b((?:www\.)?[a-z0-9.-]+\.[a-z]{2,})\/?\b"
DATE_VALUE = "[0-9A-Za-z/, -]{6,20}"
SUPPLIER_VALUE = "[A-Za-z][A-Za-z0-9 .,&-]{2,60}"
INVOICE_LABELS = {
    "invoice_number": (
        (r"Invoice Number|Invoice No\.?|Invoice #", "[A-Z0-9][A-Z0-9/.-]{4,30}"), ("Tax Invoice(?: Number)?", r"\d[\d\s]{6,}"), ("Invoice", r"\d{5,}"),
    ),
    "issued": (("Invoice date|Date Issued|Issue date|Invoice Date|Date of Event", DATE_VALUE),),
    "issued_line": (("Date Issued|Invoice date|Issue date", ".+"),),
    "due": (("Due Date|DUE DATE|Payment due|Pay by", DATE_VALUE),),
    "terms": (("Payment Terms|Terms", r"Net\s*\d+|COD|Due on receipt|[A-Za-z0-9 ]{3,40}"),),
    "po_number": (("PO Number|Purchase Order|Customer PO|Order Number", "[A-Z0-9-]{3,24}"),),
    "account_number": ((r"Account number|Account No\.?", r"[0-9][0-9\s]{6,}"),),
    "reference_number": (("Reference Number|Reference", "[A-Za-z0-9-]{6,}"),),
    "customer_number": ((r"Customer Number|Customer No\.?", "[A-Z0-9-]{4,}"),),
    "named": (("Supplier Name|Vendor Name|Supplier", SUPPLIER_VALUE),),
}
AGREEMENT_TYPES = (
    "Employment", "Contractor", "Consultancy", "NDA", "Non-Disclosure", "Policy", "Offer Letter", "Secondment",
    "Collective Agreement", "Confidentiality", "Internship", "Assignment",
)
YES_NO = "Yes|No|True|False|Y|N"
# label on the line of the value, value, label above the value ("" where only the line itself counts)
PEOPLE_LABELS = {
    "id": (r"Agreement ID|Agreement Number|Agreement No\.?|Contract Number|Document ID", "[A-Z0-9][A-Z0-9/._-]{3,30}", r"agreement\s+(?:id|number|no\.?)"),
    "requestor": ("Requestor|Requester|Requested by", "[A-Za-z][A-Za-z .,'-]{2,60}", "requestor|requester|requested by"),
    "kind": ("Agreement Type|Contract Type|Document Type", "[A-Za-z][A-Za-z /-]{2,40}", ""),
    "agreement_sub_type": ("Agreement Sub[- ]?type|Sub[- ]?type|Subtype", "[A-Za-z][A-Za-z0-9 /-]{2,60}", "sub[- ]?type"),
    "business_function": ("Business Function|Business Unit|Function", "[A-Za-z][A-Za-z0-9 &/-]{2,60}", "business function|business unit"),
    "entity": ("Contracting Entity|Legal Entity", "[A-Za-z][A-Za-z .,&-]{2,60}", ""),
    "start": ("Agreement start date|Start date|Effective date|Commencement date", "[0-9A-Za-z/, -]{6,24}", "start date|effective date|commencement"),
    "end": ("Agreement end date|End date|Expiry date|Expiration date|Termination date", "[0-9A-Za-z/, -]{6,24}", "end date|expiry date|expiration"),
    "renew": ("Auto[- ]?renew|Automatic renewal|Renews automatically", YES_NO, "auto[- ]?renew|automatic renewal"),
    "perpetual": ("Perpetual(?: term)?", YES_NO, "perpetual"),
}
NO_TEXT = "No extractable text — document may be scanned or image-only."
LOW = "Parse confidence is below the review threshold."


def _first(lines: Column, test) -> Column:
    return F.get(F.filter(lines, test), F.lit(0))


def line_facts(lines: Column) -> Column:
    """What each line of an invoice is, worked out once: kinds, last amount, text without it."""

    def facts(line: Column) -> Column:
        amount = F.when(line.rlike(r"\d"), dt.last_money(line))
        return F.struct(
            line.alias("line"), line.rlike(SUBTOTAL).alias("subtotal"), line.rlike(TAX).alias("tax"), line.rlike(TOTAL).alias("total"),
            amount.alias("amount"), (F.lower(line).contains("description") & line.rlike(ITEM_HEADER_COLUMNS)).alias("heads"),
        )

    return F.transform(lines, facts)


def line_items(facts: Column, limit: int | None = None) -> Column:
    """Item lines of an invoice: after the column heads, up to the first total that follows an item.

    All items are kept; ``limit`` cuts the list where a caller wants only the first ones.
    """

    def marked(f: Column) -> Column:
        skipped, closing = f["line"].rlike(SKIP), f["subtotal"] | f["total"] | f["tax"]
        about = F.when(
            ~skipped & ~closing & (F.abs(f["amount"]) >= 1) & ~f["line"].rlike(NOT_ITEMS),
            strip(F.regexp_replace(f["line"], TRAILING_MONEY, "")),
        )
        return let(about, lambda d: F.struct((closing & ~skipped).alias("closes"), (F.length(d) >= 3).alias("item"), d.alias("description"), f["amount"].alias("amount")))

    def picked(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda r: r["item"]), F.lit(True))
        ends = F.filter(F.transform(rows, lambda r, i: F.when(r["closes"], i + 1)), lambda i: i > first)
        upto = F.when(first == 0, 0).otherwise(F.coalesce(F.get(ends, F.lit(0)) - 1, F.size(rows)))
        return F.filter(F.slice(rows, F.lit(1), upto.cast("int")), lambda r: r["item"])

    start = F.coalesce(F.array_position(F.transform(facts, lambda f: f["heads"]), F.lit(True)), F.lit(0)).cast("int") + 1
    body = F.transform(F.slice(facts, start, F.greatest(F.size(facts), F.lit(1))), marked)
    items = let(body, picked)
    if limit is not None:
        items = F.slice(items, 1, limit)
    return F.transform(items, lambda r, i: F.struct((i + 1).cast("int").alias("line_number"), r["description"].alias("description"), r["amount"].alias("line_total")))


def invoice_fields(docs: DataFrame, vendor_rules: dict[str, tuple[str, ...]] | None = None, item_limit: int | None = None) -> DataFrame:
    """Invoice header, bank details, item lines, score, status and folder.

    ``docs``: ``doc_id, file_name, text``. ``vendor_rules`` maps a vendor profile to keywords; sample-specific overlays
    are not reproduced. ``item_limit`` keeps only the first items of a document; by default all are kept.
    """
    t = F.col("text")
    d = docs.withColumn("lines", dt.lines_of("text"))
    vendor = F.lit("generic")
    hay = F.lower(F.concat_ws("\n", "file_name", "text"))
    for name, words in reversed(list((vendor_rules or {}).items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | hay.contains(w.lower())
        vendor = F.when(hit, name).otherwise(vendor)
    raw = {f"_{name}": F.coalesce(*(dt.labelled(t, labels, value) for labels, value in choices)) for name, choices in INVOICE_LABELS.items()}
    # two steps: the optimiser keeps them apart, as each value of the first is used more than once in the second
    d = d.withColumns({"vendor": vendor, "_facts": line_facts(F.col("lines")), **raw})
    facts = F.col("_facts")
    guess = _first(facts, lambda f: f["line"].rlike(COMPANY) & ~F.split(f["line"], " ")[0].contains(":"))["line"]
    guess = let(guess, lambda g: F.when((F.length(g) < 80) & ~g.rlike(r"(?i)^supplier\s+name:"), g))
    supplier = F.coalesce(F.when(~F.col("_named").rlike("(?i)^(name|address|vat|total)$"), F.col("_named")), guess)
    nonzero = lambda c: let(F.abs(c["amount"]), lambda v: F.when(v != 0, v))
    total = F.coalesce(_first(facts, lambda f: f["line"].rlike(AMOUNT_DUE)), _first(facts, lambda f: f["total"] & f["amount"].isNotNull()))
    d = d.withColumns({
        "invoice_number": dt.squeeze("_invoice_number"),
        "invoice_date": F.coalesce(dt.document_date("_issued"), dt.first_date("_issued_line")), "due_date": dt.document_date("_due"),
        "payment_terms": F.when(~F.col("_terms").rlike(r"(?i)net\s*$"), F.col("_terms")), "po_number": F.col("_po_number"),
        "account_number": let(dt.digits_only("_account_number"), lambda v: F.when(v != "", v)),
        "reference_number": F.col("_reference_number"), "customer_number": F.col("_customer_number"),
        "currency": dt.detect_currency("text"), "supplier_vat": dt.vat_number("text"), "supplier_tax_id": dt.tax_id("text"), "supplier_website": dt.found(t, WEBSITE),
        "iban": dt.iban("text"), "bic": dt.bic("text"), "bsb": dt.found(t, dt.BSB),
        "subtotal": _first(facts, lambda f: f["subtotal"])["amount"], "tax_total": nonzero(_first(facts, lambda f: f["tax"] & f["line"].rlike(TAX_SIGN))), "total": nonzero(total),
        "supplier_name": let(supplier, lambda n: F.when(n.contains(":"), strip(F.regexp_replace(n, r"^[^:]+:\s*", ""))).otherwise(n)),
        "line_items": line_items(facts, item_limit),
    }).drop("_facts", *raw)
    return with_invoice_status(d)


def _points(*pairs: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for test, n in pairs:
        total = total + F.when(test, n).otherwise(0)
    return F.least(total, F.lit(100))


def with_invoice_status(d: DataFrame) -> DataFrame:
    has = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    bank = has("iban")
    for name in ("biller_code", "bank_account_number"):  # a vendor overlay or a model's output may add them
        bank = bank | has(name) if name in d.columns else bank
    empty = (F.size("lines") == 0) | (strip("text") == "")
    score = _points(
        (has("invoice_number"), 20), (has("invoice_date"), 15), (has("supplier_name"), 15), (F.col("total").isNotNull(), 20), (has("due_date"), 5),
        (F.col("tax_total").isNotNull(), 8), (F.size("line_items") > 0, 12), (bank, 5),
    )
    d = d.withColumns({"is_empty": empty, "confidence": F.when(empty, 0).otherwise(score)})
    no_number, no_total = ~has("invoice_number"), F.col("total").isNull()
    reasons = F.when(F.col("is_empty"), F.array(F.lit(NO_TEXT))).otherwise(F.array_compact(F.array(
        F.when(no_number & no_total, "Missing invoice number and totals.").when(no_number, "Invoice number was not classified.").when(no_total, "Totals were not classified."),
        F.when(~has("supplier_name"), "Supplier name was not classified."),
        F.when(~has("currency"), "Currency was not classified.").when(~F.upper("currency").isin(*dt.CURRENCIES), "Unknown or ambiguous currency."),
        F.when(F.col("confidence") < 40, LOW),
    )))
    return with_status(d.withColumn("reasons", reasons), no_number)


def with_status(d: DataFrame, no_id: Column) -> DataFrame:
    """Status from reasons and confidence, then whether a person must confirm, then the folder."""
    any_reason, sure = F.size("reasons") > 0, F.col("confidence")
    status = (
        F.when(F.col("is_empty") | (any_reason & ((sure < 55) | no_id)), "anomaly").when(any_reason | (sure < 80), "partial").otherwise("parsed")
    )
    d = d.withColumn("status", status).withColumn("needs_confirm", F.col("status") != "parsed")
    return d.withColumn("folder", F.when(F.col("needs_confirm"), "anomaly").otherwise("processed")).drop("is_empty")


def yes_no(c: Column) -> Column:
    return let(strip(c), lambda v: F.when(v.rlike(r"(?i)^(yes|true|y|1)\b"), True).when(v.rlike(r"(?i)^(no|false|n|0)\b"), False))


def agreement_id(c: Column) -> Column:
    common = r"(?i)^(the|this|that|each|and|for|from|with|under|into)\b"
    return let(dt.squeeze(c), lambda v: F.when(F.length(v).between(4, 40) & v.rlike(r"\d") & ~v.rlike(common), v))


def _known(text: Column, values) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return let(F.lower(text), lambda low: F.coalesce(*[F.when(low.contains(v.lower()), v) for v in values]))


def people_fields(docs: DataFrame, entities: tuple[str, ...] = ()) -> DataFrame:
    """Agreement fields, score, status and folder. ``entities`` are the known contracting entities."""
    t, lines = F.col("text"), F.col("lines")
    d = docs.withColumn("lines", dt.lines_of("text"))

    def value(name: str) -> Column:
        labels, pattern, above = PEOPLE_LABELS[name]
        here = dt.labelled(t, labels, pattern)
        return F.coalesce(here, dt.value_after_label(lines, above, pattern)) if above else here

    hay = F.concat_ws("\n", "file_name", "text")
    d = d.withColumns({f"_{name}": value(name) for name in PEOPLE_LABELS})
    kind, entity = F.col("_kind"), F.col("_entity")
    d = d.withColumns({
        "requestor": dt.normalise_space("_requestor"), "agreement_sub_type": dt.normalise_space("_agreement_sub_type"), "business_function": dt.normalise_space("_business_function"),
        "agreement_type": dt.normalise_space(F.coalesce(_known(kind, AGREEMENT_TYPES), kind, _known(hay, AGREEMENT_TYPES), F.when(hay.rlike("(?i)letter of offer|offer of employment"), "Offer Letter"))),
        "entity": dt.normalise_space(F.coalesce(_known(entity, entities), entity, _known(t, entities))),
    })
    d = d.withColumns({
        "agreement_id": agreement_id(F.col("_id")), "start_date": F.coalesce(dt.document_date("_start"), dt.first_date("_start")),
        "end_date": F.coalesce(dt.document_date("_end"), dt.first_date("_end")), "auto_renew": yes_no(F.col("_renew")), "_stated": yes_no(F.col("_perpetual")),
    })
    implied = F.col("end_date").isNull() & t.rlike(r"(?i)\bperpetual\b") & ~t.rlike(r"(?i)\bnot\s+perpetual\b|\bnon-perpetual\b|perpetual:\s*no")
    d = d.withColumn("perpetual", F.coalesce("_stated", F.when(implied, True))).drop(*(f"_{name}" for name in PEOPLE_LABELS), "_stated")
    has = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    forever = F.coalesce(F.col("perpetual"), F.lit(False))
    score = _points(
        (has("agreement_id"), 20), (has("requestor"), 10), (has("agreement_type"), 15), (has("agreement_sub_type"), 8), (has("business_function"), 8),
        (has("entity"), 12), (has("start_date"), 10), (has("end_date") | forever, 10), (F.col("auto_renew").isNotNull(), 7),
    )
    empty = (F.size("lines") == 0) | (strip("text") == "")
    d = d.withColumns({"is_empty": empty, "confidence": F.when(empty, 0).otherwise(score)})
    reasons = F.when(F.col("is_empty"), F.array(F.lit(NO_TEXT))).otherwise(F.array_compact(F.array(
        F.when(~has("agreement_id"), "Agreement ID was not classified."), F.when(~has("agreement_type"), "Agreement type was not classified."),
        F.when(~has("entity"), "Contracting entity was not classified."), F.when(~has("start_date"), "Agreement start date was not classified."),
        F.when(~has("end_date") & ~forever, "Agreement end date was not classified."), F.when(F.col("confidence") < 40, LOW),
    )))
    return with_status(d.withColumn("reasons", reasons), ~has("agreement_id"))


# Confidence given to each agreement field when it is found.
PEOPLE_CONFIDENCE = {
    "agreement_id": 92, "requestor": 85, "agreement_type": 80, "agreement_sub_type": 78, "business_function": 78,
    "entity": 88, "start_date": 90, "end_date": 88, "auto_renew": 86, "perpetual": 86,
}


def people_field_table(fields: DataFrame) -> DataFrame:
    """``(doc_id, key, value, confidence)``, one row per field; confidence 0 without a value."""
    flag = lambda n: F.when(F.col(n), "Yes").when(~F.col(n), "No")
    parts = []
    for name, sure in PEOPLE_CONFIDENCE.items():
        value = flag(name) if name in ("auto_renew", "perpetual") else F.col(name)
        parts.append(F.struct(F.lit(name).alias("key"), value.alias("value"), F.when(F.coalesce(value, F.lit("")) != "", sure).otherwise(0).alias("confidence")))
    return fields.select("doc_id", F.explode_outer(F.array(*parts)).alias("f")).select("doc_id", "f.*")


def summary(docs: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """Documents per folder, every folder present; partial counts as parsed."""
    all_folders = docs.sparkSession.createDataFrame([(f,) for f in folders], "folder string")
    counts = docs.groupBy("folder").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status").isin("parsed", "partial")).alias("parsed"), F.count_if(F.col("folder") == "anomaly").alias("needs_review"))
    return all_folders.join(counts, "folder", "left").fillna(0)


def keyword_search(docs: DataFrame, keyword: str, *columns: str) -> DataFrame:
    word = keyword.strip().lower()
    return docs.filter(F.lower(F.concat_ws("\n", *columns)).contains(word)) if word else docs
