"""Document queries: invoice and agreement extraction and their scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import doc_text as dt
from ..operators import documents as docs
from ..sources.adapters import Domain
from .catalog import Catalog
from .sqltext import strip

CATALOG = Catalog()
add = CATALOG.add
TEXTS = ("invoice_texts",)


def _find(text: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"nullif({strip(f'''regexp_extract({text}, '{p}', 1)''')}, '')"


def _lab(labels: str, value: str) -> str:
    return _find("text", rf"(?i)(?:{labels})[:\s]+({value})")


def _money(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace({x}, '[A-Za-z]', ' ', 'g'), '[$£€,\s()]', '', 'g')"
    cents = f"CAST(floor(CASE WHEN regexp_matches({bare}, '^-?\\d+(\\.\\d{{1,4}})?$') THEN try_cast({bare} AS DOUBLE) END * 100 + 0.5) AS BIGINT)"
    return rf"(CASE WHEN regexp_matches({x}, '(?i)\bCR\b') OR regexp_matches(trim({x}), '^\(.*\)$') THEN -abs({cents}) ELSE {cents} END)"


def _last(line: str) -> str:
    return _money(f"regexp_extract_all({line}, '{dt.MONEY_TOKEN}', 1)[-1]")


def _date(x: str) -> str:
    raw = rf"trim(regexp_replace(regexp_replace({x}, '[.,]', ' ', 'g'), '\s+', ' ', 'g'))"
    months = "CASE lower(substr({m}, 1, 3)) " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate(dt.MONTHS, 1)) + " END"
    full = ", ".join(f"'{m}'" for m in (*dt.MONTHS, *dt.FULL_MONTHS, "sept"))

    def built(pattern: str, y: int, m: int, d: int, named: bool) -> str:
        g = lambda i: f"regexp_extract({raw}, '{pattern}', {i})"
        year = f"(CASE WHEN length({g(y)}) = 4 THEN {g(y)} ELSE (CASE WHEN try_cast({g(y)} AS INTEGER) >= 70 THEN '19' ELSE '20' END) || {g(y)} END)"
        month = f"(CASE WHEN lower({g(m)}) IN ({full}) THEN {months.format(m=g(m))} END)" if named else f"lpad({g(m)}, 2, '0')"
        return f"CASE WHEN regexp_matches({raw}, '{pattern}') AND try_cast({month} AS INTEGER) BETWEEN 1 AND 12 AND try_cast({g(d)} AS INTEGER) BETWEEN 1 AND 31 THEN {year} || '-' || {month} || '-' || lpad({g(d)}, 2, '0') END"

    return "coalesce(" + ", ".join((
        built(r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", 1, 2, 3, False), built(r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$", 3, 2, 1, False),
        built(r"^(\d{1,2})\s*/?\s*([A-Za-z]{3,9})\s*/?\s*(\d{2,4})$", 3, 2, 1, True), built(r"^([A-Za-z]{3,9})\s+(\d{1,2})\s+(\d{2,4})$", 3, 1, 2, True))) + ")"


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


def _pick(test: str) -> str:
    return f"list_filter(lines, lambda x: {test})[1]"


_cur = "coalesce(upper(" + _find("text", dt.LABELLED_CURRENCY) + "), " + ", ".join(rf"CASE WHEN regexp_matches(text, '(?i)\b{c}\b') THEN '{c}' END" for c in dt.CURRENCY_ORDER) + \
    rf", upper({_find('text', chr(40) + '?i)' + chr(92) + 'b(' + '|'.join(dt.CURRENCIES) + ')' + chr(92) + 'b')}), CASE WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '€') THEN 'EUR' WHEN contains(text, '$') THEN 'AUD' END)"

INVOICE_CTES = rf"""
lined AS (SELECT *, {_LINES} AS lines FROM invoice_texts),
raw AS (SELECT *, regexp_replace(coalesce({_lab('Invoice Number|Invoice No' + chr(92) + '.?|Invoice #', '[A-Z0-9][A-Z0-9/.-]{4,30}')}, {_lab('Tax Invoice(?: Number)?', chr(92) + 'd[' + chr(92) + 'd' + chr(92) + 's]{6,}')}, {_lab('Invoice', chr(92) + 'd{5,}')}), '\s+', '', 'g') AS invoice_number,
  {_lab('Invoice date|Date Issued|Issue date|Invoice Date|Date of Event', docs.DATE_VALUE)} AS issued, {_lab('Date Issued|Invoice date|Issue date', '.+')} AS issued2, {_lab('Due Date|DUE DATE|Payment due|Pay by', docs.DATE_VALUE)} AS due,
  {_lab('Supplier Name|Vendor Name|Supplier', '[A-Za-z][A-Za-z0-9 .,&-]{2,60}')} AS named, {_pick(f"regexp_matches(x, '{docs.COMPANY}') AND NOT contains(string_split(x, ' ')[1], ':')")} AS guess,
  {_pick(f"regexp_matches(x, '{docs.SUBTOTAL}')")} AS s_line, {_pick(f"regexp_matches(x, '{docs.TAX}') AND regexp_matches(x, '(?i)" + chr(92) + "$|AUD|USD|EUR|GST|VAT')")} AS t_line,
  coalesce({_pick(f"regexp_matches(x, '{docs.AMOUNT_DUE}')")}, {_pick(f"regexp_matches(x, '{docs.TOTAL}') AND {_last('x')} IS NOT NULL")}) AS total_line FROM lined),
inv AS (SELECT doc_id, invoice_number, coalesce({_date('issued')}, {_date(_find('issued2', dt.DATE_TOKEN))}) AS invoice_date, {_date('due')} AS due_date, {_cur} AS currency,
  {_last('s_line')} AS subtotal, nullif(abs({_last('t_line')}), 0) AS tax_total, nullif(abs({_last('total_line')}), 0) AS total, coalesce(CASE WHEN NOT regexp_matches(named, '(?i)^(name|address|vat|total)$') THEN named END, CASE WHEN length(guess) < 80 THEN guess END) AS supplier_name,
  upper({_find('text', dt.BIC)}) AS bic, {_find('text', dt.BSB)} AS bsb FROM raw)
"""
HEADER = ("doc_id", "invoice_number", "invoice_date", "due_date", "currency", "subtotal", "tax_total", "total", "supplier_name", "bic", "bsb")


def invoices(d: Domain):
    return d.remember("invoice_fields", lambda: docs.invoice_fields(d.invoice_texts.select("doc_id", "file_name", "text")))


@add("D09_invoice_fields", "SELECT * FROM inv", TEXTS, INVOICE_CTES)
def d09(d: Domain):
    return docs.invoice_fields(d.invoice_texts.select("doc_id", "file_name", "text")).select(*HEADER)


_SCORED = rf"""
marked AS (SELECT doc_id, text, lines, coalesce(list_position([contains(lower(x), 'description') AND regexp_matches(x, '{docs.ITEM_HEADER_COLUMNS}') FOR x IN lines], true), 0) AS head FROM lined),
itemed AS (SELECT doc_id, len(lines) = 0 OR trim(text) = '' AS empty,
    regexp_replace(nullif(regexp_extract(upper(regexp_replace(text, '\s+', '', 'g')), '{dt.IBAN}', 1), ''), '(BIC|SWIFT)$', '') AS iban,
    len([x FOR x IN lines[head + 1:] IF NOT regexp_matches(x, '{docs.SKIP}') AND NOT regexp_matches(x, '{docs.SUBTOTAL}') AND NOT regexp_matches(x, '{docs.TOTAL}') AND NOT regexp_matches(x, '{docs.TAX}')
      AND abs({_last('x')}) >= 1 AND NOT regexp_matches(x, '{docs.NOT_ITEMS}') AND length(trim(regexp_replace(x, '{docs.TRAILING_MONEY}', ''))) >= 3]) > 0 AS items FROM marked),
scored AS (SELECT v.*, i.empty, coalesce(v.invoice_number, '') = '' AS no_number, v.total IS NULL AS no_total, coalesce(v.supplier_name, '') = '' AS no_name, coalesce(v.currency, '') = '' AS no_currency,
    CASE WHEN i.empty THEN 0 ELSE least(100, CASE WHEN coalesce(v.invoice_number, '') <> '' THEN 20 ELSE 0 END + CASE WHEN v.invoice_date IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN coalesce(v.supplier_name, '') <> '' THEN 15 ELSE 0 END
      + CASE WHEN v.total IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN v.due_date IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN v.tax_total IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN i.items THEN 12 ELSE 0 END + CASE WHEN length(i.iban) BETWEEN 15 AND 34 THEN 5 ELSE 0 END) END AS confidence
  FROM inv v JOIN itemed i ON i.doc_id = v.doc_id),
judged AS (SELECT *, CASE WHEN empty THEN 'No extractable text — document may be scanned or image-only.' ELSE concat_ws('|', CASE WHEN no_number AND no_total THEN 'Missing invoice number and totals.' WHEN no_number THEN 'Invoice number was not classified.' WHEN no_total THEN 'Totals were not classified.' END,
      CASE WHEN no_name THEN 'Supplier name was not classified.' END, CASE WHEN no_currency THEN 'Currency was not classified.' END, CASE WHEN confidence < 40 THEN 'Parse confidence is below the review threshold.' END) END AS reasons FROM scored),
stated AS (SELECT *, CASE WHEN empty OR (reasons <> '' AND (confidence < 55 OR no_number)) THEN 'anomaly' WHEN reasons <> '' OR confidence < 80 THEN 'partial' ELSE 'parsed' END AS status FROM judged)"""


@add("H45_invoice_status", "SELECT doc_id, confidence, status, reasons, status <> 'parsed' AS needs_confirm, CASE WHEN status <> 'parsed' THEN 'anomaly' ELSE 'processed' END AS folder FROM stated", TEXTS, INVOICE_CTES + "," + _SCORED)
def h45(d: Domain):
    return invoices(d).select("doc_id", "confidence", "status", F.array_join("reasons", "|").alias("reasons"), "needs_confirm", "folder")


_ITEM_LINES = rf"""
cut AS (SELECT m.doc_id, u.i, u.x FROM (SELECT doc_id, lines[head + 1:] AS body FROM (SELECT doc_id, lines, coalesce(list_position([contains(lower(x), 'description') AND regexp_matches(x, '{docs.ITEM_HEADER_COLUMNS}') FOR x IN lines], true), 0) AS head FROM lined)) m,
  LATERAL (SELECT unnest(range(1, len(body) + 1)) AS i, unnest(body) AS x) u),
told AS (SELECT doc_id, i, x, NOT regexp_matches(x, '{docs.SKIP}') AS shown, regexp_matches(x, '{docs.SUBTOTAL}') OR regexp_matches(x, '{docs.TOTAL}') OR regexp_matches(x, '{docs.TAX}') AS closing, {_last('x')} AS amount, trim(regexp_replace(x, '{docs.TRAILING_MONEY}', '')) AS description FROM cut),
marks AS (SELECT *, shown AND closing AS closes, coalesce(shown AND NOT closing AND abs(amount) >= 1 AND NOT regexp_matches(x, '{docs.NOT_ITEMS}') AND length(description) >= 3, false) AS item FROM told),
starts AS (SELECT doc_id, min(i) FILTER (item) AS first_item FROM marks GROUP BY 1),
ends AS (SELECT m.doc_id, min(i) AS stop FROM marks m JOIN starts s ON s.doc_id = m.doc_id WHERE closes AND i > first_item GROUP BY 1)"""


@add("N04_invoice_lines", "SELECT m.doc_id, row_number() OVER (PARTITION BY m.doc_id ORDER BY i) AS line_number, description, amount AS line_total FROM marks m LEFT JOIN ends e ON e.doc_id = m.doc_id WHERE item AND i < coalesce(stop, 1000000)", TEXTS, INVOICE_CTES + "," + _ITEM_LINES)
def n04(d: Domain):
    return invoices(d).select("doc_id", F.explode_outer("line_items").alias("i")).filter("i is not null").select("doc_id", "i.*")


_FOLDERS = "placed AS (SELECT *, CASE WHEN status <> 'parsed' THEN 'anomaly' ELSE 'processed' END AS folder FROM stated)"


@add("A12_document_summary", """SELECT f.folder, count(i.folder) AS documents, count(*) FILTER (i.status IN ('parsed', 'partial')) AS parsed, count(*) FILTER (i.folder = 'anomaly') AS needs_review
  FROM (SELECT unnest(['anomaly', 'archive', 'landing', 'processed']) AS folder) f LEFT JOIN placed i ON i.folder = f.folder GROUP BY 1""", TEXTS, INVOICE_CTES + "," + _SCORED + ",\n" + _FOLDERS)
def a12(d: Domain):
    return docs.summary(invoices(d), ("anomaly", "archive", "landing", "processed"))


@add("P06_documents_by_folder", "SELECT p.doc_id, row_number() OVER (ORDER BY t.d DESC, p.doc_id) AS rank FROM placed p JOIN invoice_texts t ON t.doc_id = p.doc_id WHERE folder = 'anomaly' QUALIFY rank <= 500", TEXTS, INVOICE_CTES + "," + _SCORED + ",\n" + _FOLDERS)
def p06(d: Domain):
    """The newest 500 of a folder with their rank: a top-k list as a page shows it."""
    placed = invoices(d).filter("folder = 'anomaly'").select("doc_id").join(d.invoice_texts.select("doc_id", "d"), "doc_id")
    top = placed.orderBy(F.desc("d"), "doc_id").limit(500)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("d"), "doc_id")).cast("bigint").alias("rank"))


def _people(d: Domain):
    return docs.people_fields(d.agreement_texts)


_near = lambda label, value: f"(SELECT arg_min(v, i) FROM (SELECT i, coalesce({_find(f'''regexp_replace(lines[i], '(?i){label}', ' ')''', '(?i)(' + value + ')')}, {_find('lines[i + 1]', '(?i)(' + value + ')')}, {_find('lines[i + 2]', '(?i)(' + value + ')')}, {_find('lines[i + 3]', '(?i)(' + value + ')')}) AS v FROM (SELECT unnest(range(1, len(lines) + 1)) AS i) WHERE regexp_matches(lines[i], '(?i){label}')) WHERE v IS NOT NULL)"


@add("H42_value_after_label", f"SELECT doc_id, {_near('start date|effective date|commencement', '[0-9A-Za-z/, -]{6,24}')} AS start_raw FROM a", ("agreement_texts",), f"a AS (SELECT *, {_LINES} AS lines FROM agreement_texts)")
def h42(d: Domain):
    return d.agreement_texts.withColumn("lines", dt.lines_of("text")).select("doc_id", dt.value_after_label(F.col("lines"), "start date|effective date|commencement", "[0-9A-Za-z/, -]{6,24}").alias("start_raw"))


@add("D12_people_fields")
def d12(d: Domain):
    return _people(d).select("doc_id", "agreement_id", "requestor", "agreement_type", "business_function", "entity", "start_date", "end_date", "auto_renew", "perpetual", "confidence", "status", "folder")


@add("N03_people_field_table")
def n03(d: Domain):
    return docs.people_field_table(_people(d))


@add("P07_people_keyword", "SELECT doc_id FROM agreement_texts WHERE contains(lower(file_name || chr(10) || text), 'jo smith')", ("agreement_texts",))
def p07(d: Domain):
    return docs.keyword_search(d.agreement_texts, " Jo Smith ", "file_name", "text").select("doc_id")


_DOCS = "documents"


@add("H07_money_tokens", f"SELECT doc_id, len(regexp_extract_all(text, '{dt.MONEY_TOKEN}', 1)) AS tokens, {_money(f'''regexp_extract_all(text, '{dt.MONEY_TOKEN}', 1)[1]''')} AS first_cents, {_last('text')} AS last_cents FROM documents")
def h07(d: Domain):
    return d.documents.select("doc_id", F.size(dt.money_tokens("text")).alias("tokens"), dt.first_money("text").alias("first_cents"), dt.last_money("text").alias("last_cents"))


@add("H40_detect_currency", f"SELECT doc_id, {_cur} AS currency FROM documents")
def h40(d: Domain):
    return d.documents.select("doc_id", dt.detect_currency("text").alias("currency"))


@add("H11_first_date", f"SELECT doc_id, {_date(_find('text', dt.DATE_TOKEN))} AS first_date FROM documents")
def h11(d: Domain):
    return d.documents.select("doc_id", dt.first_date("text").alias("first_date"))


@add("S08_document_lines", r"SELECT doc_id, len(l) AS lines, coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(replace(x, chr(160), ' '), '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)")
def s08(d: Domain):
    n = d.documents.select("doc_id", dt.lines_of("text").alias("l"))
    return n.select("doc_id", F.size("l").alias("lines"), F.coalesce(F.array_max(F.transform("l", F.length)), F.lit(0)).alias("longest"))
