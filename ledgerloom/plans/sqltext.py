"""SQL fragments shared by the checking queries."""

from __future__ import annotations

from ..functions.names import GENERIC_WORDS
from ..functions.text import GENERIC_REFERENCES, INVOICE_TOKEN, SO_PO_TOKEN


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm_key(x: str) -> str:
    return rf"upper(regexp_replace({x}, '\s+', '', 'g'))"


def cents(x: str) -> str:
    return f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"


def plain(cents_expr: str) -> str:
    """``340075`` -> ``3,400.75``."""
    c = f"({cents_expr})"
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || format('{{:,}}', CAST(abs({c}) // 100 AS BIGINT)) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"


def norm_name(x: str) -> str:
    legal = r"\b(LTD|LIMITED|PLC|LLC|NHS|TRUST|UHB|ULHB|LHB|FT|FOUNDATION|HOSPITAL|HOSPITALS|UNIVERSITY|THE|AND)\b"
    v = rf"regexp_replace(upper(coalesce({x}, '')), '[^A-Z0-9\s]', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({v}, '{legal}', ' ', 'g'), '\s+', ' ', 'g'))"


def name_words(norm: str) -> str:
    return f"list_filter(string_split({norm}, ' '), lambda w: length(w) >= 4 AND w NOT IN ({quoted(GENERIC_WORDS)}))"


def loosely(na: str, nb: str) -> str:
    """Loose name comparison of two normalised names."""
    fewer = f"(CASE WHEN len({name_words(na)}) <= len({name_words(nb)}) THEN {name_words(na)} ELSE {name_words(nb)} END)"
    more = f"(CASE WHEN len({name_words(na)}) <= len({name_words(nb)}) THEN {name_words(nb)} ELSE {name_words(na)} END)"
    agree = "(w2 = h OR (least(length(w2), length(h)) >= 6 AND (starts_with(h, w2) OR starts_with(w2, h))))"
    hits = f"list_filter({fewer}, lambda w2: len(list_filter({more}, lambda h: {agree})) > 0)"
    short = lambda a, b: f"(length({a}) IN (4, 5) AND NOT contains({a}, ' ') AND list_contains(string_split({b}, ' '), {a}))"
    return (
        f"({na} <> '' AND {nb} <> '' AND ((length({na}) >= 6 AND length({nb}) >= 6 AND (contains({na}, {nb}) OR contains({nb}, {na}))) "
        f"OR {short(na, nb)} OR {short(nb, na)} OR coalesce(list_max(list_transform({hits}, lambda z: length(z))), 0) >= 8 "
        f"OR (len({fewer}) >= 2 AND len({hits}) >= 2)))"
    )


def join_filled(*cols: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN trim({c}) <> '' THEN {c} END" for c in cols) + ")"


def tokens(*cols: str) -> str:
    hay = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in cols) + ")"
    found = f"list_concat(regexp_extract_all({hay}, '{SO_PO_TOKEN}', 1), regexp_extract_all({hay}, '{INVOICE_TOKEN}', 1))"
    return f"list_distinct(list_transform({found}, lambda t: {norm_key('t')}))"


def distinctive(x: str) -> str:
    return f"(length(trim(coalesce({x}, ''))) >= 5 AND upper(trim({x})) NOT IN ({quoted(GENERIC_REFERENCES)}))"


FIELDS = ("reference", "description", "narrative", "customer_reference", "bank_reference", "counterparty")
PARTY = ("narrative", "description", "customer_reference", "counterparty", "bank_reference")
DOC = "struct_pack(o := source_row, id := id, amount := amount)"

# Reconciliation written the plain way: every rule's hits joined row by row, no classes or blocking.
RECON_NEEDS = ("bank_transactions", "sales_orders", "purchase_orders", "remittances")
RECON_CTES = rf"""
lines AS MATERIALIZED (
  SELECT id AS transaction_id, account_id, date, amount, currency, CASE WHEN amount >= 0 THEN 'O2C' ELSE 'P2P' END AS flow,
    abs(amount) AS abs_amount, {tokens(*FIELDS)} AS tokens, {norm_name(join_filled(*PARTY))} AS party_text
  FROM bank_transactions),
line_tokens AS (SELECT transaction_id, flow, currency, abs_amount, unnest(tokens) AS tok FROM lines),
commercial AS (
  SELECT 'O2C' AS flow, id, amount, currency, source_row FROM sales_orders
  UNION ALL SELECT 'P2P', id, amount, currency, source_row FROM purchase_orders),
by_id AS (SELECT * FROM commercial QUALIFY row_number() OVER (PARTITION BY flow, upper(id) ORDER BY source_row DESC) = 1),
id_hits AS (
  SELECT t.transaction_id, count(*) AS id_n, count(*) FILTER (b.amount = t.abs_amount) AS id_equal_n, min({DOC}) AS id_doc
  FROM line_tokens t JOIN by_id b ON b.flow = t.flow AND upper(b.id) = t.tok AND b.currency = t.currency GROUP BY 1),
po_refs AS (
  SELECT DISTINCT id, amount, currency, source_row, {norm_key('r')} AS ref
  FROM (SELECT *, unnest(list_concat(po_numbers, [invoice_number, id])) AS r FROM purchase_orders) WHERE r <> ''),
po_pairs AS (
  SELECT DISTINCT t.transaction_id, t.abs_amount, p.id, p.amount, p.source_row
  FROM line_tokens t JOIN po_refs p ON p.ref = t.tok AND p.currency = t.currency WHERE t.flow = 'P2P'),
po_hits AS (SELECT transaction_id, count(*) AS po_n, count(*) FILTER (amount = abs_amount) AS po_equal_n, min({DOC}) AS po_doc FROM po_pairs GROUP BY 1),
rem_refs AS (
  SELECT DISTINCT CASE party WHEN 'customer' THEN 'O2C' ELSE 'P2P' END AS flow, id, amount, currency, source_row, {norm_key('r')} AS ref
  FROM (SELECT *, unnest(list_concat(invoice_numbers, [CASE WHEN {distinctive('remittance_number')} THEN remittance_number END, CASE WHEN {distinctive('reference')} THEN reference END])) AS r FROM remittances)
  WHERE r IS NOT NULL),
ref_pairs AS (
  SELECT DISTINCT t.transaction_id, t.abs_amount, r.id, r.amount, r.source_row
  FROM line_tokens t JOIN rem_refs r ON r.ref = t.tok AND r.currency = t.currency AND r.flow = t.flow),
ref_hits AS (
  SELECT transaction_id, count(*) AS ref_n, count(*) FILTER (amount = abs_amount) AS ref_equal_n, min({DOC}) AS ref_doc,
    min({DOC}) FILTER (amount = abs_amount) AS ref_equal_doc
  FROM ref_pairs GROUP BY 1),
amount_pairs AS MATERIALIZED (
  SELECT l.transaction_id, l.party_text, r.id, r.amount, r.source_row, {norm_name('r.name')} AS norm
  FROM lines l JOIN remittances r ON r.currency = l.currency AND r.amount = l.abs_amount AND (CASE r.party WHEN 'customer' THEN 'O2C' ELSE 'P2P' END) = l.flow),
amount_hits AS (SELECT transaction_id, count(*) AS rem_n, min({DOC}) AS rem_doc FROM amount_pairs GROUP BY 1),
name_hits AS (SELECT transaction_id, count(*) AS named_n, min({DOC}) AS named_doc FROM amount_pairs WHERE {loosely('norm', 'party_text')} GROUP BY 1),
doc_hits AS (
  SELECT l.transaction_id, count(*) AS com_n, min(struct_pack(o := c.source_row, id := c.id, amount := c.amount)) AS com_doc
  FROM lines l JOIN commercial c ON c.flow = l.flow AND c.currency = l.currency AND c.amount = l.abs_amount GROUP BY 1),
context AS MATERIALIZED (
  SELECT l.*, coalesce(id_n, 0) AS id_n, coalesce(id_equal_n, 0) AS id_equal_n, id_doc, coalesce(po_n, 0) AS po_n, coalesce(po_equal_n, 0) AS po_equal_n, po_doc,
    coalesce(ref_n, 0) AS ref_n, coalesce(ref_equal_n, 0) AS ref_equal_n, ref_doc, ref_equal_doc, coalesce(rem_n, 0) AS rem_n, rem_doc,
    coalesce(named_n, 0) AS named_n, named_doc, coalesce(com_n, 0) AS com_n, com_doc
  FROM lines l LEFT JOIN id_hits USING (transaction_id) LEFT JOIN po_hits USING (transaction_id) LEFT JOIN ref_hits USING (transaction_id)
    LEFT JOIN amount_hits USING (transaction_id) LEFT JOIN name_hits USING (transaction_id) LEFT JOIN doc_hits USING (transaction_id)),
ruled AS (
  SELECT *, CASE
      WHEN ref_n = 1 AND ref_equal_n = 1 THEN 'ref_one' WHEN ref_n > 1 AND ref_equal_n = 1 THEN 'ref_many'
      WHEN rem_n = 1 THEN 'amount' WHEN named_n = 1 THEN 'name' END AS alone,
    CASE WHEN id_n = 1 THEN 'id' WHEN flow = 'P2P' AND po_n = 1 THEN 'po' END AS via
  FROM context),
chosen AS (
  SELECT *, CASE
      WHEN via = 'id' AND id_doc.amount = abs_amount THEN 'doc_equal' WHEN via = 'po' AND po_doc.amount = abs_amount THEN 'doc_equal'
      WHEN via IS NOT NULL AND alone IS NOT NULL THEN alone WHEN via IS NOT NULL THEN 'doc_differs'
      WHEN ref_n = 1 AND ref_equal_n = 0 THEN 'ref_differs' WHEN alone IS NOT NULL THEN alone
      WHEN com_n = 1 THEN 'unique_amount'
      WHEN com_n + (CASE flow WHEN 'O2C' THEN id_n - id_equal_n ELSE po_n - po_equal_n END)
         + (CASE WHEN ref_n > 0 THEN ref_n WHEN named_n = 1 THEN 1 ELSE rem_n END) > 0 THEN 'candidates' ELSE 'nothing' END AS outcome
  FROM ruled),
results AS (
  SELECT transaction_id, account_id, date, amount, currency, flow, abs_amount,
    CASE WHEN outcome = 'nothing' THEN 'unmatched' WHEN outcome IN ('candidates', 'doc_differs', 'ref_differs') THEN 'partial' ELSE 'matched' END AS status,
    CASE WHEN outcome IN ('doc_equal', 'doc_differs', 'unique_amount') THEN (CASE flow WHEN 'O2C' THEN 'SO' ELSE 'PO' END)
      WHEN outcome IN ('ref_one', 'ref_many', 'ref_differs', 'amount', 'name') THEN 'remittance' END AS matched_type,
    CASE outcome WHEN 'ref_one' THEN ref_doc WHEN 'ref_differs' THEN ref_doc WHEN 'ref_many' THEN ref_equal_doc WHEN 'amount' THEN rem_doc
      WHEN 'name' THEN named_doc WHEN 'unique_amount' THEN com_doc WHEN 'candidates' THEN NULL WHEN 'nothing' THEN NULL
      ELSE (CASE via WHEN 'id' THEN id_doc ELSE po_doc END) END AS winner,
    CASE outcome WHEN 'doc_equal' THEN (CASE via WHEN 'id' THEN 0.99 ELSE 0.95 END) WHEN 'doc_differs' THEN 0.6 WHEN 'ref_differs' THEN 0.65
      WHEN 'ref_one' THEN 0.96 WHEN 'ref_many' THEN 0.9 WHEN 'amount' THEN 0.8 WHEN 'name' THEN 0.85 WHEN 'unique_amount' THEN 0.7 WHEN 'candidates' THEN 0.3 ELSE 0.0 END AS confidence,
    CASE WHEN outcome IN ('doc_equal', 'doc_differs') THEN (CASE via WHEN 'id' THEN 'so_po_id' ELSE 'po_invoice_number' END)
      WHEN outcome IN ('ref_one', 'ref_many', 'ref_differs') THEN 'remittance_invoice_ref' WHEN outcome = 'amount' THEN 'remittance_amount_window'
      WHEN outcome = 'name' THEN 'remittance_amount_name' WHEN outcome = 'unique_amount' THEN 'so_po_unique_amount' ELSE 'exhausted' END AS match_pattern,
    CASE WHEN outcome IN ('candidates', 'nothing') THEN com_n + (CASE flow WHEN 'O2C' THEN id_n - id_equal_n ELSE po_n - po_equal_n END)
      + (CASE WHEN ref_n > 0 THEN ref_n WHEN named_n = 1 THEN 1 ELSE rem_n END) ELSE 1 END AS candidate_count,
    id_n, po_n, ref_n, rem_n, named_n, com_n
  FROM chosen),
recon AS MATERIALIZED (
  SELECT transaction_id, account_id, date, amount, currency, flow, status, matched_type, winner.id AS matched_id, CAST(confidence AS DOUBLE) AS confidence,
    CASE WHEN winner IS NULL THEN 0 ELSE abs_amount - winner.amount END AS amount_diff, match_pattern, CAST(candidate_count AS BIGINT) AS candidate_count,
    id_n, po_n, ref_n, rem_n, named_n, com_n
  FROM results)
"""
