"""Cash, reconciliation, forecast and anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies, cash, explain, forecast, matching, recon, supporting
from ..sources.adapters import Domain
from .catalog import Catalog
from .sqltext import RECON_CTES, RECON_NEEDS, norm_key, plain

CATALOG = Catalog()
add = CATALOG.add

LINES = ("bank_accounts", "bank_transactions")

POSITION_CTES = """
own AS (SELECT t.* FROM bank_transactions t JOIN bank_accounts a ON a.id = t.account_id AND a.currency = t.currency),
balances AS (
  SELECT account_id,
    arg_min(balance_after - amount, struct_pack(d := date, l := coalesce(-line_number, 0), i := id)) FILTER (balance_after IS NOT NULL) AS derived,
    arg_max(balance_after, struct_pack(d := date, l := coalesce(-line_number, 0), i := id)) FILTER (balance_after IS NOT NULL) AS reported
  FROM own GROUP BY account_id),
position AS (
  SELECT a.id AS account_id, a.name AS account_name, a.bank, a.currency, CAST(coalesce(max(b.derived), max(a.opening_balance)) AS BIGINT) AS opening_balance,
    CAST(coalesce(sum(o.amount) FILTER (o.amount > 0), 0) AS BIGINT) AS inflows, CAST(coalesce(-sum(o.amount) FILTER (o.amount < 0), 0) AS BIGINT) AS outflows,
    count(o.id) AS transaction_count, CAST(max(b.reported) AS BIGINT) AS reported_closing_balance
  FROM bank_accounts a LEFT JOIN own o ON o.account_id = a.id LEFT JOIN balances b ON b.account_id = a.id GROUP BY 1, 2, 3, 4),
positions AS (SELECT *, opening_balance + inflows - outflows AS closing_balance FROM position),
currency_position AS (
  SELECT currency, CAST(sum(opening_balance) AS BIGINT) AS opening_balance, CAST(sum(inflows) AS BIGINT) AS total_inflows,
    CAST(sum(outflows) AS BIGINT) AS total_outflows, count(*) AS account_count, CAST(sum(inflows) - sum(outflows) AS BIGINT) AS net_cash_flow,
    CAST(sum(closing_balance) AS BIGINT) AS closing_balance
  FROM positions GROUP BY currency),
daily AS (
  SELECT currency, date, CAST(coalesce(sum(amount) FILTER (amount > 0), 0) AS BIGINT) AS inflow, CAST(coalesce(-sum(amount) FILTER (amount < 0), 0) AS BIGINT) AS outflow
  FROM own GROUP BY 1, 2)
"""


def _positions(d: Domain):
    return cash.account_positions(d.bank_accounts, d.once("bank_transactions"))


@add("A02_account_position", "SELECT * FROM positions", LINES, POSITION_CTES)
def a02(d: Domain):
    return _positions(d)


@add("A03_currency_position", "SELECT * FROM currency_position", LINES, POSITION_CTES)
def a03(d: Domain):
    return cash.currency_positions(_positions(d))


@add("A04_daily_flows", "SELECT *, inflow - outflow AS net FROM daily", LINES, POSITION_CTES)
def a04(d: Domain):
    return cash.daily_flows(d.bank_accounts, d.bank_transactions)


DAILY_SERIES_SQL = """SELECT y.currency, y.date, y.inflow, y.outflow, y.inflow - y.outflow AS net,
  CAST(p.opening_balance + sum(y.inflow - y.outflow) OVER (PARTITION BY y.currency ORDER BY y.date) AS BIGINT) AS running_balance
FROM daily y JOIN currency_position p ON p.currency = y.currency"""


@add("W01_daily_running_balance", DAILY_SERIES_SQL, LINES, POSITION_CTES)
def w01(d: Domain):
    return cash.daily_series(d.bank_accounts, d.bank_transactions)


@add("W02_opening_balance", "SELECT account_id, currency, CAST(arg_min(balance_after - amount, struct_pack(d := date, l := coalesce(-line_number, 0), i := id)) FILTER (balance_after IS NOT NULL) AS BIGINT) AS derived_opening FROM bank_transactions GROUP BY 1, 2", LINES)
def w02(d: Domain):
    return cash.opening_balances(d.bank_transactions).drop("reported_closing_balance")


@add("W03_reported_closing", "SELECT account_id, currency, CAST(arg_max(balance_after, struct_pack(d := date, l := coalesce(-line_number, 0), i := id)) FILTER (balance_after IS NOT NULL) AS BIGINT) AS reported_closing_balance FROM bank_transactions GROUP BY 1, 2", LINES)
def w03(d: Domain):
    return cash.opening_balances(d.bank_transactions).drop("derived_opening")


@add("P14_reporting_currency_lines", "SELECT id, account_id, currency, amount FROM own", LINES, POSITION_CTES)
def p14(d: Domain):
    return cash.in_reporting_currency(d.bank_accounts, d.bank_transactions).select("id", "account_id", "currency", "amount")


@add("A14_statement_rollup", "SELECT statement_id, min(account_id) AS account_id, min(date) AS period_start, max(date) AS period_end, count(*) AS transaction_count FROM bank_transactions GROUP BY 1", LINES)
def a14(d: Domain):
    return cash.statement_rollup(d.bank_transactions)


@add("A19_bank_close_check", """SELECT account_id, currency, closing_balance, reported_closing_balance, closing_balance - reported_closing_balance AS difference,
  CASE WHEN reported_closing_balance IS NULL THEN 'no_reported_balance' WHEN closing_balance = reported_closing_balance THEN 'agrees' ELSE 'differs' END AS "check" FROM positions""", LINES, POSITION_CTES)
def a19(d: Domain):
    return cash.close_check(_positions(d))


@add("W05_balance_continuity", """SELECT a.statement_id, a.line_number, a.amount, a.balance_after, b.balance_after AS older_balance, b.balance_after + a.amount AS expected_balance
FROM ordered a JOIN ordered b ON b.statement_id = a.statement_id AND b.line_number = a.next_line
WHERE a.balance_after <> b.balance_after + a.amount""", ("order_facts",), """
listed AS (SELECT 'ST-' || CAST(nation_key AS STRING) AS statement_id, k AS line_number, cents AS amount, CASE WHEN k % 9 <> 0 THEN k * 100 + cents * (k % 2) END AS balance_after FROM order_facts),
ordered AS (SELECT *, lead(line_number) OVER (PARTITION BY statement_id ORDER BY line_number) AS next_line FROM listed)""")
def w05(d: Domain):
    listed = d.order_facts.selectExpr(
        "'ST-' || CAST(nation_key AS STRING) AS statement_id", "k AS line_number", "cents AS amount",
        "CASE WHEN k % 9 <> 0 THEN k * 100 + cents * (k % 2) END AS balance_after",
    )
    return cash.continuity(listed)


@add("J17_ensure_accounts", """SELECT id, name, bank, currency, opening_balance FROM few UNION ALL
SELECT account_id, account_id, 'Unknown', arg_min(currency, struct_pack(d := date, i := id)), 0 FROM bank_transactions WHERE account_id NOT IN (SELECT id FROM few) GROUP BY account_id""", LINES,
     "few AS (SELECT * FROM bank_accounts WHERE opening_balance % 3 <> 0)")
def j17(d: Domain):
    few = d.bank_accounts.filter("opening_balance % 3 <> 0")
    return cash.ensure_accounts(few, d.bank_transactions).select("id", "name", "bank", "currency", "opening_balance")


@add("P11_attach_source_file", "SELECT t.id, coalesce(t.source_file, s.file_name) AS source_file FROM blanked t LEFT JOIN statements s ON s.id = t.statement_id", ("bank_transactions", "statements"),
     "blanked AS (SELECT id, statement_id, CASE WHEN line_number % 2 = 0 THEN source_file END AS source_file FROM bank_transactions)")
def p11(d: Domain):
    blanked = d.bank_transactions.withColumn("source_file", F.expr("CASE WHEN line_number % 2 = 0 THEN source_file END"))
    return cash.attach_source(blanked, d.statements).select("id", "source_file")


@add("P03_transaction_search", "SELECT id FROM bank_transactions WHERE contains(lower(concat_ws(' ', date, description, reference, counterparty, narrative, customer_reference, bank_reference, account_id, currency)), 'northgate mills')", LINES)
def p03(d: Domain):
    return search_transactions(d.bank_transactions, "Northgate Mills").select("id")


def search_transactions(transactions, keyword: str):
    fields = ("date", "description", "reference", "counterparty", "narrative", "customer_reference", "bank_reference", "account_id", "currency")
    return transactions.filter(F.lower(F.concat_ws(" ", *fields)).contains(keyword.strip().lower()))


@add("T06_currency_order", """SELECT currency, CASE currency WHEN 'GBP' THEN 0 ELSE 1 END AS "group" FROM bank_accounts GROUP BY currency""", LINES)
def t06(d: Domain):
    return cash.order_currencies(d.bank_accounts, "GBP")


@add("U03_currency_union", "SELECT currency FROM remittances UNION SELECT currency FROM bank_accounts", ("remittances", "bank_accounts"))
def u03(d: Domain):
    return d.remittances.select("currency").union(d.bank_accounts.select("currency")).distinct()


# --- reconciliation -------------------------------------------------------

def _context(d: Domain):
    return recon.line_context(d.once("bank_transactions"), d.sales_orders, d.purchase_orders, d.remittances)


def _reconcile(d: Domain):
    return recon.reconcile(d.once("bank_transactions"), d.sales_orders, d.purchase_orders, d.remittances)


#: What other jobs read of a result; the texts that tell how it came about are not kept.
RESULT_READ = ("transaction_id", "date", "amount", "currency", "flow", "status", "matched_id", "amount_diff")


def results_of(d: Domain, kept: bool = True):
    """Reconciliation results. The forecast and the anomalies read them several times; a job that reads them once (not ``kept``) takes them as they are kept or written."""
    made = lambda: _reconcile(d).select(*RESULT_READ)
    return d.remember("reconciliation", made) if kept else d.remembered("reconciliation", made)


_RECON = "transaction_id, account_id, date, amount, currency, flow, status, matched_type, matched_id, confidence, amount_diff, match_pattern, candidate_count"


@add("D01_reconcile", f"SELECT {_RECON} FROM recon", RECON_NEEDS, RECON_CTES)
def d01(d: Domain):
    return _reconcile(d).drop("approach")


# Written out from the rules, not from the operator: what a line's fields, hits and verdict say.
_EXPLAIN = """
full_lines AS MATERIALIZED (SELECT r.*, b.description, b.narrative, b.reference, b.counterparty, b.customer_reference, b.bank_reference, b.line_number, CASE WHEN r.flow = 'O2C' THEN 'SO' ELSE 'PO' END AS k,
    coalesce(nullif(trim(b.narrative), ''), trim(b.description), '') AS told,
    coalesce(nullif(concat_ws(', ', CASE WHEN trim(b.reference) <> '' THEN 'reference' END, CASE WHEN trim(b.description) <> '' THEN 'description' END, CASE WHEN trim(b.narrative) <> '' THEN 'narrative' END,
      CASE WHEN trim(b.customer_reference) <> '' THEN 'customerReference' END, CASE WHEN trim(b.bank_reference) <> '' THEN 'bankReference' END, CASE WHEN trim(b.counterparty) <> '' THEN 'counterparty' END), ''), 'bank text') AS fields
  FROM recon r JOIN bank_transactions b ON b.id = r.transaction_id),
com_count AS MATERIALIZED (SELECT 'O2C' AS flow, currency, count(*) AS n FROM sales_orders GROUP BY 2 UNION ALL SELECT 'P2P', currency, count(*) FROM purchase_orders GROUP BY 2),
rem_count AS MATERIALIZED (SELECT CASE WHEN party = 'customer' THEN 'O2C' ELSE 'P2P' END AS flow, currency, count(*) AS n FROM remittances GROUP BY 1, 2),
told AS (SELECT f.*, CASE WHEN id_n > 0 OR com_n > 0 OR (flow = 'P2P' AND po_n > 0) THEN 'yes' ELSE 'no' END AS com_found, CASE WHEN ref_n > 0 OR rem_n > 0 THEN 'yes' ELSE 'no' END AS rem_found,
    format('{:,.2f}', CAST(amount_diff AS DOUBLE) / 100) || ' ' || currency AS diff FROM full_lines f)"""


@add("D02_match_explanation", """SELECT t.transaction_id, told AS narrative, k || ' ' || t.currency || ' (' || coalesce(c.n, 0) || ' loaded) + remittance ' || CASE WHEN t.flow = 'O2C' THEN 'customer ' ELSE 'vendor ' END || t.currency || ' (' || coalesce(m.n, 0) || ' loaded)' AS target,
  k || ' ' || com_found || ' · remittance ' || rem_found AS found,
  CASE WHEN status = 'matched' THEN NULL WHEN status = 'partial' AND match_pattern = 'so_po_id' AND t.flow = 'O2C' THEN 'SO found by id; amount differs by ' || diff || '. Treat as partial collection, multi-invoice receipt, or FX. Confirm the remaining open amount on the SO.'
    WHEN status = 'partial' AND match_pattern = 'so_po_id' THEN 'PO found by id; amount differs by ' || diff || '. Check partial payment, credit note, or invoice vs payment currency.'
    WHEN status = 'partial' AND match_pattern = 'po_invoice_number' THEN 'PO/AP invoice found; amount differs by ' || diff || '. Check partial payment, credit note, or a different invoice on the same supplier.'
    WHEN status = 'partial' AND match_pattern = 'remittance_invoice_ref' THEN 'Remittance found by invoice/payment ref; amount differs by ' || diff || '. Check split applications, short-pay, or bank charges on the remittance.'
    WHEN ref_n > 1 THEN ref_n || ' remittances share this invoice/payment ref and the exact amount did not isolate one. Put the full invoice set on the bank line.'
    WHEN rem_n > 1 AND named_n <> 1 THEN rem_n || ' remittances have this exact amount. Put the invoice number on the bank line, or add a counterparty alias.'
    WHEN com_n > 1 THEN com_n || ' ' || k || 's share this exact amount (ambiguous). Put the ' || k || ' or invoice number on the bank line.'
    WHEN id_n = 0 AND po_n = 0 AND ref_n = 0 AND rem_n = 0 AND com_n = 0 AND told <> '' THEN 'This narrative is not on a loaded remittance or ' || k || '. Load the missing remittance, or put the invoice number on the bank line.'
    WHEN id_n = 0 AND po_n = 0 AND ref_n = 0 AND rem_n = 0 AND com_n = 0 THEN 'No remittance or ' || k || ' at this exact amount. Load the missing remittance, or classify as payroll/tax/internal.'
    ELSE 'Put the invoice number on the bank line, or load the remittance that belongs to this payment.' END AS remediation,
  fields AS source_fields FROM told t LEFT JOIN com_count c ON c.flow = t.flow AND c.currency = t.currency LEFT JOIN rem_count m ON m.flow = t.flow AND m.currency = t.currency""", RECON_NEEDS, RECON_CTES + "," + _EXPLAIN)
def d02(d: Domain):
    fields = F.regexp_extract("source", r"(?:.* from |no invoice token in )(.*?)\)?$", 1)
    return _explained(d).select("transaction_id", "narrative", "target", "found", "remediation", fields.alias("source_fields"))


def _explained(d: Domain):
    decided = recon.decide(_context(d))
    return explain.explain(decided, d.bank_transactions, explain.loaded(d.sales_orders, d.purchase_orders, d.remittances))


_SHOWN = """
listed AS MATERIALIZED (
  SELECT t.transaction_id, 'com' AS side, 0 AS prio, CAST(strpos(upper(concat_ws(' ', x.reference, x.description, x.narrative, x.customer_reference, x.bank_reference, x.counterparty)), t.tok) AS BIGINT) AS ord, CASE b.flow WHEN 'O2C' THEN 'SO:' ELSE 'PO:' END || b.id AS name FROM line_tokens t JOIN bank_transactions x ON x.id = t.transaction_id JOIN by_id b ON b.flow = t.flow AND upper(b.id) = t.tok AND b.currency = t.currency
  UNION ALL SELECT transaction_id, 'com', 1, source_row, 'PO:' || id FROM po_pairs
  UNION ALL SELECT l.transaction_id, 'com', 2, c.source_row, CASE c.flow WHEN 'O2C' THEN 'SO:' ELSE 'PO:' END || c.id FROM lines l JOIN (SELECT * FROM commercial QUALIFY row_number() OVER (PARTITION BY flow, currency, amount ORDER BY source_row, id) <= 12) c ON c.flow = l.flow AND c.currency = l.currency AND c.amount = l.abs_amount
  UNION ALL SELECT transaction_id, 'rem', 0, source_row, 'remittance:' || id FROM ref_pairs
  UNION ALL SELECT transaction_id, 'rem', 1, 0, 'remittance:' || named_doc.id FROM context WHERE ref_n = 0 AND named_n = 1
  UNION ALL SELECT x.transaction_id, 'rem', 1, r.source_row, 'remittance:' || r.id FROM context x JOIN (SELECT *, CASE party WHEN 'customer' THEN 'O2C' ELSE 'P2P' END AS flow FROM remittances QUALIFY row_number() OVER (PARTITION BY flow, currency, amount ORDER BY source_row, id) <= 12) r
    ON r.flow = x.flow AND r.currency = x.currency AND r.amount = x.abs_amount WHERE x.ref_n = 0 AND x.named_n <> 1),
once AS (SELECT transaction_id, side, name, min(struct_pack(p := prio, o := ord)) AS place FROM listed GROUP BY 1, 2, 3),
firsts AS (SELECT transaction_id, list(name ORDER BY place, name) FILTER (side = 'com') AS com, list(name ORDER BY place, name) FILTER (side = 'rem') AS rem
  FROM (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY transaction_id, side ORDER BY place, name) <= 4) GROUP BY 1),
picked AS MATERIALIZED (SELECT r.transaction_id, r.matched_type, r.matched_id, coalesce(com, []) AS com, coalesce(rem, []) AS rem, c.id_n = 1 OR (c.flow = 'P2P' AND c.po_n = 1) OR c.com_n = 1 AS one_com, c.ref_n = 1 OR c.rem_n = 1 OR c.named_n = 1 AS one_rem, c.id_n > 0 OR c.po_n > 0 AS referenced
  FROM recon r JOIN context c ON c.transaction_id = r.transaction_id LEFT JOIN firsts f ON f.transaction_id = r.transaction_id),
combined AS (SELECT transaction_id, CASE WHEN matched_id IS NULL THEN list_concat(CASE WHEN one_rem THEN rem[1:1] ELSE rem END, CASE WHEN one_com THEN com[1:1] ELSE com END)
    WHEN matched_type = 'remittance' THEN list_concat(['remittance:' || matched_id], CASE WHEN one_com THEN com[1:1] WHEN referenced THEN com[1:3] ELSE [] END)
    ELSE list_concat([matched_type || ':' || matched_id], CASE WHEN one_rem THEN rem[1:1] ELSE rem END) END AS names FROM picked),
positions8 AS MATERIALIZED (SELECT transaction_id, row_number() OVER (PARTITION BY transaction_id ORDER BY i) AS position, name FROM (SELECT transaction_id, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS i, names FROM combined) WHERE list_position(names, name) = i QUALIFY position <= 8),
labels AS (SELECT 'SO:' || id AS name, id AS number, 'SO ' || id AS label FROM sales_orders
  UNION ALL SELECT 'PO:' || id, number, 'PO ' || number || CASE WHEN number <> id THEN ' (' || id || ')' ELSE '' END || CASE WHEN invoice_number <> '' AND invoice_number <> number AND invoice_number <> id THEN ' · inv ' || invoice_number ELSE '' END
    FROM (SELECT *, coalesce(list_filter(po_numbers, lambda n: n <> '' AND n <> id)[1], nullif(invoice_number, ''), id) AS number FROM purchase_orders)
  UNION ALL SELECT 'remittance:' || id, number, 'Remittance ' || number || CASE WHEN number <> id THEN ' (' || id || ')' ELSE '' END || CASE WHEN len(invoice_numbers) > 0 THEN ' inv ' || array_to_string(invoice_numbers[1:3], ', ') ELSE '' END
    FROM (SELECT *, coalesce(nullif(remittance_number, ''), nullif(reference, ''), id) AS number FROM remittances))"""


@add("T07_supporting_documents", "SELECT transaction_id, position, string_split(p.name, ':')[1] AS kind, substr(p.name, strpos(p.name, ':') + 1) AS id, number, label FROM positions8 p JOIN labels l ON l.name = p.name", RECON_NEEDS, RECON_CTES + "," + _SHOWN)
def t07(d: Domain):
    decided = recon.decide(_context(d))
    return supporting.supporting_documents(decided, d.bank_transactions, d.sales_orders, d.purchase_orders, d.remittances).select("transaction_id", "position", "kind", "id", "number", "label")


@add("H57_matched_label", "SELECT transaction_id, CASE WHEN matched_id IS NULL THEN '—' WHEN matched_type = 'remittance' THEN 'Remittance ' || matched_id ELSE matched_type || ' ' || matched_id END AS matched_to FROM recon", RECON_NEEDS, RECON_CTES)
def h57(d: Domain):
    return _reconcile(d).select("transaction_id", explain.matched_label(F.col("matched_type"), F.col("matched_id")).alias("matched_to"))


@add("J07_cascade_hits", "SELECT transaction_id, id_n, po_n, ref_n, rem_n, named_n, com_n FROM recon", RECON_NEEDS, RECON_CTES)
def j07(d: Domain):
    return _context(d).select("transaction_id", *recon.HIT_COLUMNS)


@add("J01_id_hits", "SELECT transaction_id, id_n, id_equal_n, id_doc.id AS first_id FROM id_hits", RECON_NEEDS, RECON_CTES)
def j01(d: Domain):
    return _reference_hits(d).filter("id_n > 0").select("transaction_id", "id_n", "id_equal_n", F.col("id_doc.id").alias("first_id"))


@add("J02_po_reference_hits", "SELECT transaction_id, po_n, po_equal_n, po_doc.id AS first_id FROM po_hits", RECON_NEEDS, RECON_CTES)
def j02(d: Domain):
    return _reference_hits(d).filter("po_n > 0").select("transaction_id", "po_n", "po_equal_n", F.col("po_doc.id").alias("first_id"))


@add("J03_remittance_reference_hits", "SELECT transaction_id, ref_n, ref_equal_n, ref_doc.id AS first_id, ref_equal_doc.id AS equal_id FROM ref_hits", RECON_NEEDS, RECON_CTES)
def j03(d: Domain):
    return _reference_hits(d).filter("ref_n > 0").select(
        "transaction_id", "ref_n", "ref_equal_n", F.col("ref_doc.id").alias("first_id"), F.col("ref_equal_doc.id").alias("equal_id"))


def _reference_hits(d: Domain):
    docs = matching.documents(d.sales_orders, d.purchase_orders, d.remittances)
    return matching.reference_hits(matching.bank_lines(d.once("bank_transactions")), docs)


@add("J04_remittance_amount_hits", "SELECT transaction_id, rem_n, rem_doc.id AS first_id FROM amount_hits", RECON_NEEDS, RECON_CTES)
def j04(d: Domain):
    return _amounts(d).filter("rem_n > 0").select("transaction_id", "rem_n", F.col("rem_doc.id").alias("first_id"))


@add("J06_document_amount_hits", "SELECT transaction_id, com_n, com_doc.id AS first_id FROM doc_hits", RECON_NEEDS, RECON_CTES)
def j06(d: Domain):
    return _amounts(d).filter("com_n > 0").select("transaction_id", "com_n", F.col("com_doc.id").alias("first_id"))


def _amounts(d: Domain):
    docs = matching.documents(d.sales_orders, d.purchase_orders, d.remittances)
    classes = matching.amount_classes(docs).withColumnRenamed("amount", "abs_amount")
    return matching.bank_lines(d.once("bank_transactions")).join(classes, list(matching.AMOUNT_CLASS))


@add("J05_remittance_name_hits", "SELECT transaction_id, named_n, named_doc.id AS first_id FROM name_hits", RECON_NEEDS, RECON_CTES)
def j05(d: Domain):
    context = recon.amount_context(d.once("bank_transactions"), matching.documents(d.sales_orders, d.purchase_orders, d.remittances))
    return context.filter("named_n > 0").select("transaction_id", "named_n", F.col("named_doc.id").alias("first_id"))


@add("A01_recon_summary", """SELECT count(*) AS total, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'partial') AS partial,
  count(*) FILTER (status = 'unmatched') AS unmatched, round(CAST(sum(abs(amount)) FILTER (status <> 'unmatched') AS DOUBLE) / CAST(sum(abs(amount)) AS DOUBLE), 6) AS match_rate FROM recon""", RECON_NEEDS, RECON_CTES)
def a01(d: Domain):
    return recon.summarise(results_of(d, kept=False)).withColumn("match_rate", F.round("match_rate", 6))


@add("A20_status_shares", "SELECT status, count(*) AS lines, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM recon GROUP BY status", RECON_NEEDS, RECON_CTES)
def a20(d: Domain):
    return recon.status_shares(results_of(d, kept=False)).withColumn("share", F.round("share", 6))


@add("P01_recon_filter", "SELECT transaction_id, status, currency, amount FROM recon WHERE status = 'partial' AND currency = 'EUR'", RECON_NEEDS, RECON_CTES)
def p01(d: Domain):
    return recon.filter_results(results_of(d, kept=False), "partial", "EUR").select("transaction_id", "status", "currency", "amount")


@add("U05_recon_currencies", "SELECT DISTINCT currency FROM bank_transactions", LINES)
def u05(d: Domain):
    return d.bank_transactions.select("currency").distinct().orderBy("currency")


# --- forecast -------------------------------------------------------------

FORECAST_NEEDS = (*RECON_NEEDS, "statements", "bank_accounts")
FORECAST_CTES = RECON_CTES + rf""",
period AS (SELECT min(period_start) AS start FROM statements),
live AS MATERIALIZED (SELECT r.* FROM remittances r, period WHERE r.date >= start),
live_keys AS (SELECT DISTINCT id, {norm_key('k')} AS key FROM (SELECT id, unnest(list_concat([id, reference, remittance_number], invoice_numbers)) AS k FROM live) WHERE trim(k) <> ''),
named_results AS (SELECT transaction_id, {norm_key('matched_id')} AS key FROM recon WHERE status <> 'unmatched' AND matched_id IS NOT NULL),
key_ids AS (SELECT DISTINCT id FROM live_keys WHERE key IN (SELECT key FROM named_results)),
key_lines AS (SELECT DISTINCT transaction_id FROM named_results WHERE key IN (SELECT key FROM live_keys)),
free_lines AS (
  SELECT CASE WHEN amount > 0 THEN 'customer' ELSE 'vendor' END AS party, currency, abs(amount) AS amount,
    row_number() OVER (PARTITION BY amount > 0, currency, abs(amount) ORDER BY date, transaction_id) AS rn
  FROM recon WHERE status = 'matched' AND amount <> 0 AND transaction_id NOT IN (SELECT transaction_id FROM key_lines)),
left_over AS (
  SELECT id, party, currency, amount, row_number() OVER (PARTITION BY party, currency, amount ORDER BY date, id) AS rn
  FROM live WHERE id NOT IN (SELECT id FROM key_ids)),
amount_ids AS (SELECT o.id FROM left_over o JOIN free_lines f USING (party, currency, amount, rn)),
consumed AS MATERIALIZED (SELECT id FROM key_ids UNION SELECT id FROM amount_ids)
"""


def _forecast_inputs(d: Domain, kept: bool = True):
    live = forecast.in_period(d.remittances, d.statements)
    return live, results_of(d, kept)


@add("J08_consumed_by_key", "SELECT id FROM key_ids", FORECAST_NEEDS, FORECAST_CTES)
def j08(d: Domain):
    return forecast.consumed_by_key(*_forecast_inputs(d, kept=False))[0]


@add("J09_consumed_by_amount", "SELECT id FROM amount_ids", FORECAST_NEEDS, FORECAST_CTES)
def j09(d: Domain):
    live, results = _forecast_inputs(d)
    return forecast.consumed_by_amount(live, results, *forecast.consumed_by_key(live, results))


@add("P12_forecast_lines_in", """SELECT id, party, 'in' AS direction, name, reference, amount, currency, date, remittance_number, status
FROM live WHERE party = 'customer' AND id NOT IN (SELECT id FROM consumed)""", FORECAST_NEEDS, FORECAST_CTES)
def p12(d: Domain):
    live, results = _forecast_inputs(d)
    return forecast.forecast_lines(live, forecast.consumed_ids(live, results), "in")


@add("A05_cash_forecast", """SELECT coalesce(s.currency, p.currency) AS currency, coalesce(predicted_inflows, 0) AS predicted_inflows, coalesce(predicted_outflows, 0) AS predicted_outflows,
  coalesce(identified_count, 0) AS identified_count, coalesce(forecast_count, 0) AS forecast_count, coalesce(inflow_count, 0) AS inflow_count, coalesce(outflow_count, 0) AS outflow_count,
  coalesce(p.closing_balance, 0) AS statement_closing, coalesce(predicted_inflows - predicted_outflows, 0) AS net_predicted,
  coalesce(p.closing_balance, 0) + coalesce(predicted_inflows - predicted_outflows, 0) AS projected_closing
FROM sums s FULL JOIN currency_position p ON p.currency = s.currency WHERE p.currency IS NOT NULL OR forecast_count > 0""", FORECAST_NEEDS, FORECAST_CTES + "," + POSITION_CTES + """,
flagged AS (SELECT l.*, c.id IS NULL AS pending FROM live l LEFT JOIN consumed c ON c.id = l.id),
sums AS (SELECT currency, CAST(coalesce(sum(amount) FILTER (pending AND party = 'customer'), 0) AS BIGINT) AS predicted_inflows,
  CAST(coalesce(sum(amount) FILTER (pending AND party = 'vendor'), 0) AS BIGINT) AS predicted_outflows, count(*) FILTER (NOT pending) AS identified_count,
  count(*) FILTER (pending) AS forecast_count, count(*) FILTER (pending AND party = 'customer') AS inflow_count, count(*) FILTER (pending AND party = 'vendor') AS outflow_count
  FROM flagged GROUP BY currency)""")
def a05(d: Domain):
    live, results = _forecast_inputs(d)
    closing = cash.currency_positions(_positions(d))
    return forecast.forecast(live, forecast.consumed_ids(live, results), closing)


# --- anomalies ------------------------------------------------------------

ANOMALY_NEEDS = (*RECON_NEEDS, "bank_accounts")
_PARTY = "coalesce(counterparty, reference, 'Transaction')"
ANOMALY_CTES = RECON_CTES + f""",
grouped AS (
  SELECT *, first_value(id) OVER w AS first_id, first_value(date) OVER w AS first_date
  FROM bank_transactions WINDOW w AS (PARTITION BY account_id, amount, lower(coalesce(counterparty, reference, '')) ORDER BY date, id)),
dups AS MATERIALIZED (SELECT * FROM grouped WHERE id <> first_id AND abs(date_diff('day', CAST(first_date AS DATE), CAST(date AS DATE))) <= 5),
joined AS MATERIALIZED (SELECT r.*, t.counterparty FROM recon r JOIN bank_transactions t ON t.id = r.transaction_id),
large AS (SELECT * FROM joined WHERE status = 'unmatched' AND abs(amount) >= 4000000),
pool AS (SELECT *, CASE WHEN amount > 0 THEN 'in' WHEN amount < 0 THEN 'out' END AS direction FROM bank_transactions
  WHERE id NOT IN (SELECT id FROM dups) AND id NOT IN (SELECT transaction_id FROM large)),
stats AS (SELECT currency, direction, count(*) AS samples, avg(abs(amount)) AS mean, stddev_pop(abs(amount)) AS deviation FROM pool WHERE amount <> 0 GROUP BY 1, 2),
high AS (SELECT p.*, s.mean FROM pool p JOIN stats s USING (currency, direction) WHERE samples >= 5 AND abs(p.amount) > s.mean + 2 * s.deviation),
closings AS (
  SELECT a.id, a.name, a.currency, CAST(coalesce(
      (arg_min(t.balance_after - t.amount, struct_pack(d := t.date, l := coalesce(-t.line_number, 0), i := t.id)) FILTER (t.balance_after IS NOT NULL)), a.opening_balance)
    + coalesce(sum(t.amount), 0) AS BIGINT) AS closing
  FROM bank_accounts a LEFT JOIN bank_transactions t ON t.account_id = a.id GROUP BY a.id, a.name, a.currency, a.opening_balance),
anomalies AS (
  SELECT 'AN-DUP-' || id AS id, 'duplicate' AS type, 'high' AS severity, {_PARTY} || ' of ' || {plain('abs(amount)')} || ' ' || currency || ' on ' || date || ' matches ' || first_date || ' (' || first_id || ').' AS description,
    abs(amount) AS amount, currency, date, first_id || ',' || id AS related FROM dups
  UNION ALL SELECT 'AN-MIS-' || transaction_id, 'amount_mismatch', 'medium', 'Bank amount for ' || matched_id || ' differs by ' || {plain('amount_diff')} || ' ' || currency || ' (' || coalesce(counterparty, '') || ').',
    abs(amount), currency, date, transaction_id || ',' || matched_id FROM joined WHERE status = 'partial' AND matched_id IS NOT NULL AND amount_diff <> 0
  UNION ALL SELECT 'AN-UNM-' || transaction_id, 'unmatched_large', CASE WHEN abs(amount) >= 7500000 THEN 'high' ELSE 'medium' END,
    CASE WHEN amount > 0 THEN 'Receipt' ELSE 'Payment' END || ' of ' || {plain('abs(amount)')} || ' ' || currency || CASE WHEN counterparty <> '' THEN ' (' || counterparty || ')' ELSE '' END
      || ' has no supporting ' || CASE flow WHEN 'O2C' THEN 'sales order or remittance' ELSE 'purchase order or remittance' END || ' to identify it.',
    abs(amount), currency, date, transaction_id FROM large
  UNION ALL SELECT 'AN-OUT-' || id, 'outlier', 'low', {_PARTY} || ' of ' || {plain('abs(amount)')} || ' ' || currency || ' is well above the typical ' || CASE direction WHEN 'in' THEN 'receipt' ELSE 'payment' END
      || ' (~' || {plain('CAST(floor(mean + 0.5) AS BIGINT)')} || ' ' || currency || ').', abs(amount), currency, date, id FROM high
  UNION ALL SELECT 'AN-OVR-' || id, 'overdraft_risk', 'high', name || ' closing balance is ' || {plain('closing')} || ' ' || currency || '.', closing, currency, NULL, id FROM closings WHERE closing < 0)
"""


def flat(anomaly_df):
    return anomaly_df.withColumn("related", F.array_join("related_ids", ",")).select("id", "type", "severity", "description", "amount", "currency", "date", "related")


def detected(d: Domain):
    return d.remember("anomalies", lambda: anomalies.detect(d.bank_accounts, d.once("bank_transactions"), results_of(d, kept=False)))


@add("D03a_duplicates", "SELECT * FROM anomalies WHERE type = 'duplicate'", ANOMALY_NEEDS, ANOMALY_CTES)
def d03a(d: Domain):
    return flat(anomalies.duplicates(d.bank_transactions))


@add("W04_duplicate_window", "SELECT id, first_id, first_date FROM dups", ANOMALY_NEEDS, ANOMALY_CTES)
def w04(d: Domain):
    dup = anomalies.duplicates(d.bank_transactions)
    first = d.bank_transactions.select(F.col("id").alias("first_id"), F.col("date").alias("first_date"))
    return dup.select(F.col("transaction_id").alias("id"), F.col("related_ids")[0].alias("first_id")).join(first, "first_id").select("id", "first_id", "first_date")


@add("D03b_amount_mismatches", "SELECT * FROM anomalies WHERE type = 'amount_mismatch'", ANOMALY_NEEDS, ANOMALY_CTES)
def d03b(d: Domain):
    return flat(anomalies.amount_mismatches(results_of(d, kept=False), d.once("bank_transactions")))


@add("D03c_unmatched_large", "SELECT * FROM anomalies WHERE type = 'unmatched_large'", ANOMALY_NEEDS, ANOMALY_CTES)
def d03c(d: Domain):
    return flat(anomalies.unmatched_large(results_of(d, kept=False), d.once("bank_transactions")))


@add("D03d_outliers", "SELECT * FROM anomalies WHERE type = 'outlier'", ANOMALY_NEEDS, ANOMALY_CTES)
def d03d(d: Domain):
    results, lines = results_of(d, kept=False), d.once("bank_transactions")
    flagged = anomalies.duplicates(lines).select("transaction_id").unionByName(anomalies.unmatched_large(results, lines).select("transaction_id"))
    return flat(anomalies.outliers(lines, flagged))


@add("D03e_overdraft_risk", "SELECT * FROM anomalies WHERE type = 'overdraft_risk'", ANOMALY_NEEDS, ANOMALY_CTES)
def d03e(d: Domain):
    return flat(anomalies.overdraft_risk(d.bank_accounts, d.bank_transactions))


@add("D03_all_anomalies", "SELECT * FROM anomalies", ANOMALY_NEEDS, ANOMALY_CTES)
def d03(d: Domain):
    return flat(detected(d))


@add("T05_anomalies_by_severity", "SELECT id, severity, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rank FROM anomalies", ANOMALY_NEEDS, ANOMALY_CTES)
def t05(d: Domain):
    return anomalies.by_severity(detected(d)).select("id", "severity", anomalies.severity_rank().alias("rank"))


@add("A13_anomaly_counts", "SELECT severity, count(*) AS anomalies FROM anomalies GROUP BY severity", ANOMALY_NEEDS, ANOMALY_CTES)
def a13(d: Domain):
    return anomalies.counts_by_severity(detected(d))


@add("P02_anomalies_by_currency", "SELECT * FROM anomalies WHERE currency = 'USD'", ANOMALY_NEEDS, ANOMALY_CTES)
def p02(d: Domain):
    return flat(detected(d)).filter("currency = 'USD'")


@add("A15_direction_stats", "SELECT currency, CASE WHEN amount > 0 THEN 'in' ELSE 'out' END AS direction, count(*) AS samples, round(avg(abs(amount)), 2) AS mean, round(stddev_pop(abs(amount)), 2) AS deviation FROM bank_transactions WHERE amount <> 0 GROUP BY 1, 2", LINES)
def a15(d: Domain):
    out = anomalies.direction_stats(d.bank_transactions)
    return out.withColumn("mean", F.round("mean", 2)).withColumn("deviation", F.round("deviation", 2))
