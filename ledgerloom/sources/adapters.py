"""Domain tables derived from the star-schema test tables.

Each table is one SELECT in the SQL subset that Spark and other engines share,
with its inputs named in braces; :func:`domain` builds it on Spark and
:func:`domain_ctes` gives the same definitions as a WITH clause.
"""

from __future__ import annotations

import itertools
import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import split_shuffles

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _place(n: str) -> str:
    return f"CASE {n} % 6 WHEN 0 THEN 'Northgate' WHEN 1 THEN 'Riverton' WHEN 2 THEN 'Oakfield' WHEN 3 THEN 'Ashby' WHEN 4 THEN 'Leeds' ELSE 'Kent' END"


def _trade(n: str) -> str:
    return f"CASE {n} % 5 WHEN 0 THEN 'Mills' WHEN 1 THEN 'Foods' WHEN 2 THEN 'Steel' WHEN 3 THEN 'Textiles' ELSE 'Care' END"


def _currency(region: str) -> str:
    return f"CASE {region} % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _pad(expr: str, n: int) -> str:
    return f"lpad({_s(expr)}, {n}, '0')"


#: Tables that stay persisted. Orders, purchase orders and remittances are projections of the first two, cheaper to write anew than to hold.
FACTS = ("order_facts", "purchase_facts", "bank_transactions")
# Rows of a base table that one task of a shuffle gets, about; the number of tasks grows with the table.
ROWS_PER_TASK = 250_000

DOMAIN: dict[str, str] = {}

DOMAIN["bank_accounts"] = f"""
SELECT 'ACC-' || {_s('n.n_nationkey')} AS id, n.n_name || ' Operating' AS name, 'Bank of ' || r.r_name AS bank,
  {_currency('n.n_regionkey')} AS currency, coalesce(s.cents, 0) AS opening_balance,
  'GB' || lpad({_s('n.n_nationkey')}, 20, '7') AS iban, lpad({_s('n.n_nationkey')}, 8, '4') AS account_number, 'BICX' || {_pad('n.n_nationkey', 4)} AS bic
FROM {{nation}} n JOIN {{region}} r ON r.r_regionkey = n.n_regionkey
LEFT JOIN (SELECT s_nationkey, CAST(sum(CAST(floor(s_acctbal * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM {{supplier}} GROUP BY s_nationkey) s
  ON s.s_nationkey = n.n_nationkey
"""

# One row per order: the sales order and the bank credit that pays it share these values.
DOMAIN["order_facts"] = f"""
SELECT o.o_orderkey AS k, {_s('o.o_orderkey')} AS ks, c.c_custkey AS party_key, c.c_nationkey AS nation_key,
  {_currency('n.n_regionkey')} AS currency, o.o_orderstatus AS raw_status, o.o_orderdate AS ts, CAST(o.o_orderdate AS DATE) AS d,
  CASE WHEN o.o_orderkey % 11 = 0 THEN CAST(floor(o.o_totalprice / 5000 + 0.5) AS BIGINT) * 500000 ELSE CAST(floor(o.o_totalprice * 100 + 0.5) AS BIGINT) END AS cents,
  {_place('c.c_custkey')} || ' ' || {_trade('(c.c_custkey + o.o_orderkey)')} || ' Ltd' AS party_name
FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
"""

_LINE_CENTS, _LINE_DAY = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)", "CAST(l_shipdate AS DATE)"

# One row per (order, supplier): line numbers repeat in the source, so lines are summed first.
DOMAIN["purchase_facts"] = f"""
SELECT l.l_orderkey AS k, l.l_suppkey AS sk, {_s('l.l_orderkey')} || {_pad('l.l_suppkey', 9)} AS dk, s.s_nationkey AS nation_key,
  {_currency('n.n_regionkey')} AS currency, l.d AS d, CASE WHEN l.l_orderkey % 13 = 0 THEN CAST(floor(l.cents / 500000.0 + 0.5) AS BIGINT) * 500000 ELSE l.cents END AS cents,
  {_place('l.l_suppkey')} || ' ' || {_trade('(l.l_suppkey + l.l_orderkey)')} || ' plc' AS party_name
FROM (SELECT l_orderkey, l_suppkey, CAST(sum({_LINE_CENTS}) AS BIGINT) AS cents, min({_LINE_DAY}) AS d
      FROM {{lineitem}} GROUP BY l_orderkey, l_suppkey) l
JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey JOIN {{nation}} n ON n.n_nationkey = s.s_nationkey
"""

DOMAIN["sales_orders"] = f"""
SELECT 'SO-' || ks AS id, party_name AS customer, cents AS amount, currency, {_s('d')} AS order_date, {_s('d + 30')} AS due_date,
  CASE raw_status WHEN 'O' THEN 'open' WHEN 'F' THEN 'collected' ELSE 'invoiced' END AS status, 'CPO' || ks AS customer_po,
  'OU ' || {_s('nation_key')} AS operating_unit, 'SO_Header_112.csv' AS source_file, k AS source_row
FROM {{order_facts}}
"""

DOMAIN["purchase_orders"] = f"""
SELECT CASE WHEN (k + sk) % 4 = 1 THEN 'AP-' ELSE 'PO-' END || dk AS id, party_name AS vendor, cents AS amount, currency,
  {_s('d')} AS order_date, {_s('d + 30')} AS due_date, CASE WHEN k % 9 = 0 THEN 'paid' ELSE 'billed' END AS status,
  CASE WHEN (k + sk) % 4 = 1 THEN 'V' || {_pad('k', 8)} END AS invoice_number,
  CASE WHEN (k + sk) % 4 = 1 THEN split('PO-' || dk, ',') WHEN k % 5 = 0 THEN split('PO-' || dk || ',' || 'R' || {_pad('k', 8)}, ',') ELSE split('PO-' || dk, ',') END AS po_numbers,
  'OU ' || {_s('nation_key')} AS operating_unit, 'GB' AS country, 'PO_Header_112.csv' AS source_file, k * 1000000 + sk AS source_row
FROM {{purchase_facts}}
"""

DOMAIN["remittances"] = f"""
SELECT 'AR-' || ks AS id, 'customer' AS party, party_name AS name,
  CASE WHEN k % 12 = 0 THEN 'BACS' ELSE 'INV' || {_pad('k', 8)} END AS reference, cents AS amount, currency,
  CASE WHEN k % 33 = 0 THEN {_s('d - 400')} ELSE {_s('d + 1')} END AS date,
  CASE WHEN k % 6 = 0 THEN 'RN' || {_pad('k', 9)} ELSE 'DD' END AS remittance_number,
  CASE WHEN k % 12 = 0 THEN split('INV' || {_pad('k', 8)} || ',' || 'BATCH' || {_pad('k % 97', 6)}, ',') ELSE split('INV' || {_pad('k', 8)}, ',') END AS invoice_numbers,
  'UK ' || {_s('nation_key')} AS operating_unit, 'CLEARED' AS status, 'REM_112.csv' AS source_file, k * 2 AS source_row
FROM {{order_facts}} WHERE k % 3 = 0
UNION ALL
SELECT 'AP-' || dk AS id, 'vendor' AS party, party_name AS name, 'PAY' || {_pad('sk', 7)} || 'X' AS reference, cents AS amount, currency,
  {_s('d + 1')} AS date, 'PN' || {_pad('k', 8)} AS remittance_number, split('V' || {_pad('k', 8)}, ',') AS invoice_numbers,
  'UK ' || {_s('nation_key')} AS operating_unit, 'NEGOTIABLE' AS status, 'REM_112.csv' AS source_file, k * 2000000 + sk * 2 + 1 AS source_row
FROM {{purchase_facts}} WHERE (k * 7 + sk) % 5 = 0
"""

_CREDIT = f"""
SELECT 'C-' || ks || '{{suffix}}' AS id, 'ACC-' || {_s('nation_key')} AS account_id, {_s('d + {shift}')} AS date,
  CASE WHEN k % 21 = 0 THEN 'Receipt INV' || {_pad('k', 8)} WHEN k % 7 = 0 THEN 'Counter credit' ELSE 'Sales receipt' END AS description,
  CASE WHEN k % 7 = 0 THEN CAST(NULL AS STRING) WHEN k % 13 = 0 THEN 'SO-' || ks || ' SO-' || {_s('k + 1')} ELSE 'SO-' || ks END AS reference,
  CASE WHEN k % 17 = 0 THEN CAST(NULL AS STRING) ELSE party_name END AS counterparty,
  CASE WHEN k % 10 = 0 THEN cents - 100000 ELSE cents END AS amount, currency,
  CASE WHEN k % 5 = 0 THEN cents + (k * 37) % 1000000 END AS balance_after, 'ST-' || {_s('nation_key')} || '-' || substr({_s('d')}, 1, 7) AS statement_id,
  CASE WHEN k % 35 = 0 THEN 'BATCH' || {_pad('k % 97', 6)} || ' ' || party_name ELSE CAST(NULL AS STRING) END AS narrative,
  CAST(NULL AS STRING) AS customer_reference, CAST(NULL AS STRING) AS bank_reference, CAST(k % 1000 AS BIGINT) AS line_number,
  'BANK_' || {_s('nation_key')} || '.csv' AS source_file
FROM {{{{order_facts}}}}
"""

DOMAIN["bank_transactions"] = (
    _CREDIT.replace("{suffix}", "").replace("{shift}", "0").replace("{{order_facts}}", "{order_facts}")
    + " UNION ALL "
    + _CREDIT.replace("{suffix}", "-D").replace("{shift}", "1").replace("{{order_facts}}", "{order_facts}")
    + " WHERE k % 50 = 0 UNION ALL "
    + f"""
SELECT 'D-' || dk AS id, 'ACC-' || {_s('nation_key')} AS account_id, {_s('d')} AS date,
  CASE WHEN (k + sk) % 6 = 5 THEN 'Supplier run ' || party_name ELSE 'Supplier payment' END AS description,
  CASE (k + sk) % 6 WHEN 1 THEN 'PO-' || dk WHEN 2 THEN 'PO-' || dk WHEN 3 THEN 'Invoice V' || {_pad('k', 8)} WHEN 4 THEN 'PAY' || {_pad('sk', 7)} || 'X' ELSE CAST(NULL AS STRING) END AS reference,
  CASE WHEN k % 4 = 0 THEN CAST(NULL AS STRING) ELSE party_name END AS counterparty,
  -(CASE WHEN k % 10 = 3 THEN cents + 12345 ELSE cents END) AS amount, currency,
  CASE WHEN k % 5 = 0 THEN cents END AS balance_after, 'ST-' || {_s('nation_key')} || '-' || substr({_s('d')}, 1, 7) AS statement_id,
  CAST(NULL AS STRING) AS narrative, CASE WHEN (k + sk) % 6 = 0 AND k % 2 = 0 THEN 'PN' || {_pad('k', 8)} END AS customer_reference,
  CAST(NULL AS STRING) AS bank_reference, CAST(k % 1000 AS BIGINT) AS line_number, 'BANK_' || {_s('nation_key')} || '.csv' AS source_file
FROM {{purchase_facts}}
""".replace("{{", "{").replace("}}", "}")
)

DOMAIN["statements"] = """
SELECT statement_id AS id, min(account_id) AS account_id, statement_id || '.csv' AS file_name,
  CASE WHEN substr(statement_id, 4, 1) = '1' THEN 'sample' ELSE 'oci' END AS source,
  min(date) AS period_start, max(date) AS period_end, count(*) AS transaction_count, 'bank/' || statement_id || '.csv' AS storage_key
FROM {bank_transactions} GROUP BY statement_id
"""


# ERP extract rows: text cells as the source systems write them.
DOMAIN["so_headers"] = f"""
SELECT ks || '.000' AS sourcetransid, CASE WHEN k % 9 = 0 THEN CAST(NULL AS STRING) ELSE ks || '.00' END AS source_trans_num,
  CASE WHEN k % 15 = 0 THEN '' ELSE party_name END AS byng_pty_nme, lower(currency) AS transal_crncy_code,
  CASE WHEN k % 4 = 0 THEN replace({_s('d')}, '-', '/') ELSE {_s('d')} || ' 00:00:00' END AS trans_on, 'CPO' || ks AS cust_ponum, '' AS rqstng_bu_unit, k * 2 + 2 AS row_number
FROM {{order_facts}} UNION ALL
SELECT ks AS sourcetransid, ks AS source_trans_num, 'Repeat of ' || ks AS byng_pty_nme, 'EUR' AS transal_crncy_code, {_s('d')} AS trans_on, '' AS cust_ponum, 'BU' AS rqstng_bu_unit, k * 2 + 3 AS row_number
FROM {{order_facts}} WHERE k % 8 = 0
"""
DOMAIN["so_charges"] = """
SELECT ks AS source_trans_id, 'QP_NET_PRICE' AS price_element_code, CAST(cents / 100 AS STRING) AS charge_crncy_extended_amount FROM {order_facts} WHERE k % 10 <> 1
UNION ALL SELECT ks || '.0' AS source_trans_id, 'qp_net_price' AS price_element_code, '1,250.5' AS charge_crncy_extended_amount FROM {order_facts} WHERE k % 3 = 0
UNION ALL SELECT ks AS source_trans_id, 'QP_LIST_PRICE' AS price_element_code, '9999' AS charge_crncy_extended_amount FROM {order_facts} WHERE k % 2 = 0
"""
DOMAIN["ap_headers"] = f"""
SELECT dk || '.00' AS invoice_id, CASE WHEN k % 7 = 0 THEN '' ELSE ' V' || {_pad('k', 8)} END AS invoice_number,
  CASE WHEN k % 2 = 0 THEN '0' ELSE CAST(cents / 100 AS STRING) END AS invoice_amount, CAST(cents / 100 AS STRING) AS discountable_amount,
  CASE WHEN k % 6 = 0 THEN 'n/a' ELSE '20.25' END AS tax_control_amount, {_s('d')} AS invoice_date, CASE WHEN k % 5 = 0 THEN '' ELSE {_s('d + 14')} END AS terms_date,
  party_name AS supplier_name, CASE WHEN k % 3 = 0 THEN '' ELSE currency END AS invoice_currency, 'gbp' AS payment_currency, 'STANDARD' AS invoice_type, 'UK BU' AS business_unit,
  CASE k % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'UK' WHEN 2 THEN 'FR' ELSE 'GBR' END AS taxation_country, k * 1000000 + sk AS row_number
FROM {{purchase_facts}}
"""
DOMAIN["ap_lines"] = f"""
SELECT dk AS invoice_id, 'PO' || {_s('sk')} AS po_number, k * 1000000 + sk AS row_number FROM {{purchase_facts}} WHERE k % 3 <> 2
UNION ALL SELECT dk || '.0' AS invoice_id, ' PX' || {_s('k')} AS po_number, k * 1000000 + sk + 500000 AS row_number FROM {{purchase_facts}} WHERE k % 2 = 0
UNION ALL SELECT dk AS invoice_id, 'PO' || {_s('sk')} AS po_number, k * 1000000 + sk + 700000 AS row_number FROM {{purchase_facts}} WHERE k % 5 = 0
"""
DOMAIN["po_headers"] = f"""
SELECT CASE WHEN k % 3 = 0 THEN '' ELSE dk || '.0' END AS po_number, CASE WHEN k % 3 = 0 THEN 'PO_' || dk ELSE '' END AS po_order, 'H' || dk AS interface_header_key,
  CASE WHEN k % 4 = 0 THEN CAST(cents / 100 AS STRING) ELSE '' END AS amount, {_s('d')} AS ordered_date, CASE WHEN k % 2 = 0 THEN {_s('d + 9')} END AS need_by_date, party_name AS vendor_name,
  CASE WHEN k % 5 = 0 THEN '' ELSE lower(currency) END AS currency_code, CASE k % 5 WHEN 0 THEN 'Cancelled' WHEN 1 THEN 'Finally Closed' WHEN 2 THEN 'CLOSED' WHEN 3 THEN 'Open' ELSE '' END AS status,
  CASE k % 7 WHEN 0 THEN 'GB' WHEN 1 THEN 'FR' ELSE '' END AS country, CASE k % 6 WHEN 0 THEN 'Acme UK Ltd' WHEN 1 THEN 'Acme France' ELSE '' END AS operating_unit, CASE k % 8 WHEN 0 THEN '112' WHEN 1 THEN '112.00' ELSE '' END AS org_id,
  k * 1000000 + sk AS row_number
FROM {{purchase_facts}}
"""
DOMAIN["po_lines"] = f"""
SELECT dk AS po_number, CASE WHEN k % 11 = 0 THEN dk ELSE 'H' || dk END AS po_header_id, CASE WHEN k % 2 = 0 THEN CAST(cents / 100 AS STRING) ELSE '' END AS line_amount,
  {_s('k % 50')} AS quantity, '1,0' || {_s('sk % 10')} || '.5' AS unit_price FROM {{purchase_facts}}
UNION ALL SELECT '' AS po_number, 'H' || dk AS po_header_id, '10.10' AS line_amount, '' AS quantity, '' AS unit_price FROM {{purchase_facts}} WHERE k % 6 = 0
"""
DOMAIN["remittance_extract"] = f"""
SELECT CASE WHEN k % 4 = 0 THEN 'CUSTOMER_TO_OU' ELSE 'OU_TO_SUPPLIER' END AS flow_direction, CASE WHEN k % 8 = 0 THEN 'ap' ELSE 'AR' END AS source_module,
  CASE WHEN k % 9 = 0 THEN '112' ELSE '205' END AS org_id, CASE WHEN k % 5 = 0 THEN 'OU: UK Operations' ELSE 'OU: FR' END AS operating_unit_name,
  {_s('k')} || '.000' AS remittance_id, 'RN-' || {_s('k')} AS remittance_number, {_s('d')} AS remittance_date, ' CLEARED ' AS remittance_status,
  CASE WHEN k % 3 = 0 THEN '' ELSE currency END AS payment_currency_code, CAST(cents / 100 AS STRING) AS payment_total_amount,
  CASE WHEN sk % 6 = 0 THEN '' ELSE ' V' || {_s('sk % 4')} END AS invoice_number, CASE WHEN k % 10 = 0 THEN '' ELSE party_name END AS counterparty_name, k * 1000000 + sk AS row_number
FROM {{purchase_facts}}
"""
DOMAIN["statement_headers"] = f"""
SELECT 'SH-' || {_s('o.k')} AS statement_id, CASE o.k % 4 WHEN 0 THEN substr(a.iban, 1, 4) || ' ' || lower(substr(a.iban, 5)) WHEN 1 THEN '' ELSE CAST(NULL AS STRING) END AS iban,
  CASE o.k % 4 WHEN 1 THEN substr(a.account_number, 1, 4) || '-' || substr(a.account_number, 5) WHEN 2 THEN a.id || ' 9' ELSE '' END AS account_number
FROM {{order_facts}} o JOIN {{bank_accounts}} a ON a.id = 'ACC-' || {_s('o.nation_key')}
"""


# Supplier master: one supplier per customer row, two sites each.
DOMAIN["suppliers"] = f"""
SELECT {_s('c_custkey')} AS id, CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'SN' || {_s('c_custkey')} END AS supplier_number,
  CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE {_place('c_custkey')} || ' ' || {_trade('c_custkey')} || ' Ltd' END AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'Corporation' WHEN 1 THEN 'CORPORATION' WHEN 2 THEN 'Sole trader' WHEN 3 THEN '' ELSE 'GOVERNMENT' END AS type,
  'active' AS status, CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'BE' || {_pad('c_custkey', 8)} || lpad({_s('97 - c_custkey % 97')}, 2, '0') WHEN 2 THEN 'NL' || {_pad('c_custkey', 9)} || 'B01'
    WHEN 3 THEN 'PT ' || {_pad('c_custkey * 7', 9)} WHEN 4 THEN {_pad('c_custkey', 9)} WHEN 5 THEN 'IT' || {_pad('c_custkey * 13', 11)} WHEN 6 THEN 'GB' || {_pad('c_custkey * 31', 9)} ELSE 'uk-' || {_pad('c_custkey', 9)} END AS supplier_vat,
  '' AS tax_registration_number, CASE WHEN c_custkey % 16 = 0 THEN 'DE' || {_pad('c_custkey', 9)} ELSE '' END AS taxpayer_id, c_custkey % 10 = 0 AS one_time,
  CASE WHEN c_custkey % 14 = 0 THEN '2024-01-31' END AS inactive_date, 'oci-supplier' AS source, CAST(1 AS BIGINT) AS version, '2024-01-01T00:00:00Z' AS updated_at
FROM {{customer}}
"""
DOMAIN["supplier_sites"] = f"""
SELECT {_s('c_custkey')} || '-' || {_s('n')} AS id, {_s('c_custkey')} AS supplier_id, CASE WHEN c_custkey % 12 = 0 THEN ' MAIN ' ELSE 'SITE' || {_s('n')} END AS site_code, 'HQ' AS address_name, 'BU ' || c_mktsegment AS procurement_bu,
  CASE WHEN c_custkey % 3 = 0 THEN 'OU: UK' END AS operating_unit, CASE WHEN c_custkey % 3 = 0 THEN '112' END AS org_id, CASE WHEN c_custkey % 19 = 0 THEN '2024-02-01' END AS inactive_date,
  CASE (c_custkey + n) % 9 WHEN 0 THEN '30 days' WHEN 1 THEN '30 Days' WHEN 2 THEN 'NET 30' WHEN 3 THEN '' WHEN 4 THEN 'Due on Receipt' WHEN 5 THEN '45 Days' WHEN 6 THEN 'Terms ' || {_s('c_custkey % 700')} ELSE '14 Days' END AS payment_terms,
  CASE (c_custkey + n) % 6 WHEN 0 THEN 'eur eft' WHEN 1 THEN 'EUR EFT' WHEN 2 THEN 'Domestic' WHEN 3 THEN ' ' WHEN 4 THEN 'GB bacs' ELSE 'Group ' || {_s('c_custkey % 900')} END AS pay_group,
  CASE c_custkey % 5 WHEN 0 THEN 'Cheque' WHEN 1 THEN 'BACS' WHEN 2 THEN '' WHEN 3 THEN 'e.f.t' ELSE 'CARD' END AS payment_method, 'EUR' AS invoice_currency, 'EUR' AS payment_currency,
  CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'BE' WHEN 2 THEN 'NL' WHEN 3 THEN 'PT' WHEN 4 THEN 'DE' WHEN 5 THEN 'IT' ELSE 'GB' END AS country,
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE {_s('n')} || ' High Street' END AS address_line1, CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'Brussels 1000' WHEN 2 THEN 'London SW1A 1AA' ELSE {_place('c_custkey')} END AS city,
  CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '1000' WHEN 2 THEN 'NL 1234 AB' WHEN 3 THEN '12345' WHEN 4 THEN 'SW1A 1AA' ELSE '1234-567' END AS postal_code,
  CASE (c_custkey + n) % 4 WHEN 0 THEN '' WHEN 1 THEN 'BE' || {_pad('c_custkey', 8)} || lpad({_s('97 - c_custkey % 97')}, 2, '0') WHEN 2 THEN 'PT ' || {_pad('c_custkey * 7', 9)} ELSE 'DE 12' END AS site_vat,
  CASE WHEN c_custkey % 4 = 0 THEN 'erp' ELSE 'oci-supplier' END AS source, CAST(1 AS BIGINT) AS version, '2024-01-01T00:00:00Z' AS updated_at
FROM {{customer}} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) sites
"""
# Supplier extracts: text cells, ids sometimes with decimals, repeats in file order.
DOMAIN["profile_extract"] = f"""
SELECT {_s('c_custkey')} || CASE WHEN c_custkey % 3 = 0 THEN '.00000000' ELSE '' END AS vid, 'N' || {_s('c_custkey')} AS supplier_number, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Profile ' || c_name END AS supplier_name,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'CORPORATION' END AS tax_organization_type, CASE WHEN c_custkey % 7 = 0 THEN '2023-01-01' ELSE '' END AS inactive_date, CASE c_custkey % 3 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' ELSE '1' END AS one_time_supplier,
  CASE WHEN c_custkey % 4 = 0 THEN 'TP' || {_s('c_custkey')} ELSE '' END AS taxpayer_id, CASE WHEN c_custkey % 9 = 0 THEN 'TR' || {_s('c_custkey')} ELSE '' END AS tax_registration_number, c_custkey * 2 AS row_number
FROM {{customer}} WHERE c_custkey % 13 <> 0
UNION ALL SELECT {_s('c_custkey')} AS vid, 'N' || {_s('c_custkey')} AS supplier_number, 'Later ' || c_name AS supplier_name, 'INDIVIDUAL' AS tax_organization_type, '' AS inactive_date, 'no' AS one_time_supplier, '' AS taxpayer_id, '' AS tax_registration_number, c_custkey * 2 + 1 AS row_number
FROM {{customer}} WHERE c_custkey % 17 = 0
"""
DOMAIN["site_extract"] = f"""
SELECT {_s('c_custkey')} AS vid, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 14 = 0 THEN {_s('c_custkey')} || '7.00' ELSE {_s('c_custkey')} || {_s('n')} || '.00' END AS sid, 'Site ' || c_name AS supplier_name, 'BU' AS procurement_bu,
  CASE n WHEN 1 THEN 'hq ' ELSE 'Depot' END AS address_name, 'Main Office ' || {_s('n % 2')} AS supplier_site, CASE WHEN n = 2 THEN '2024-05-05' ELSE '' END AS inactive_date, 'a@b.c' AS email, 'FR' AS country_of_origin, 'EUR' AS invoice_currency,
  '30 Days' AS payment_terms, c_custkey * 2 + n AS row_number
FROM {{customer}} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) sites
"""
DOMAIN["address_extract"] = f"""
SELECT {_s('c_custkey')} || '.0' AS vid, CASE n WHEN 1 THEN 'HQ' ELSE 'OTHER' END AS address_name, CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'GB' END AS country, {_s('n')} || ' Street' AS address_line_1, 'City' || {_s('n')} AS city, 'PC' || {_s('c_custkey')} AS postal_code, c_custkey * 2 + n AS row_number
FROM {{customer}} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) lines WHERE c_custkey % 5 <> 3
"""
DOMAIN["vat_extract"] = f"""
SELECT CASE c_custkey % 4 WHEN 0 THEN '' ELSE {_s('c_custkey')} END AS vid, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE {_s('c_custkey')} || '1' END AS sid, 'OU: ' || {_s('n')} AS operating_unit, {_s('100 + n')} AS org_id, 'N' || {_s('c_custkey')} AS supplier_number,
  CASE WHEN n = 1 THEN '' ELSE 'SV' || {_s('c_custkey')} END AS supplier_vat, CASE WHEN c_custkey % 3 = 0 THEN 'MAIN OFFICE 1' ELSE 'main office 0' END AS vendor_site_code, CASE WHEN c_custkey % 6 = 1 THEN 'XV' || {_s('c_custkey')} ELSE '' END AS site_vat, c_custkey * 3 + n AS row_number
FROM {{customer}} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n UNION ALL SELECT 3 AS n) units WHERE n < 3 OR c_custkey % 2 = 0
"""


# The same extracts as the import package meets them: some rows are found by id, some by number and code, some not at all.
DOMAIN["package_profiles"] = "SELECT vid, 'S' || supplier_number AS supplier_number, supplier_name, tax_organization_type, inactive_date, one_time_supplier, taxpayer_id, tax_registration_number, 'alt ' || vid AS alternate_name, row_number FROM {profile_extract}"
DOMAIN["package_sites"] = f"""
SELECT vid, CASE WHEN row_number % 3 = 0 THEN vid || '-' || {_s('1 + row_number % 2')} ELSE sid END AS sid, supplier_name, procurement_bu, address_name, CASE WHEN row_number % 3 = 1 THEN 'site' || {_s('1 + row_number % 2')} ELSE supplier_site END AS supplier_site,
  inactive_date, email, country_of_origin, invoice_currency, payment_terms, CASE WHEN row_number % 4 = 0 THEN 'no' END AS purchasing, row_number
FROM {{site_extract}}
"""
DOMAIN["package_addresses"] = "SELECT replace(vid, '.0', '') AS vid, address_name, country, address_line_1, city, postal_code, CASE WHEN row_number % 5 = 0 THEN 'mail@x' END AS e_mail, row_number FROM {address_extract}"


# Business documents: invoice and agreement text written from orders.
_NL = "chr(10)"
DOMAIN["invoice_texts"] = f"""
SELECT k AS doc_id, 'inv-' || ks || '.txt' AS file_name,
  party_name || {_NL} || CASE k % 6 WHEN 0 THEN 'Reference only' WHEN 1 THEN 'Tax Invoice: 00' || {_pad('k', 6)} ELSE 'Invoice Number: INV/' || {_pad('k', 8)} END || {_NL}
  || CASE k % 4 WHEN 0 THEN 'Invoice date: ' || {_s('d')} WHEN 1 THEN 'Date Issued: 5/' || substr({_s('d')}, 6, 2) || '/' || substr({_s('d')}, 3, 2) WHEN 2 THEN 'Issue date: 7 March ' || substr({_s('d')}, 1, 4) ELSE 'Dated today' END || {_NL}
  || CASE WHEN k % 3 = 0 THEN 'Due Date: ' || {_s('d + 30')} || {_NL} ELSE '' END || CASE WHEN k % 5 = 0 THEN 'Payment Terms: Net 30' || {_NL} ELSE '' END
  || CASE WHEN k % 7 = 0 THEN 'Supplier Name: Acme ' || {_s('k % 50')} || {_NL} ELSE '' END || 'VAT Number: GB' || {_pad('k', 9)} || {_NL}
  || CASE WHEN k % 8 = 0 THEN 'BIC: BARCGB22XXX' || {_NL} || 'BSB: 062-000' || {_NL} ELSE '' END || CASE WHEN k % 2 = 0 THEN 'Description   Qty  Amount' || {_NL} ELSE '' END
  || 'Consulting block A  ' || CAST(CAST(floor(cents / 4) AS BIGINT) / 100.0 AS DECIMAL(18, 2)) || {_NL} || 'Delivery ' || {_s('k % 9')} || '  1,200.50' || {_NL} || 'Page 1' || {_NL}
  || 'Subtotal ' || CAST(cents / 100.0 AS DECIMAL(18, 2)) || {_NL} || CASE WHEN k % 3 = 1 THEN 'VAT @ 20 (17.95) CR' ELSE 'GST 20.00' END || {_NL}
  || CASE WHEN k % 9 = 0 THEN 'thanks' ELSE 'Total Amount (' || currency || ') ' || CAST(cents / 100.0 AS DECIMAL(18, 2)) END || {_NL} AS text, d, cents
FROM {{order_facts}}
"""
DOMAIN["agreement_texts"] = f"""
SELECT k AS doc_id, 'agr-' || ks || '.txt' AS file_name,
  CASE k % 5 WHEN 0 THEN 'Some agreement' WHEN 1 THEN 'Agreement Number' || {_NL} || 'AG-' || {_pad('k', 6)} ELSE 'Agreement ID: AG-' || {_pad('k', 6)} END || {_NL}
  || CASE WHEN k % 3 = 0 THEN '' ELSE 'Requestor: Jo Smith' || {_NL} END || CASE k % 4 WHEN 0 THEN 'Agreement Type: Employment contract' WHEN 1 THEN 'Document Type: Lease' WHEN 2 THEN 'This policy applies' ELSE 'Plain text' END || {_NL}
  || CASE WHEN k % 2 = 0 THEN 'Business Function: Finance' || {_NL} ELSE '' END || 'Legal Entity: ' || party_name || {_NL}
  || CASE k % 3 WHEN 0 THEN 'Start date: ' || {_s('d')} WHEN 1 THEN 'Effective date: 3 April 2021' ELSE 'Commencement' || {_NL} || '01/02/21' END || {_NL}
  || CASE k % 4 WHEN 0 THEN 'End date: 31/12/2030' WHEN 1 THEN 'This is perpetual' WHEN 2 THEN 'Perpetual: No' ELSE '' END || {_NL} || CASE WHEN k % 6 = 0 THEN 'Auto-renew: Yes' ELSE '' END AS text
FROM {{order_facts}}
"""


# What a model answered about the invoices and agreements: JSON text, some of it broken or of wrong types; < and > stand for braces.
def _json(text: str) -> str:
    return f"translate({text}, '<>', chr(123) || chr(125))"


_INVOICE_ANSWER = f"""
CASE k % 10 WHEN 0 THEN CASE k % 4 WHEN 0 THEN 'not json <' WHEN 2 THEN CAST(NULL AS STRING) ELSE '' END WHEN 1 THEN '[1, 2]'
  WHEN 2 THEN '<"confidence":' || CASE k % 3 WHEN 0 THEN '"high"' WHEN 1 THEN '61.5' ELSE 'null' END || ',"header":' || CASE k % 4 WHEN 0 THEN '[]' ELSE '<"total":true,"subtotal":"twelve","invoiceNumber":7>' END
    || ',"lineItems":[<"lineNumber":1.5,"description":"x","unitPrice":"abc","quantity":"2","extra":<"a":1>>,5,<"quantity":2>],"taxLines":' || CASE k % 4 WHEN 2 THEN '<>' ELSE '[<"rate":1>,<"label":"VAT","rate":"x">]' END || ',"bank":' || CASE k % 3 WHEN 0 THEN '[]' ELSE '<"extra":7>' END
    || ',"fields":[<"category":"nope","key":"a","value":"b","confidence":1>,<"category":"dates","key":"a">],"warnings":["w",3],"reviewReasons":"none">'
  ELSE '<"vendor":"' || CASE k % 3 WHEN 0 THEN 'acme' ELSE 'nobody' END || '","confidence":' || CASE k % 7 WHEN 0 THEN '0' WHEN 1 THEN '140' ELSE {_s('30 + k % 60')} END || ',"header":<"invoiceNumber":' || CASE k % 4 WHEN 0 THEN '" INV/' || {_pad('k', 8)} || ' "' WHEN 1 THEN '"MADE-UP-9"' ELSE '""' END
    || ',"invoiceDate":' || CASE k % 3 WHEN 0 THEN '"5 Mar 2020"' WHEN 1 THEN '"2020-03-05"' ELSE 'null' END || ',"dueDate":"soon","currency":"' || CASE k % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'eur' WHEN 2 THEN 'xxx' ELSE 'aud' END || '"'
    || ',"supplierName":"' || party_name || '","customerName":"' || CASE k % 2 WHEN 0 THEN 'Delivery ' || {_s('k % 9')} ELSE 'Nobody Known' END || '","supplierCountry":"GB"'
    || ',"total":' || CASE k % 5 WHEN 0 THEN {_s('cents')} WHEN 1 THEN '1200.50' WHEN 2 THEN '"£1,200.50"' WHEN 3 THEN '20' ELSE 'null' END || ',"amountDue":' || CASE k % 3 WHEN 0 THEN '20' ELSE '""' END || '>'
    || ',"lineItems":[<"lineNumber":3,"description":" Work ","lineTotal":20,"unitPrice":12.5,"quantity":1.5,"extra":<"note":"n">>,<"description":"More","lineTotal":"(5.00)">]'
    || ',"taxLines":[<"label":"VAT","rate":20,"taxAmount":"£12.50">],"bank":' || CASE k % 4 WHEN 0 THEN '<"iban":"GB29NWBK60161331926819","accountName":"Ops">' WHEN 1 THEN '<>' ELSE 'null' END
    || ',"fields":[<"category":"dates","key":"invoiceDate","value":"x","confidence":50>,<"category":"site","key":"meter","value":"M1","confidence":70>],"warnings":["Totals were not classified by me","odd layout"],"reviewReasons":["check the sum","Supplier name unsure"],"more":1>' END
"""
_AGREEMENT_ANSWER = f"""
CASE k % 9 WHEN 0 THEN '<"confidence":1' WHEN 1 THEN '<"confidence":"x","header":<"autoRenew":"maybe">,"warnings":[1],"reviewReasons":[]>'
  ELSE '<"confidence":' || {_s('k % 100')} || ',"header":<"agreementId":"AG-' || {_pad('k', 6)} || '","requestor":"Jo Smith","agreementType":"' || CASE k % 3 WHEN 0 THEN 'Policy' WHEN 1 THEN 'NDA' ELSE 'Lease' END || '","contractingEntity":"' || party_name
    || '","businessFunction":"Marketing","startDate":"3 April 2021","endDate":' || CASE k % 2 WHEN 0 THEN '"2031-01-01"' ELSE '""' END || ',"autoRenew":' || CASE k % 4 WHEN 0 THEN '"yes"' WHEN 1 THEN 'false' ELSE 'null' END || ',"perpetual":' || CASE k % 3 WHEN 0 THEN 'true' ELSE '"no"' END
    || '>,"warnings":["w ' || {_s('k % 3')} || '"],"reviewReasons":["look again"],"synopsis":"' || CASE k % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'Some agreement   between two parties about services.' ELSE 'An overview: fees of 1,000 a year from 2021.' END || '">' END
"""
DOMAIN["invoice_outputs"] = f"SELECT k AS doc_id, {_json(_INVOICE_ANSWER)} AS output FROM {{order_facts}} WHERE k % 8 <> 7"
DOMAIN["agreement_outputs"] = f"SELECT k AS doc_id, {_json(_AGREEMENT_ANSWER)} AS output FROM {{order_facts}} WHERE k % 5 <> 4"


# What people did with the invoices: a few events each, and one document that the event stream touches again and again.
DOMAIN["invoice_events"] = f"""
SELECT k AS doc_id, 'EV-' || {_s('k')} || '-' || {_s('n')} AS event_id, {_s('d + CAST(n AS INT)')} || 'T08:00:00Z' AS happened_at, CASE (k + n) % 6 WHEN 0 THEN 'archive' WHEN 1 THEN 'reprocess' WHEN 2 THEN 'reject' WHEN 3 THEN 'accept' WHEN 4 THEN 'accept' ELSE 'viewed' END AS action,
  CASE WHEN k % 3 = 0 THEN ' ' ELSE 'user' || {_s('k % 5')} END AS actor, CASE WHEN k % 4 = 0 THEN 'because ' || {_s('n')} END AS reason, CASE WHEN (k + n) % 2 = 0 THEN 'NEW/' || {_s('k % 50')} END AS new_number,
  CASE WHEN k % 5 = 0 THEN {_s('k % 7')} || '.25' WHEN k % 5 = 1 THEN 'x' END AS new_total_major, CASE WHEN k % 3 = 1 THEN {_s('cents')} END AS new_total, CASE WHEN n = 2 THEN 'eur' WHEN n = 3 THEN 'USD' END AS new_currency, CASE WHEN n = 1 THEN 'note' END AS new_notes
FROM {{order_facts}} CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n UNION ALL SELECT 3 AS n UNION ALL SELECT 4 AS n) times WHERE n <= k % 5
UNION ALL SELECT 0 AS doc_id, 'EV-0-' || {_pad('event_id', 12)} AS event_id, {_s('CAST(ts AS DATE)')} || 'T09:00:00Z' AS happened_at, CASE event_id % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'archive' ELSE 'accept' END AS action, 'user' || {_s('user_id % 7')} AS actor, CAST(NULL AS STRING) AS reason,
  CASE WHEN event_id % 3 = 0 THEN 'N' || {_s('event_id % 5')} END AS new_number, CAST(NULL AS STRING) AS new_total_major, CASE WHEN event_id % 2 = 0 THEN {_s('event_id % 11')} END AS new_total, CAST(NULL AS STRING) AS new_currency, event_type AS new_notes
FROM {{events}}
"""


# Edit history of supplier records, from the event stream.
DOMAIN["audit_events"] = f"""
SELECT 'AUD-' || {_pad('event_id', 12)} AS id, CASE WHEN event_id % 3 = 0 THEN 'supplier' ELSE 'site' END AS record_type,
  CASE WHEN event_id % 3 = 0 THEN {_s('user_id')} ELSE {_s('user_id')} || '-' || {_s('1 + event_id % 2')} END AS record_id, CASE WHEN event_id % 17 = 0 THEN 'ingest' ELSE 'update' END AS action,
  CASE event_id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'city' WHEN 2 THEN 'paymentTerms' ELSE 'payGroup' END AS field, {_s('event_id % 5')} AS old_value, {_s('event_id % 3')} AS new_value,
  'user' || {_s('user_id % 7')} AS actor, {_s('CAST(ts AS DATE)')} AS created_at, event_id AS seq
FROM {{events}}
"""
DOMAIN["vat_checks"] = f"""
SELECT 'VAT-' || {_pad('event_id', 12)} AS id, {_s('user_id')} || '-' || {_s('1 + event_id % 2')} AS site_id, event_type AS validity, {_s('CAST(ts AS DATE)')} AS created_at FROM {{events}}
"""


# Printed statements: text items with their place on a page, written from orders; newest posting first, eight to a page.
def _div(a: str, b: int) -> str:
    return f"CAST(({a} - ({a}) % {b}) / {b} AS BIGINT)"


def _printed(cents: str) -> str:
    """Amount text with grouped thousands, from a column of cents."""
    whole, low = _div(f"abs({cents})", 100), f"abs({cents}) % 100"
    thousands, millions = _div(whole, 1000), _div(whole, 1000000)
    return (
        f"CASE WHEN {cents} < 0 THEN '-' ELSE '' END || CASE WHEN {millions} > 0 THEN {_s(millions)} || ',' || {_pad(f'{thousands} % 1000', 3)} || ',' || {_pad(f'{whole} % 1000', 3)}"
        f" WHEN {thousands} > 0 THEN {_s(thousands)} || ',' || {_pad(f'{whole} % 1000', 3)} ELSE {_s(whole)} END || '.' || {_pad(low, 2)}"
    )


def _day_text(d: str) -> str:
    months = " ".join(f"WHEN '{i:02d}' THEN '{m}'" for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1))
    return f"substr({_s(d)}, 9, 2) || ' ' || CASE substr({_s(d)}, 6, 2) {months} END || ' ' || substr({_s(d)}, 1, 4)"


DOMAIN["printed_postings"] = f"""
SELECT doc_id, nation_key, k, ks, currency, party_name, d, signed, {_div('r', 8)} + 1 AS page, r % 8 AS slot,
  CAST(sum(signed) OVER (PARTITION BY doc_id ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) + 500000 + CASE WHEN k % 41 = 0 THEN 100 ELSE 0 END AS balance
FROM (SELECT t.*, row_number() OVER (PARTITION BY doc_id ORDER BY d DESC, k) - 1 AS r
  FROM (SELECT f.*, CASE WHEN f.k % 3 = 0 THEN -f.cents ELSE f.cents END AS signed,
      'PDF-' || {_s('f.nation_key')} || CASE WHEN f.nation_key % 5 = 0 THEN '' ELSE '-' || substr({_s('f.d')}, 1, 4) END AS doc_id FROM {{order_facts}} f) t) u
"""


def _printed_cells() -> tuple[list, list]:
    """What is printed of a posting and of a page, as (condition, place in the order, x, y, text)."""
    row = "330.2 - slot * 32"
    of_row = [  # (condition, offset, x, y, text)
        ("k % 6 <> 0", 0, "31.2", row, "'BR' || ks"), ("k % 6 = 0", 0, "31.2", row, "'BR'"), ("k % 6 = 0", 1, "60", row, "ks"), ("k % 4 <> 0", 2, "129.2", row, "'SO-' || ks"),
        ("k % 10 <> 9", 3, "227.2", row, "CASE WHEN signed < 0 THEN 'DR' ELSE 'TRF' END"), ("k % 7 <> 0", 4, "325.2", row, _day_text("d")),
        ("signed > 0", 5, "423.2", row, _printed("signed")), ("signed < 0", 6, "521.2", row, _printed("signed")), ("k % 37 <> 0", 7, "619.2", row, _printed("balance")),
        ("k % 43 <> 0", 8, "717.2", f"{row} - 0.1", _day_text("d")), ("k % 2 = 0", 10, "31.2", f"{row} - 9", "'Narrative'"), ("k % 2 = 0", 11, "82", f"{row} - 9", "'NARR ' || party_name"),
        ("k % 2 = 0 AND k % 3 = 0", 12, "260", f"{row} - 9", "'  ref ' || ks"), ("k % 3 = 1", 13, "82", f"{row} - 17", "'cont  ' || ks"), ("k % 5 = 0", 14, "31.2", f"{row} - 24", "'W' || ks"),
        ("k % 31 = 0", 15, "300", f"{row} - 28", "'stray ' || ks"), *((f"k % 29 = 0", 20 + i, str(100 + 200 * i), row, "'WATERMARK'") for i in range(4)),
    ]
    shift = "CASE WHEN page % 8 = 2 THEN 6 ELSE 0 END"
    heads = [("Bank reference", 31.2), ("Customer reference", 129.2), ("TRN type", 227.2), ("Value date", 325.2), ("Credit amount", 423.2), ("Debit amount", 521.2), ("Balance", 619.2), ("Post date", 717.2)]
    shown = "page % 4 <> 3 AND nation_key <> 13"
    of_page = [(f"{shown} AND NOT (page % 8 = 5 AND '{t}' = 'Value date')", 30 + i, f"{x} + {shift}", "354", f"'{t}'") for i, (t, x) in enumerate(heads)]
    of_page += [(f"{shown} AND page % 8 = 5", 40, "325.2", "354", "'Value'"), (f"{shown} AND page % 8 = 5", 41, "345", "354", "'date'")]
    of_page += [("page % 4 = 1", 45 + i, str(80 + 150 * i), "344", "'CONFIDENTIAL'") for i in range(4)]
    of_page += [("page = 1 AND nation_key % 4 = 1", 50, "31.2", "348", "'Narrative'"), ("page = 1 AND nation_key % 4 = 1", 51, "82", "348", "'early note'")]
    of_page += [("true", 9000, "400", "20", f"'Page ' || {_s('page')} || ' of 9'"), ("page = 1 AND nation_key % 3 = 0", 9001, "31", "21", "'05 Mar 2024 Account number 12'"), ("page = 1 AND nation_key % 3 <> 2", 0, "31", "560", "'Statement details'")]
    block = [
        ("nation_key % 6 <> 5", "31", "540", "'Account name'"), ("nation_key % 6 <> 5", "140", "540", "'ACME'"), ("nation_key % 6 <> 5", "180.4", "540.3", "'TRADING  ' || " + _s("nation_key")), ("true", "400", "540", "'Current ledger balance'"), ("true", "520", "540", "'1,250.50'"),
        ("true", "31", "528.4", "'Account number'"), ("true", "140", "528", f"'1234' || {_pad('nation_key', 2)} || '-0001'"), ("true", "31", "516", "'Currency'"), ("nation_key % 4 <> 2", "140", "516", "'EUR'"),
        ("true", "400", "516", "'From'"), ("true", "520", "516", "CASE WHEN nation_key % 2 = 0 THEN '28 Aug 2026' ELSE 'the start' END"), ("nation_key % 2 = 0", "31", "504", "'IBAN'"), ("nation_key % 2 = 0", "140", "504", f"'GB00' || {_pad('nation_key', 8)}"),
        ("nation_key % 3 = 1", "31", "492", "'Specified date range'"), ("nation_key % 3 = 1", "140", "492", "'01 Jan 1995 to 31 Dec 1996'"), ("true", "31", "480", "'Account name'"), ("nation_key % 6 <> 4", "140", "480", "'SECOND'"),
        ("true", "400", "480", "'Current ledger balance'"), ("true", "460", "480", "'-2,000.00'"), ("true", "520", "480", "'about'"), ("nation_key % 2 = 1", "400", "468", "'Current available balance'"), ("nation_key % 2 = 1", "410", "468", "'EUR'"),
    ]
    of_page += [(f"page = 1 AND {c}", 2 + i, x, y, t) for i, (c, x, y, t) in enumerate(block)]
    return of_row, of_page


def _printed_items() -> str:
    of_row, of_page = _printed_cells()
    cell = "SELECT doc_id, page, {seq} AS seq, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST(40 AS DOUBLE) AS width, CAST(8 AS DOUBLE) AS height, {t} AS str FROM {src} WHERE {c}"
    parts = [cell.format(seq=f"1000 + slot * 100 + {n}", x=x, y=y, t=t, src="{printed_postings}", c=c) for c, n, x, y, t in of_row]
    parts += [cell.format(seq=n, x=x, y=y, t=t, src="(SELECT DISTINCT doc_id, page, nation_key FROM {printed_postings}) g", c=c) for c, n, x, y, t in of_page]
    return f"SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, seq) AS BIGINT) AS item_no, x, y, width, height, str FROM ({' UNION ALL '.join(parts)}) items"


def _printed_items_of(postings: DataFrame) -> DataFrame:
    """The rows of ``DOMAIN["statement_items"]``: all that is printed of a posting or page comes from one row, and items are numbered page by page."""
    of_row, of_page = _printed_cells()

    def printed(df: DataFrame, cells: list, seq: str) -> DataFrame:
        made = [f"CASE WHEN {c} THEN named_struct('seq', CAST({seq}{n} AS BIGINT), 'x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE), 'str', {t}) END" for c, n, x, y, t in cells]
        return df.select("doc_id", "page", F.explode(F.expr(f"array({', '.join(made)})")).alias("i")).where("i IS NOT NULL").select("doc_id", "page", "i.*")

    pages = postings.select("doc_id", "page", "nation_key").distinct()
    items = printed(postings, of_row, "1000 + slot * 100 + ").unionByName(printed(pages, of_page, ""))
    earlier = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    # how many items a posting or page prints follows from the conditions alone
    shown = lambda df, cells: df.select("doc_id", "page", F.expr(" + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, *_ in cells)).alias("n"))
    before = shown(postings, of_row).unionByName(shown(pages, of_page)).groupBy("doc_id", "page").agg(F.sum("n").alias("n")).select(
        F.col("doc_id").alias("_doc_id"), F.col("page").alias("_page"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbered = items.withColumn("_at", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")))
    met = numbered.join(before, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("page") == F.col("_page")))
    return met.select(
        "doc_id", "page", (F.col("_before") + F.col("_at")).cast("bigint").alias("item_no"), "x", "y", F.lit(40.0).alias("width"), F.lit(8.0).alias("height"), "str")


def _bank_transactions_of(d: Domain) -> DataFrame:
    """The rows of ``DOMAIN["bank_transactions"]`` with each fact table read once: an order gives its credit and, if it has one, the repeat.

    A union that reads one table twice is rewritten when its results are joined to it again, and results that are persisted are then not found.
    """
    once, repeat = "named_struct('suffix', '', 'shift', 0)", "named_struct('suffix', '-D', 'shift', 1)"
    credit = _CREDIT.replace("'{suffix}'", "e.suffix").replace("{shift}", "e.shift").replace("{{order_facts}}", "{order_facts}")
    credit += f" LATERAL VIEW explode(CASE WHEN k % 50 = 0 THEN array({once}, {repeat}) ELSE array({once}) END) x AS e"
    debit = DOMAIN["bank_transactions"].rsplit(" UNION ALL ", 1)[1]
    return d.select(f"{credit} UNION ALL {debit}", order_facts=d["order_facts"], purchase_facts=d["purchase_facts"])


#: Tables that Spark builds in another way than their SELECT says, with the same rows.
BUILT = {
    "statement_items": lambda d: _printed_items_of(d["printed_postings"]), "bank_transactions": _bank_transactions_of,
    "statements": lambda d: d.select(DOMAIN["statements"], bank_transactions=d.once("bank_transactions")),
}

DOMAIN["statement_items"] = _printed_items()
DOMAIN["statement_files"] = f"""
SELECT doc_id, 'ACC-' || {_s('min(nation_key)')} AS account_id, CASE min(nation_key) % 4 WHEN 0 THEN 'bank/UK-HSBC/' || doc_id || '.pdf' WHEN 1 THEN 'bank/misc/hsbc ' || doc_id || '.pdf' ELSE 'bank/misc/' || doc_id || '.pdf' END AS storage_key,
  CASE min(nation_key) % 6 WHEN 3 THEN 'HSBC-' || doc_id || '.PDF' ELSE doc_id || '.pdf' END AS file_name, max(page) AS page_count, CASE WHEN min(nation_key) = 7 THEN 'Unreadable file' END AS error
FROM {{printed_postings}} GROUP BY doc_id
"""


def _inputs(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", DOMAIN[name])))


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` dealt by its keys over as many tasks as a shuffle has, more for many ``rows``, whatever the files and row groups it was read from."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_TASK)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Domain:
    """Domain tables over one folder of test tables, built on demand and reused."""

    _shared: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen, self._rows = spark, sf_dir, {}, {}
        self._views = (f"ledgerloom_{uuid.uuid4().hex}_{n}" for n in itertools.count())

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> "Domain":
        """One instance per Spark application and folder, so persisted tables are reused."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._shared:
            cls._shared[key] = cls(spark, sf_dir)
        return cls._shared[key]

    def remember(self, name: str, build) -> DataFrame:
        """A derived table that several queries read: built once and persisted."""
        if name not in self._seen:
            self._seen[name] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._seen[name]

    def remembered(self, name: str, build) -> DataFrame:
        """The table of `remember` if it is persisted already, or else what ``build`` gives, for a query that reads it once."""
        return self._seen[name] if name in self._seen else build()

    def select(self, text: str, **inputs: DataFrame) -> DataFrame:
        """``text`` with its inputs in braces, over views that stay: ``spark.sql(text, **inputs)`` drops its views, and dropping one unpersists its table."""
        views = {n: next(self._views) for n in inputs}
        for n, view in views.items():
            inputs[n].createOrReplaceTempView(view)
        return self.spark.sql(text.format(**views))

    def rows(self, name: str) -> int:
        """Rows of a base table, from the footers of its files. Shuffles of the session start with tasks to suit, so that no task grows with the table."""
        if name not in self._rows:
            self._rows[name] = self[name].count()
            split_shuffles(self.spark, -(-self._rows[name] // ROWS_PER_TASK))
        return self._rows[name]

    def once(self, name: str) -> DataFrame:
        """A fact table for a query that reads few of its columns: as it is persisted, or else written from the rows it is made of and not kept."""
        return self[name] if name in self._seen else self._derived(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            derived = self._derived(name) if name in DOMAIN else table(self.spark, self.sf_dir, name)
            # The fact tables stand for stored tables that every job reads several times.
            self._seen[name] = derived.persist(StorageLevel.MEMORY_AND_DISK) if name in FACTS else derived
        return self._seen[name]

    def _derived(self, name: str) -> DataFrame:
        if name in BUILT:
            return BUILT[name](self)
        inputs = {n: self[n] for n in _inputs(name)}
        text = DOMAIN[name]
        if name == "purchase_facts":  # dealt as the sums need it, which then takes no shuffle of its own; cents and days are shorter than prices and times
            sold = inputs["lineitem"].selectExpr("l_orderkey", "l_suppkey", f"{_LINE_CENTS} AS line_cents", f"{_LINE_DAY} AS line_day")
            inputs["lineitem"] = spread(sold, "l_orderkey", "l_suppkey", rows=self.rows("lineitem"))
            text = text.replace(_LINE_CENTS, "line_cents").replace(_LINE_DAY, "line_day")
        if name == "order_facts":  # documents, answers and lines are all written and read from the rows of orders, which are dealt before texts are put together
            text, source = text.split("FROM {orders}")
            placed = self.select(f"SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice, c_custkey, c_nationkey, n_regionkey FROM {{orders}}{source}", **inputs)
            inputs = {"placed": spread(placed, "o_orderkey", rows=self.rows("orders"))}
            text = re.sub(r"\b[ocn]\.(?=[ocn]_)", "", text) + "FROM {placed}"
        return self.select(text, **inputs)


def domain_ctes(*names: str) -> str:
    """WITH clause that defines the given domain tables and all they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DOMAIN and name not in order:
            for n in _inputs(name):
                visit(n)
            order.append(name)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        body = re.sub(r"\{(\w+)\}", r"\1", DOMAIN[n])
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts)
