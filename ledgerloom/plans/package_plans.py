"""The supplier import package: four sheets, the report of differences, totals and the list of saved packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import import_package as ip
from ..sources.adapters import Domain
from .catalog import Catalog

CATALOG = Catalog()
add = CATALOG.add
NEEDS = ("suppliers", "supplier_sites", "package_profiles", "package_sites", "package_addresses", "audit_events")
BATCH = "B-1"


def _package(d: Domain) -> ip.Package:
    return ip.build_package(d.suppliers, d.supplier_sites, d.audit_events, d.package_profiles, d.package_sites, d.package_addresses, BATCH)


def _yn(x: str, other: str = "") -> str:
    return f"(CASE WHEN trim(coalesce({x}, '')) = '' THEN '{other}' WHEN lower(trim({x})) IN ('y', 'yes', 'true', '1') THEN 'Y' WHEN lower(trim({x})) IN ('n', 'no', 'false', '0') THEN 'N' ELSE upper(trim({x})) END)"


def _day(x: str) -> str:
    return f"(CASE WHEN regexp_matches(trim({x}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN replace(substr(trim({x}), 1, 10), '-', '/') ELSE trim({x}) END)"


_PROFILE = ("supplier_name", "supplier_number", "tax_organization_type", "inactive_date", "one_time_supplier", "tax_registration_number", "taxpayer_id", "alternate_name")
_SITE = ("supplier_name", "procurement_bu", "address_name", "supplier_site", "inactive_date", "email", "invoice_currency", "payment_terms", "country_of_origin", "purchasing")
_ADDRESS = ("address_name", "country", "address_line_1", "city", "postal_code", "e_mail")


def _either(fields, a: str, b: str) -> str:
    return ", ".join(f"CASE WHEN {a}.vid IS NOT NULL THEN {a}.{f} ELSE {b}.{f} END AS x_{f}" for f in fields)


def _moves(sheet: str, key: str, table: str, pairs: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{sheet}' AS sheet, {key} AS key, '{f}' AS field, coalesce(x_{f}, '') AS from_value, {v} AS to_value FROM {table} WHERE NOT made AND coalesce(x_{f}, '') <> {v}" for f, v in pairs.items())


_HEAD_VALUES = {
    "supplier_name": "name", "supplier_number": "supplier_number", "tax_organization_type": "type", "inactive_date": "coalesce(inactive_date, '')", "one_time_supplier": "CASE WHEN one_time THEN 'Y' ELSE 'N' END",
    "tax_registration_number": "trn", "taxpayer_id": "taxpayer",
}
_SITE_VALUES = {
    "supplier_name": "name", "procurement_bu": "procurement_bu", "address_name": "place", "supplier_site": "site_code", "inactive_date": "coalesce(inactive_date, '')", "email": "''", "invoice_currency": "invoice_currency",
    "payment_currency": "payment_currency", "pay_group": "pay_group", "payment_terms": "payment_terms", "payment_method": "payment_method", "site_vat": "site_vat",
}
_ADDRESS_VALUES = {"supplier_name": "name", "address_name": "place", "country": "country", "address_line_1": "address_line1", "city": "city", "postal_code": "postal_code"}
PACKAGE = f"""
pv AS (SELECT *, trim(vid) AS k FROM package_profiles p WHERE trim(vid) <> '' QUALIFY row_number() OVER (PARTITION BY trim(vid) ORDER BY p.row_number DESC) = 1),
pn AS (SELECT *, trim(supplier_number) AS k FROM package_profiles p WHERE trim(supplier_number) <> '' QUALIFY row_number() OVER (PARTITION BY trim(supplier_number) ORDER BY p.row_number DESC) = 1),
h0 AS (SELECT s.*, pv.vid IS NULL AND pn.vid IS NULL AS made, {_either(_PROFILE, 'pv', 'pn')} FROM suppliers s LEFT JOIN pv ON pv.k = s.id LEFT JOIN pn ON pn.k = s.supplier_number),
h AS (SELECT *, coalesce(nullif(trim(supplier_vat), ''), tax_registration_number) AS trn, coalesce(nullif(trim(taxpayer_id), ''), CASE WHEN trim(coalesce(x_taxpayer_id, '')) = trim(coalesce(x_tax_registration_number, '')) THEN trim(supplier_vat) ELSE trim(x_taxpayer_id) END) AS taxpayer FROM h0),
ss AS (SELECT *, trim(sid) AS k FROM package_sites p WHERE trim(sid) <> '' QUALIFY row_number() OVER (PARTITION BY trim(sid) ORDER BY p.row_number DESC) = 1),
sc AS (SELECT p.*, trim(v.supplier_number) || '|' || upper(trim(p.supplier_site)) AS k FROM package_sites p JOIN pv v ON v.k = trim(p.vid) WHERE trim(v.supplier_number) <> '' AND trim(p.supplier_site) <> '' QUALIFY row_number() OVER (PARTITION BY trim(v.supplier_number) || '|' || upper(trim(p.supplier_site)) ORDER BY p.row_number DESC) = 1),
placed AS (SELECT t.*, s.name, s.supplier_number, coalesce(nullif(t.address_name, ''), t.site_code) AS place, trim(s.supplier_number) || '|' || upper(trim(t.site_code)) AS skey, coalesce(nullif(trim(s.supplier_number), ''), s.supplier_number) AS number FROM supplier_sites t JOIN suppliers s ON s.id = t.supplier_id),
st AS (SELECT l.*, ss.vid IS NULL AND sc.vid IS NULL AS made, {_either(_SITE, 'ss', 'sc')}, NULL AS x_payment_currency, NULL AS x_pay_group, NULL AS x_payment_method, NULL AS x_site_vat FROM placed l LEFT JOIN ss ON ss.k = l.id LEFT JOIN sc ON sc.k = l.skey),
an AS (SELECT *, trim(vid) || '|' || upper(trim(address_name)) AS k FROM package_addresses p WHERE trim(vid) <> '' AND trim(address_name) <> '' QUALIFY row_number() OVER (PARTITION BY trim(vid) || '|' || upper(trim(address_name)) ORDER BY p.row_number DESC) = 1),
af AS (SELECT *, trim(vid) AS k FROM package_addresses p WHERE trim(vid) <> '' QUALIFY row_number() OVER (PARTITION BY trim(vid) ORDER BY p.row_number) = 1),
ad AS (SELECT l.*, an.vid IS NULL AND af.vid IS NULL AS made, {_either(_ADDRESS, 'an', 'af')}, NULL AS x_supplier_name FROM placed l LEFT JOIN an ON an.k = l.supplier_id || '|' || upper(trim(l.place)) LEFT JOIN af ON af.k = l.supplier_id),
moves AS ({_moves('suppliers', "coalesce(nullif(supplier_number, ''), id)", 'h', _HEAD_VALUES)} UNION ALL {_moves('sites', 'skey', 'st', _SITE_VALUES)} UNION ALL {_moves('addresses', "supplier_number || '|' || place", 'ad', _ADDRESS_VALUES)}),
supplier_sheet AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(coalesce(nullif(trim(supplier_number), ''), supplier_number), ''), id) ORDER BY id) = 1),
address_sheet AS (SELECT * FROM ad QUALIFY row_number() OVER (PARTITION BY number || '|' || upper(trim(place)) ORDER BY supplier_id, id) = 1)"""


def _pick(sheet, **columns: str):
    return sheet.select("id", *(F.col(f"`{head}`").alias(name) for name, head in columns.items()))


@add("D07_supplier_sheet", f"""SELECT id, CASE WHEN made THEN 'CREATE' ELSE 'UPDATE' END AS action, name AS supplier_name, supplier_number, coalesce(x_alternate_name, '') AS alternate_name, {_day("coalesce(inactive_date, '')")} AS inactive_date, type AS supplier_type,
  CASE WHEN one_time THEN 'Y' ELSE 'N' END AS one_time, taxpayer AS taxpayer_id, trn AS registration, 'SPEND_AUTHORIZED' AS relationship, '' AS federal FROM supplier_sheet""", NEEDS, PACKAGE)
def d07_suppliers(d: Domain):
    return _pick(_package(d).sheets["suppliers"], action="Import Action", supplier_name="Supplier Name", supplier_number="Supplier Number", alternate_name="Alternate Name", inactive_date="Inactive Date", supplier_type="Supplier Type",
                 one_time="One Time Supplier Flag", taxpayer_id="Taxpayer ID", registration="Tax Registration Number", relationship="Business Relationship", federal="Federal Reportable")


@add("D07_site_sheet", f"""SELECT id, CASE WHEN made THEN 'CREATE' ELSE 'UPDATE' END AS action, name AS supplier_name, number AS supplier_number, procurement_bu, place AS address_name, site_code AS supplier_site, {_day("coalesce(inactive_date, '')")} AS inactive_date,
  {_yn("CASE WHEN NOT made THEN x_purchasing END", 'Y')} AS purchasing, 'N' AS card, coalesce(x_country_of_origin, '') AS origin, invoice_currency, CASE WHEN made THEN 'P' ELSE '' END AS match_option, pay_group, payment_terms, CASE WHEN made THEN 'DUE' ELSE '' END AS pay_date_basis, payment_method, site_vat, '' AS hold FROM st""", NEEDS, PACKAGE)
def d07_sites(d: Domain):
    return _pick(_package(d).sheets["sites"], action="Import Action", supplier_name="Supplier Name", supplier_number="Supplier Number", procurement_bu="Procurement BU", address_name="Address Name", supplier_site="Supplier Site", inactive_date="Inactive Date",
                 purchasing="Purchasing", card="Procurement Card", origin="Country of Origin", invoice_currency="Invoice Currency", match_option="Invoice Match Option", pay_group="Pay Group", payment_terms="Payment Terms", pay_date_basis="Pay Date Basis",
                 payment_method="Payment Method", site_vat="Tax Registration Number", hold="Hold Flag")


@add("D07_address_sheet", """SELECT id, CASE WHEN made THEN 'CREATE' ELSE 'UPDATE' END AS action, name AS supplier_name, number AS supplier_number, place AS address_name, country, address_line1 AS line_1, city, postal_code, coalesce(x_e_mail, '') AS email,
  CASE WHEN made THEN 'N' ELSE '' END AS rfq, 'Y' AS ordering FROM address_sheet""", NEEDS, PACKAGE)
def d07_addresses(d: Domain):
    return _pick(_package(d).sheets["addresses"], action="Import Action", supplier_name="Supplier Name", supplier_number="Supplier Number", address_name="Address Name", country="Country", line_1="Address Line 1", city="City", postal_code="Postal Code",
                 email="Email Address", rfq="RFQ or Bidding", ordering="Ordering")


@add("D07_assignment_sheet", f"SELECT id, CASE WHEN made THEN 'CREATE' ELSE 'UPDATE' END AS action, number AS supplier_number, site_code AS supplier_site, procurement_bu AS client_bu, procurement_bu AS bill_to_bu, '' AS ship_to, {_day(chr(99) + 'oalesce(inactive_date, ' + chr(39) * 2 + ')')} AS inactive_date FROM st", NEEDS, PACKAGE)
def d07_assignments(d: Domain):
    return _pick(_package(d).sheets["assignments"], action="Import Action", supplier_number="Supplier Number", supplier_site="Supplier Site", client_bu="Client BU", bill_to_bu="Bill-to BU", ship_to="Ship to Exception Action", inactive_date="Inactive Date")


@add("D07_package_overlays", "SELECT * FROM moves", NEEDS, PACKAGE)
def d07_overlays(d: Domain):
    return _package(d).overlays.withColumnsRenamed({"from": "from_value", "to": "to_value"})


@add("A18_package_totals", f"""SELECT '{BATCH}' AS batch, (SELECT count(*) FROM supplier_sheet) AS suppliers, (SELECT count(*) FROM address_sheet) AS addresses, (SELECT count(*) FROM st) AS sites, (SELECT count(*) FROM st) AS assignments, (SELECT count(*) FROM moves) AS overlays,
  (SELECT count(*) FROM h WHERE made) + (SELECT count(*) FROM st WHERE made) + (SELECT count(*) FROM ad WHERE made) AS synthesized,
  (SELECT count(*) FROM h WHERE NOT made AND ({" OR ".join(f"coalesce(x_{f}, '') <> {v}" for f, v in _HEAD_VALUES.items())})) + (SELECT count(*) FROM st WHERE NOT made AND ({" OR ".join(f"coalesce(x_{f}, '') <> {v}" for f, v in _SITE_VALUES.items())}))
  + (SELECT count(*) FROM ad WHERE NOT made AND ({" OR ".join(f"coalesce(x_{f}, '') <> {v}" for f, v in _ADDRESS_VALUES.items())})) AS overlayed""", NEEDS, PACKAGE)
def a18_totals(d: Domain):
    return ip.package_counts(_package(d))


_SAVED = "'pkg/B-' || CAST(o_custkey AS VARCHAR) || '/' || CASE o_orderkey % 3 WHEN 0 THEN 'a.csv' WHEN 1 THEN 'b.csv' ELSE 'manifest.json' END"


@add("S13_saved_packages", f"""
SELECT batch, coalesce(max(told), max(modified)) AS created_at, max(actor) AS actor, count(*) AS files, sum(size) AS size, row_number() OVER (ORDER BY coalesce(max(told), max(modified)) DESC, batch) AS rank
FROM (SELECT 'B-' || CAST(o_custkey AS VARCHAR) AS batch, {_SAVED} AS key, count(*) AS size, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS modified,
    CASE WHEN o_orderkey % 3 = 2 THEN '2001-01-0' || CAST(1 + o_custkey % 9 AS VARCHAR) END AS told, CASE WHEN o_orderkey % 3 = 2 THEN 'user' || CAST(o_custkey % 5 AS VARCHAR) END AS actor FROM orders GROUP BY o_custkey, o_orderkey % 3) GROUP BY batch""")
def s13(d: Domain):
    saved = _SAVED.replace("VARCHAR", "STRING")
    files = d.orders.selectExpr(f"{saved} AS key", "CAST(o_orderdate AS DATE) AS day", "o_custkey").groupBy("key", "o_custkey").agg(F.count(F.lit(1)).alias("size"), F.max("day").cast("string").alias("last_modified"))
    content = F.to_json(F.struct(F.concat(F.lit("2001-01-0"), (1 + F.col("o_custkey") % 9).cast("string")).alias("createdAt"), F.concat(F.lit("user"), (F.col("o_custkey") % 5).cast("string")).alias("actor")))
    manifests = files.where("key LIKE '%/manifest.json'").select("key", content.alias("content"))
    out = ip.list_packages(files.drop("o_custkey"), manifests, "pkg/")
    return out.select("batch", "created_at", "actor", F.size("files").alias("files"), F.aggregate("files", F.lit(0).cast("bigint"), lambda a, f: a + f["size"]).alias("size"), "rank")
