"""Supplier edit, review, registry and package queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import supplier_edits as ed
from ..sources import landing
from ..sources.adapters import Domain
from .catalog import Catalog
from .sqltext import quoted

CATALOG = Catalog()
add = CATALOG.add
AUDIT = ("audit_events",)

NET = """
net AS (SELECT record_type, record_id, field, arg_min(old_value, struct_pack(c := created_at, i := id)) AS from_value, arg_max(new_value, struct_pack(c := created_at, i := id)) AS to_value, count(*) AS updates
  FROM audit_events WHERE action = 'update' GROUP BY 1, 2, 3)"""


@add("W07_net_field_changes", "SELECT * FROM net WHERE from_value <> to_value", AUDIT, NET)
def w07(d: Domain):
    return ed.net_field_changes(d.audit_events)


@add("W08_latest_vat_check", "SELECT site_id, created_at, id, validity FROM vat_checks QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY created_at DESC, id) = 1", ("vat_checks",))
def w08(d: Domain):
    return ed.latest(d.vat_checks, "site_id", "validity")


@add("D06_supplier_review")
def d06(d: Domain):
    out = ed.review(d.suppliers, d.supplier_sites, d.audit_events, d.vat_checks)
    return out.withColumns({"head_changes": F.to_json("head_changes"), "changes": F.to_json("changes")})


@add("T04_newest_audit", "SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rank FROM audit_events QUALIFY rank <= 500", AUDIT)
def t04(d: Domain):
    return ed.newest(d.audit_events, 500).select("id", "rank")


FIELDS = ("name", "type", "status")
PATCH = """
patch AS (SELECT id, 'name' AS field, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'New ' || id ELSE name END AS value FROM suppliers WHERE CAST(id AS BIGINT) % 3 = 0
  UNION ALL SELECT id, 'status', CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'active' ELSE 'inactive' END FROM suppliers WHERE CAST(id AS BIGINT) % 5 = 0)"""


def _edited(d: Domain):
    patches = d.suppliers.selectExpr(
        "id", "stack(2, 'name', CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'New ' || id ELSE name END END, "
        "'status', CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'active' ELSE 'inactive' END END) AS (field, value)", "'jo' AS actor")
    return ed.apply_edits(d.suppliers, patches, FIELDS, "supplier", "2026-01-02T00:00:00Z")


@add("D05_edit_audit", """SELECT s.id AS record_id, p.field, CASE p.field WHEN 'name' THEN s.name ELSE s.status END AS old_value, p.value AS new_value, s.version + 1 AS version FROM suppliers s JOIN patch p ON p.id = s.id
  WHERE p.value <> CASE p.field WHEN 'name' THEN s.name ELSE s.status END
UNION ALL SELECT s.id, 'inactive_date', '', '2026-01-02', s.version + 1 FROM suppliers s JOIN patch p ON p.id = s.id WHERE p.field = 'status' AND p.value = 'inactive' AND s.status <> 'inactive' AND coalesce(s.inactive_date, '') = ''""", ("suppliers",), PATCH)
def d05(d: Domain):
    return _edited(d)[2].select("record_id", "field", "old_value", "new_value", "version")


@add("W12_record_versions", "SELECT s.id AS record_id, s.version FROM suppliers s WHERE EXISTS (SELECT 1 FROM patch p WHERE p.id = s.id AND p.value <> CASE p.field WHEN 'name' THEN s.name ELSE s.status END)", ("suppliers",), PATCH)
def w12(d: Domain):
    return _edited(d)[1].select("record_id", "version")


def _words(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(regexp_replace(upper({x}), '[^A-Z0-9]+', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND w NOT IN ({quoted(ed.LEGAL_SUFFIXES)})))"


@add("H47_compare_names", f"""SELECT id, CASE WHEN trim(a) = '' OR trim(b) = '' THEN 'unknown' WHEN upper(trim(a)) = upper(trim(b)) THEN 'match' WHEN score >= 0.5 THEN 'match' WHEN score = 0 THEN 'mismatch' ELSE 'unknown' END AS name_match
FROM (SELECT id, a, b, CASE WHEN least(len({_words('a')}), len({_words('b')})) = 0 THEN 0 ELSE len(list_intersect({_words('a')}, {_words('b')})) / least(len({_words('a')}), len({_words('b')})) END AS score FROM (SELECT id, name AS a, reverse(substr(reverse(name), 5)) || ' Rome Oslo GmbH' AS b FROM suppliers))""", ("suppliers",))
def h47(d: Domain):
    pairs = d.suppliers.selectExpr("id", "name AS a", "reverse(substr(reverse(name), 5)) || ' Rome Oslo GmbH' AS b")
    return pairs.select("id", ed.compare_names("a", "b").alias("name_match"))


@add("J20_registry_check")
def j20(d: Domain):
    from ..operators.suppliers import records

    r = records(d.suppliers, d.supplier_sites).select("site_id", F.col("supplier_vat").alias("vat"), "country", F.col("supplier_name").alias("name"), "address_line1", "city", "postal_code")
    from ..functions.vat import split_vat

    known = r.withColumn("s", split_vat("vat", "country")).filter("s is not null")
    registry = known.groupBy("s.country_code", "s.vat_number").agg(F.min("name").alias("registered_name"), F.min(F.concat_ws(" ", "address_line1", "postal_code", "city")).alias("registered_address"), (F.crc32(F.min("vat")) % 3 != 0).alias("valid"))
    return ed.registry_check(r, registry)


_SCOPE = """
last_number AS (SELECT trim(vid) AS v, arg_max(trim(supplier_number), row_number) AS number FROM profile_extract GROUP BY 1),
placed AS (SELECT t.id, t.supplier_id,
    EXISTS (SELECT 1 FROM site_extract x WHERE trim(x.sid) <> '' AND trim(x.sid) = t.id)
    OR EXISTS (SELECT 1 FROM site_extract x JOIN last_number n ON n.v = trim(x.vid) WHERE n.number <> '' AND trim(x.supplier_site) <> '' AND n.number = trim(s.supplier_number) AND upper(trim(x.supplier_site)) = upper(trim(t.site_code))) AS found,
    EXISTS (SELECT 1 FROM audit_events e WHERE e.action = 'update' AND e.record_id <> '*' AND e.record_id IN (t.id, t.supplier_id)) AS edited
  FROM supplier_sites t LEFT JOIN suppliers s ON s.id = t.supplier_id),
judged AS (SELECT s.id, EXISTS (SELECT 1 FROM profile_extract p WHERE trim(p.vid) <> '' AND trim(p.vid) = s.id OR trim(p.supplier_number) <> '' AND trim(p.supplier_number) = trim(s.supplier_number)) AS known,
    EXISTS (SELECT 1 FROM placed t WHERE t.supplier_id = s.id AND NOT t.found) AS new_site, EXISTS (SELECT 1 FROM placed t WHERE t.supplier_id = s.id AND t.edited) AS edited FROM suppliers s)"""
_SCOPE_TABLES = ("suppliers", "supplier_sites", "profile_extract", "site_extract", "audit_events")


@add("P13_package_scope", "SELECT id, CASE WHEN known THEN 'UPDATE' ELSE 'CREATE' END AS import_action FROM judged WHERE NOT known OR new_site OR edited", _SCOPE_TABLES, _SCOPE)
def p13(d: Domain):
    return ed.in_scope(d.suppliers, d.supplier_sites, d.profile_extract, d.site_extract, d.audit_events, "changed").select("id", "import_action")


@add("H61_import_action", "SELECT id, 'CREATE' AS import_action FROM judged WHERE NOT known OR new_site", _SCOPE_TABLES, _SCOPE)
def h61(d: Domain):
    return ed.in_scope(d.suppliers, d.supplier_sites, d.profile_extract, d.site_extract, d.audit_events, "new").select("id", "import_action")


@add("D07_overlay_report", """SELECT s.id, 'name' AS field, p.supplier_name AS source_value, trim(s.name) AS package_value FROM suppliers s JOIN firsts p ON p.vid = s.id WHERE p.supplier_name <> trim(s.name)
UNION ALL SELECT s.id, 'supplier_number', p.supplier_number, trim(s.supplier_number) FROM suppliers s JOIN firsts p ON p.vid = s.id WHERE p.supplier_number <> trim(s.supplier_number)""", ("suppliers", "profile_extract"),
     "firsts AS (SELECT * FROM profile_extract QUALIFY row_number() OVER (PARTITION BY vid ORDER BY profile_extract.row_number DESC) = 1)")
def d07(d: Domain):
    p = d.profile_extract.groupBy("vid").agg(F.max_by(F.struct("supplier_name", "supplier_number"), "row_number").alias("r"))
    source = p.select(F.col("vid").alias("id"), F.col("r.supplier_name").alias("name"), F.col("r.supplier_number").alias("supplier_number"))
    return ed.overlay_report(d.suppliers, source, "id", ("name", "supplier_number"))


@add("A18_package_counts", "SELECT 'B1' AS batch, 'suppliers' AS sheet, (SELECT count(*) FROM suppliers) AS rows UNION ALL SELECT 'B1', 'sites', (SELECT count(*) FROM supplier_sites)", ("suppliers", "supplier_sites"))
def a18(d: Domain):
    return ed.package_manifest({"suppliers": d.suppliers, "sites": d.supplier_sites}, "B1")


# --- landing and scalar functions over whole tables ---------------------------------

@add("S06_new_documents", """SELECT key, content_hash FROM fresh WHERE content_hash NOT IN (SELECT content_hash FROM known) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY key) = 1""", (), """
land AS (SELECT 'in/' || CAST(doc_id AS VARCHAR) AS key, sha256(text) AS content_hash, doc_id FROM documents), known AS (SELECT * FROM land WHERE doc_id % 10 = 0), fresh AS (SELECT * FROM land WHERE doc_id % 10 <> 0)""")
def s06(d: Domain):
    land, known = _landing(d)
    return landing.plan_documents(land, known, keep_duplicates=False)


@add("S07_people_documents", """SELECT key, content_hash, coalesce(known_doc, CASE WHEN key <> first_key THEN first_key END) AS duplicate_of FROM (
  SELECT key, content_hash, min(key) OVER (PARTITION BY content_hash) AS first_key, (SELECT min(doc_id) FROM known k WHERE k.content_hash = fresh.content_hash) AS known_doc FROM fresh)""", (), """
land AS (SELECT 'in/' || CAST(doc_id AS VARCHAR) AS key, sha256(text) AS content_hash, CAST(doc_id AS VARCHAR) AS doc_id FROM documents), known AS (SELECT * FROM land WHERE CAST(doc_id AS BIGINT) % 10 = 0), fresh AS (SELECT * FROM land WHERE CAST(doc_id AS BIGINT) % 10 <> 0)""")
def s07(d: Domain):
    land, known = _landing(d)
    return landing.plan_documents(land, known, keep_duplicates=True)


def _landing(d: Domain):
    land = d.documents.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("key"), landing.content_hash("text").alias("content_hash"), "doc_id")
    known = land.filter("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("key").alias("original_key"), "content_hash")
    return land.drop("doc_id"), known


@add("J19_landing_listing", "SELECT 'in/' || CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 10 = 0 THEN CAST(doc_id AS VARCHAR) END AS doc_id, doc_id % 10 = 0 AS processed FROM documents")
def j19(d: Domain):
    return landing.landing_listing(_landing(d)[0].select("key"), _landing(d)[1])


@add("H01_to_cents", "SELECT o_orderkey, CAST(floor((o_totalprice + 2.220446049250313e-16 * sign(o_totalprice)) * 100 + 0.5) AS BIGINT) AS cents FROM orders")
def h01(d: Domain):
    return d.orders.select("o_orderkey", money.to_cents("o_totalprice").alias("cents"))


@add("H03_csv_amount", "SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS cents FROM lineitem")
def h03(d: Domain):
    t = F.format_number(F.col("l_extendedprice"), 2)
    cell = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" ($"), t, F.lit(") "))).otherwise(F.concat(F.lit("€ "), t))
    return d.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", money.csv_amount(cell).alias("cents"))


@add("T01_natural_sort_key", "SELECT c_custkey, 'customer#' || lpad(CAST(length(CAST(c_custkey AS VARCHAR)) AS VARCHAR), 3, '0') || CAST(c_custkey AS VARCHAR) AS sort_key FROM customer")
def t01(d: Domain):
    return d.customer.select("c_custkey", text.natural_sort_key("c_name").alias("sort_key"))


@add("S03_picked_files", "SELECT 'ap_header' AS role, max(key) AS key FROM (SELECT 'INV/inv_header_' || ks || '.csv' AS key FROM order_facts)", ("order_facts",))
def s03(d: Domain):
    return landing.pick_files(d.once("order_facts").selectExpr("'INV/inv_header_' || ks || '.csv' AS key"))


@add("S04_statement_plan", """SELECT key, 'OCI-' || sha1(key) AS statement_id, CASE WHEN k % 5 = 0 THEN 'skipped' WHEN k % 7 = 0 THEN 'error' ELSE 'take' END AS outcome FROM f""", ("order_facts",),
     "f AS (SELECT k, 'bank/' || CASE WHEN k % 7 = 0 THEN 'NOPE' ELSE 'ACC-' || CAST(nation_key AS VARCHAR) END || '/' || ks || '.csv' AS key FROM order_facts)")
def s04(d: Domain):
    f = d.order_facts.selectExpr("k", "'bank/' || CASE WHEN k % 7 = 0 THEN 'NOPE' ELSE 'ACC-' || CAST(nation_key AS STRING) END || '/' || ks || '.csv' AS key")
    return landing.plan_statements(f.select("key"), "bank/", d.bank_accounts, f.filter("k % 5 = 0").select("key")).select("key", "statement_id", "outcome")
