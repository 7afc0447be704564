"""Supplier master queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, vat
from ..functions.address import CITY_POSTAL, COUNTRY_PREFIX, POSTAL, assess_address
from ..operators import suppliers as sup
from ..sources.adapters import Domain
from .catalog import Catalog

CATALOG = Catalog()
add = CATALOG.add

MASTER = ("suppliers", "supplier_sites")


def _alias(x: str) -> str:
    return f"CASE upper({x}) WHEN 'GR' THEN 'EL' WHEN 'UK' THEN 'GB' ELSE upper({x}) END"


def _fmt(code: str, body: str) -> str:
    return "CASE " + code + " " + " ".join(f"WHEN '{k}' THEN regexp_matches({body}, '{v}')" for k, v in vat.BODY.items()) + " ELSE false END"


def _dig(body: str, i: int) -> str:
    return f"try_cast(substr({body}, {i}, 1) AS INTEGER)"


def _sum(body: str, weights) -> str:
    return "(" + " + ".join(f"{w} * {_dig(body, i)}" for i, w in enumerate(weights, 1)) + ")"


_LUHN = "(" + " + ".join(_dig("body", i) if i % 2 else f"(CASE WHEN {_dig('body', i)} > 4 THEN 2 * {_dig('body', i)} - 9 ELSE 2 * {_dig('body', i)} END)" for i in range(1, 11)) + ")"
_CHECK = f"""CASE code WHEN 'BE' THEN 97 - CAST(substr(body, 1, 8) AS BIGINT) % 97 = CAST(substr(body, 9, 2) AS BIGINT)
  WHEN 'NL' THEN {_sum('body', vat.NL_WEIGHTS)} % 11 <> 10 AND {_sum('body', vat.NL_WEIGHTS)} % 11 = {_dig('body', 9)}
  WHEN 'PT' THEN (CASE WHEN {_sum('body', vat.PT_WEIGHTS)} % 11 < 2 THEN 0 ELSE 11 - {_sum('body', vat.PT_WEIGHTS)} % 11 END) = {_dig('body', 9)}
  WHEN 'IT' THEN (10 - {_LUHN} % 10) % 10 = {_dig('body', 11)}
  WHEN 'GB' THEN starts_with(body, 'G') OR starts_with(body, 'H') OR try_cast(substr(body, 8, 2) AS INTEGER) IN (97 - {_sum('body', vat.GB_WEIGHTS)} % 97, 97 - ({_sum('body', vat.GB_WEIGHTS)} + 55) % 97)
  ELSE true END"""


def vat_ctes(name: str, source: str, value: str) -> str:
    """CTEs that assess one VAT column of ``source`` (with ``site_id, country``) under ``name``."""
    return f"""
{name}1 AS (SELECT site_id, trim({value}) AS raw, regexp_replace(upper({value}), '[\\s.\\-/]', '', 'g') AS norm, nullif({_alias('country')}, '') AS home FROM {source}),
{name}2 AS (SELECT *, CASE WHEN list_contains({list(vat.BODY)!r}, {_alias('substr(norm, 1, 2)')}) THEN {_alias('substr(norm, 1, 2)')} END AS prefix FROM {name}1),
{name}3 AS (SELECT *, coalesce(prefix, home) AS code, CASE WHEN starts_with(norm, prefix) THEN substr(norm, 3) ELSE norm END AS body FROM {name}2),
{name}4 AS (SELECT *, coalesce({_fmt('code', 'body')}, false) AS fits FROM {name}3),
{name}5 AS (SELECT *, CASE WHEN raw = '' THEN 'missing' WHEN NOT fits THEN 'invalid_format' WHEN prefix <> home THEN 'country_mismatch'
    WHEN NOT coalesce({_CHECK}, true) THEN 'checksum_failed' WHEN prefix IS NULL THEN 'missing_prefix' ELSE 'ok' END AS status FROM {name}4),
{name} AS (SELECT site_id, status, norm, CASE status WHEN 'missing' THEN 'VAT ID is missing.' WHEN 'country_mismatch' THEN 'VAT prefix ' || prefix || ' does not match address country ' || home || '.'
    WHEN 'checksum_failed' THEN 'VAT ID checksum failed for ' || code || '.' WHEN 'missing_prefix' THEN 'VAT ID is missing the ' || code || ' country prefix.'
    WHEN 'ok' THEN CASE WHEN raw <> norm THEN 'VAT ID has extra spacing or punctuation.' ELSE 'VAT ID format looks valid.' END
    ELSE CASE WHEN prefix IS NOT NULL THEN 'VAT ID does not match the ' || prefix || ' format.' WHEN home IS NOT NULL THEN 'VAT ID does not match a recognised ' || home || ' format.'
      ELSE 'VAT ID does not match a recognised EU/GB format.' END END AS message,
    CASE WHEN status IN ('missing_prefix', 'checksum_failed') AND prefix IS NULL THEN code || norm WHEN status = 'ok' AND raw <> norm THEN norm END AS suggestion FROM {name}5)"""


REC = """
rec AS (SELECT t.id AS site_id, s.id AS supplier_id, s.name, s.supplier_number, s.type, t.country, t.payment_terms, t.pay_group, t.payment_method, t.site_vat, t.city, t.address_line1, t.postal_code,
    coalesce(nullif(s.supplier_vat, ''), s.taxpayer_id) AS vat FROM supplier_sites t JOIN suppliers s ON s.id = t.supplier_id)"""
VAT_CTES = REC + "," + vat_ctes("sv", "rec", "vat")


@add("H34_assess_vat", "SELECT site_id, status, norm AS normalized, message, suggestion FROM sv", MASTER, VAT_CTES)
def h34(d: Domain):
    r = sup.records(d.suppliers, d.supplier_sites)
    r = r.withColumn("vat", F.coalesce(F.nullif("supplier_vat", F.lit("")), "taxpayer_id"))
    return vat.with_vat_assessment(r, "vat", "country", "a").select("site_id", "a.status", "a.normalized", "a.message", "a.suggestion")


@add("H32_vat_format", "SELECT site_id, code, fits FROM sv4", MASTER, VAT_CTES)
def h32(d: Domain):
    r = sup.records(d.suppliers, d.supplier_sites).withColumn("norm", vat.normalise_vat(F.coalesce(F.nullif("supplier_vat", F.lit("")), "taxpayer_id")))
    r = r.withColumn("prefix", vat.vat_prefix(F.col("norm"))).withColumn("code", F.coalesce("prefix", F.nullif(vat.alias_country("country"), F.lit(""))))
    body = F.when(F.col("prefix").isNotNull(), vat.vat_body(F.col("prefix"), F.col("norm"))).otherwise(F.col("norm"))
    return r.select("site_id", "code", F.coalesce(vat.format_ok(F.col("code"), body), F.lit(False)).alias("fits"))


@add("H31_split_vat", "SELECT site_id, CASE WHEN prefix IS NOT NULL THEN prefix WHEN norm <> '' AND fits THEN home END AS country_code, CASE WHEN prefix IS NOT NULL OR (norm <> '' AND fits) THEN body END AS vat_number FROM sv4", MASTER, VAT_CTES)
def h31(d: Domain):
    r = sup.records(d.suppliers, d.supplier_sites).withColumn("s", vat.split_vat(F.coalesce(F.nullif("supplier_vat", F.lit("")), "taxpayer_id"), "country"))
    return r.select("site_id", "s.country_code", "s.vat_number")


@add("H33_vat_checksum", f"SELECT site_id, NOT coalesce({_CHECK}, true) AS bad FROM sv4 WHERE fits", MASTER, VAT_CTES)
def h33(d: Domain):
    r = sup.records(d.suppliers, d.supplier_sites).withColumn("norm", vat.normalise_vat(F.coalesce(F.nullif("supplier_vat", F.lit("")), "taxpayer_id")))
    r = r.withColumn("prefix", vat.vat_prefix(F.col("norm"))).withColumn("code", F.coalesce("prefix", F.nullif(vat.alias_country("country"), F.lit(""))))
    r = r.withColumn("body", F.when(F.col("prefix").isNotNull(), vat.vat_body(F.col("prefix"), F.col("norm"))).otherwise(F.col("norm")))
    return r.filter(vat.format_ok(F.col("code"), F.col("body"))).select("site_id", vat.checksum_fails(F.col("code"), F.col("body")).alias("bad"))


_bare = f"trim(regexp_replace(trim(postal_code), '{COUNTRY_PREFIX}', ''))"
_town = f"regexp_extract(city, '{CITY_POSTAL}', 1)"
_expected = "CASE country " + " ".join(f"WHEN '{k}' THEN regexp_matches({_bare}, '{v}')" for k, v in POSTAL.items()) + " END"
ADDRESS_CTES = f"""
addr AS (
  SELECT site_id, 'missing_line' AS kind, 'addressLine1' AS field, 'Address line 1 is missing.' AS message, CAST(NULL AS VARCHAR) AS suggestion FROM rec WHERE trim(address_line1) = ''
  UNION ALL SELECT site_id, 'missing_city', 'city', 'City is missing.', NULL FROM rec WHERE trim(city) = ''
  UNION ALL SELECT site_id, 'missing_postal', 'postalCode', 'Postal code is missing.', NULL FROM rec WHERE trim(postal_code) = ''
  UNION ALL SELECT site_id, 'postal_has_country_prefix', 'postalCode', 'Postal code includes a country prefix.', nullif({_bare}, '') FROM rec WHERE regexp_matches(postal_code, '{COUNTRY_PREFIX}')
  UNION ALL SELECT site_id, 'city_contains_postal', 'city', 'City field appears to contain a postal code.', coalesce(nullif(trim(regexp_replace(regexp_replace(city, '{CITY_POSTAL}', ''), '[,-]+$', '')), ''), {_town}) FROM rec WHERE postal_code = '' AND {_town} <> ''
  UNION ALL SELECT site_id, 'missing_postal', 'postalCode', 'Postal code looks embedded in the city field.', {_town} FROM rec WHERE postal_code = '' AND {_town} <> ''
  UNION ALL SELECT site_id, 'postal_format', 'postalCode', 'Postal code does not match the expected ' || country || ' format.', NULL FROM rec WHERE {_bare} <> '' AND NOT ({_expected}))"""


@add("H35_assess_address", "SELECT * FROM addr", MASTER, REC + "," + ADDRESS_CTES)
def h35(d: Domain):
    r = sup.records(d.suppliers, d.supplier_sites)
    return r.select("site_id", F.explode(assess_address("country", "address_line1", "city", "postal_code")).alias("i")).select("site_id", "i.*")


def _look(value: str, table: dict, squeeze: bool) -> str:
    case = lambda key: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
    spaced = f"regexp_replace(lower(trim({value})), '\\s+', ' ', 'g')"
    tight = f"regexp_replace(lower(trim({value})), '[\\s._-]+', '', 'g')"
    return f"coalesce({case(spaced)}, {case(tight)})" if squeeze else case(spaced)


_group = "nullif(array_to_string(list_transform(string_split_regex(trim(pay_group), '\\s+'), lambda w: CASE WHEN upper(w) IN ('EUR', 'GBP', 'USD', 'AUD', 'GB', 'EFT', 'BACS') THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' '), '')"
RAT_CTES = f"""
canon AS (SELECT *, {_look('payment_terms', canonical.TERMS, True)} AS ct, {_group} AS cg, {_look('payment_method', canonical.METHODS, True)} AS cm, {_look('type', canonical.TYPES, False)} AS ck,
  count(*) OVER (PARTITION BY trim(payment_terms)) AS tn, count(*) OVER (PARTITION BY trim(pay_group)) AS gn, count(*) OVER () AS n FROM rec),
rat AS (
  SELECT site_id, supplier_id, 'paymentTerms' AS field, trim(payment_terms) AS value, CASE WHEN ct <> trim(payment_terms) THEN ct END AS suggestion, CASE WHEN ct <> trim(payment_terms) THEN 'Payment terms "' || trim(payment_terms) || '" can be standardised to "' || ct || '".'
    WHEN n >= 8 AND tn < 3 THEN 'Payment terms "' || trim(payment_terms) || '" is used on fewer than 3 sites — review for rationalisation.' END AS reason FROM canon WHERE trim(payment_terms) <> ''
  UNION ALL SELECT site_id, supplier_id, 'payGroup', trim(pay_group), CASE WHEN cg <> trim(pay_group) THEN cg END, CASE WHEN cg <> trim(pay_group) THEN 'Pay group "' || trim(pay_group) || '" can be standardised to "' || cg || '".'
    WHEN n >= 8 AND gn < 3 THEN 'Pay group "' || trim(pay_group) || '" is rare — review whether it should merge into a standard group.' END FROM canon WHERE trim(pay_group) <> ''
  UNION ALL SELECT site_id, supplier_id, 'paymentMethod', trim(payment_method), cm, CASE WHEN cm <> trim(payment_method) THEN 'Payment method "' || trim(payment_method) || '" can be standardised to "' || cm || '".' END FROM canon WHERE trim(payment_method) <> ''
  UNION ALL SELECT site_id, supplier_id, 'type', trim(type), CASE WHEN ck <> trim(type) THEN ck END, CASE WHEN ck <> trim(type) THEN 'Supplier type "' || trim(type) || '" can be standardised to "' || ck || '".'
    WHEN ck IS NULL THEN 'Supplier type "' || trim(type) || '" is not in the canonical set.' END FROM canon WHERE trim(type) <> '')"""

_missing = " UNION ALL ".join(
    f"SELECT site_id, supplier_id, 'miss:' || site_id || ':{f}' AS id, 'missing_attribute' AS type, '{s}' AS severity, '{f}' AS field, 'Missing {lab.lower()}' AS title, '{lab} is missing.' AS description, CAST(NULL AS VARCHAR) AS suggestion, '{rt}' AS record_type FROM rec WHERE trim({c}) = ''"
    for c, f, lab, s, rt in (("name", "name", "Supplier name", "high", "site"), ("supplier_number", "supplierNumber", "Supplier number", "high", "supplier"), ("type", "type", "Supplier type", "medium", "supplier"),
                             ("payment_terms", "paymentTerms", "Payment terms", "medium", "site"), ("pay_group", "payGroup", "Pay group", "medium", "site"), ("payment_method", "paymentMethod", "Payment method", "medium", "site"), ("country", "country", "Country", "medium", "site")))
_SEV = "CASE status WHEN 'country_mismatch' THEN 'medium' WHEN 'missing_prefix' THEN 'medium' ELSE 'high' END"
ISSUE_CTES = VAT_CTES + "," + vat_ctes("tv", "rec", "site_vat") + "," + ADDRESS_CTES + "," + RAT_CTES + f""",
issues0 AS ({_missing}
  UNION ALL SELECT r.site_id, supplier_id, 'vat:supplier:' || r.site_id || ':' || status, CASE status WHEN 'missing' THEN 'missing_attribute' ELSE 'invalid_vat' END, {_SEV}, 'supplierVat', CASE status WHEN 'missing' THEN 'Missing supplier VAT' ELSE 'Incorrect supplier VAT' END, message, suggestion, 'supplier' FROM rec r JOIN sv USING (site_id) WHERE status <> 'ok'
  UNION ALL SELECT r.site_id, supplier_id, 'vat:supplier:' || r.site_id || ':spacing', 'rationalise', 'low', 'supplierVat', 'VAT ID spacing', message, suggestion, 'supplier' FROM rec r JOIN sv USING (site_id) WHERE status = 'ok' AND suggestion IS NOT NULL
  UNION ALL SELECT r.site_id, supplier_id, 'vat:site:' || r.site_id || ':' || status, 'invalid_vat', {_SEV}, 'siteVat', 'Incorrect site VAT', message, suggestion, 'site' FROM rec r JOIN tv USING (site_id) WHERE status <> 'ok' AND r.site_vat <> ''
  UNION ALL SELECT r.site_id, supplier_id, 'vat:site:' || r.site_id || ':spacing', 'rationalise', 'low', 'siteVat', 'Site VAT spacing', message, suggestion, 'site' FROM rec r JOIN tv USING (site_id) WHERE status = 'ok' AND suggestion IS NOT NULL
  UNION ALL SELECT site_id, supplier_id, 'vat:site:' || site_id || ':missing', 'missing_attribute', 'medium', 'siteVat', 'Missing site VAT', 'Site VAT ID is missing.', NULL, 'site' FROM rec WHERE site_vat = ''
  UNION ALL SELECT r.site_id, supplier_id, 'vat:mismatch:' || r.site_id, 'invalid_vat', 'medium', 'siteVat', 'Supplier and site VAT differ', 'Supplier VAT ' || r.vat || ' does not match site VAT ' || r.site_vat || '.', sv.norm, 'site' FROM rec r JOIN sv USING (site_id) JOIN tv USING (site_id) WHERE sv.norm <> '' AND tv.norm <> '' AND sv.norm <> tv.norm
  UNION ALL SELECT a.site_id, supplier_id, 'addr:' || a.site_id || ':' || kind || ':' || field, CASE WHEN starts_with(kind, 'missing') THEN 'missing_attribute' ELSE 'invalid_address' END, CASE WHEN starts_with(kind, 'missing') THEN 'medium' ELSE 'high' END, field, CASE WHEN starts_with(kind, 'missing') THEN 'Missing ' || field ELSE 'Incorrect address' END, message, suggestion, 'site' FROM addr a JOIN rec USING (site_id)
  UNION ALL SELECT site_id, supplier_id, 'rat:' || site_id || ':' || field || ':' || value, 'rationalise', 'low', field, 'Rationalise attribute', reason, suggestion, CASE field WHEN 'type' THEN 'supplier' ELSE 'site' END FROM rat WHERE reason IS NOT NULL),
issues AS (SELECT *, CASE record_type WHEN 'supplier' THEN supplier_id ELSE site_id END AS record_id FROM issues0)"""


def _with_issues(d: Domain):
    return sup.with_issues(d.suppliers, d.supplier_sites)


@add("H37_rationalise", "SELECT site_id, field, value, suggestion, reason FROM rat WHERE reason IS NOT NULL", MASTER, REC + "," + RAT_CTES)
def h37(d: Domain):
    issues = sup.issue_table(_with_issues(d)).filter("title = 'Rationalise attribute'")
    value = F.regexp_extract("id", r"^rat:[^:]*:[^:]*:(.*)$", 1)
    return issues.select("site_id", "field", value.alias("value"), "suggestion", F.col("description").alias("reason"))


@add("H36_canonical_values", "SELECT site_id, ct AS terms, cg AS pay_group, cm AS method, ck AS type FROM canon", MASTER, REC + "," + RAT_CTES)
def h36(d: Domain):
    r = sup.records(d.suppliers, d.supplier_sites)
    return r.select("site_id", canonical.canonical_terms("payment_terms").alias("terms"), canonical.canonical_pay_group("pay_group").alias("pay_group"),
                    canonical.canonical_method("payment_method").alias("method"), canonical.canonical_type("supplier_type").alias("type"))


@add("W13_rare_values", "SELECT trim(payment_terms) AS value, count(*) AS uses, (SELECT count(*) FROM supplier_sites) >= 8 AND count(*) < 3 AS rare FROM supplier_sites GROUP BY 1", MASTER)
def w13(d: Domain):
    n = d.supplier_sites.agg(F.count(F.lit(1)).alias("n"))
    counts = sup.value_counts(d.supplier_sites, "payment_terms", "uses").withColumnRenamed("payment_terms", "value")
    return counts.join(F.broadcast(n)).select("value", "uses", canonical.is_rare("uses", "n").alias("rare"))


@add("D04_supplier_issues", "SELECT * FROM issues", MASTER, ISSUE_CTES)
def d04(d: Domain):
    return sup.issue_table(_with_issues(d))


@add("A10_issue_counts", "SELECT type, severity, count(*) AS issues, count(DISTINCT site_id) AS records FROM issues GROUP BY GROUPING SETS ((type), (severity), ())", MASTER, ISSUE_CTES)
def a10(d: Domain):
    return sup.issue_counts(sup.issue_table(_with_issues(d)))


@add("A11_grouped_suppliers", "SELECT r.supplier_id, count(DISTINCT r.site_id) AS site_count, count(DISTINCT i.record_type || ':' || i.field || ':' || i.type || ':' || i.title) AS unique_issues FROM rec r LEFT JOIN issues i ON i.supplier_id = r.supplier_id GROUP BY 1", MASTER, ISSUE_CTES)
def a11(d: Domain):
    return sup.grouped(_with_issues(d))


@add("P05_records_with_issue", "SELECT DISTINCT i.site_id FROM issues i JOIN supplier_sites t ON t.id = i.site_id WHERE i.type = 'invalid_vat' AND t.country = 'PT'", MASTER, ISSUE_CTES)
def p05(d: Domain):
    return sup.filter_records(_with_issues(d), issue="invalid_vat", country="PT").select("site_id")


_DIST = """
vals AS (SELECT 'paymentTerms' AS attribute, payment_terms AS value FROM supplier_sites UNION ALL SELECT 'payGroup', pay_group FROM supplier_sites UNION ALL SELECT 'paymentMethod', payment_method FROM supplier_sites
  UNION ALL SELECT 'country', country FROM supplier_sites UNION ALL SELECT 'type', type FROM suppliers),
dist AS (SELECT attribute, trim(value) AS value, count(*) AS count FROM vals GROUP BY 1, 2)"""


@add("A09_distributions", "SELECT * FROM dist", MASTER, _DIST)
def a09(d: Domain):
    return sup.distributions(d.suppliers, d.supplier_sites)


@add("T03_top_values", "SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY count DESC, value) AS rank FROM dist QUALIFY rank <= 8", MASTER, _DIST)
def t03(d: Domain):
    return sup.distributions(d.suppliers, d.supplier_sites, top=8)


@add("P04_site_filter", "SELECT t.id FROM supplier_sites t LEFT JOIN suppliers s ON s.id = t.supplier_id WHERE t.source = 'erp' AND (contains(lower(concat_ws(' ', site_code, site_vat, city, payment_terms, pay_group, operating_unit, org_id)), 'oakfield') OR contains(lower(concat_ws(' ', name, supplier_number, supplier_vat)), 'oakfield'))", MASTER)
def p04(d: Domain):
    return sup.filter_sites(d.supplier_sites, d.suppliers, q=" Oakfield ", source="erp").select("id")


@add("T02_site_page", "SELECT id FROM supplier_sites ORDER BY id LIMIT 50 OFFSET 100", MASTER)
def t02(d: Domain):
    return sup.page(d.supplier_sites, limit=50, offset=100).select("id")


@add("H39_site_labels", """SELECT id, CASE WHEN count(*) OVER (PARTITION BY supplier_id, code) > 1 AND coalesce(nullif(trim(payment_terms), ''), nullif(trim(pay_group), '')) IS NOT NULL
  THEN code || ' · ' || coalesce(nullif(trim(payment_terms), ''), nullif(trim(pay_group), '')) ELSE code END AS label FROM (SELECT *, coalesce(nullif(trim(site_code), ''), nullif(trim(city), ''), 'Site') AS code FROM supplier_sites)""", MASTER)
def h39(d: Domain):
    return sup.site_labels(d.supplier_sites)


# --- extracts ------------------------------------------------------------------

EXTRACTS = ("profile_extract", "site_extract", "address_extract", "vat_extract")


def _iid(x: str) -> str:
    return rf"regexp_replace(trim({x}), '^(\d+)\.0+$', '\1')"


EXTRACT_CTES = rf"""
prof AS (SELECT *, {_iid('vid')} AS v FROM profile_extract QUALIFY row_number() OVER (PARTITION BY {_iid('vid')} ORDER BY profile_extract.row_number DESC) = 1),
named AS (SELECT *, {_iid('vid')} AS v FROM address_extract QUALIFY row_number() OVER (PARTITION BY {_iid('vid')}, address_name ORDER BY address_extract.row_number DESC) = 1),
firsts AS (SELECT *, {_iid('vid')} AS v FROM address_extract QUALIFY row_number() OVER (PARTITION BY {_iid('vid')} ORDER BY address_extract.row_number) = 1),
by_ids AS (SELECT vid, sid, arg_min(supplier_vat, row_number) FILTER (supplier_vat <> '') AS sv, arg_min(site_vat, row_number) FILTER (site_vat <> '') AS tv, arg_min(operating_unit, row_number) AS unit FROM vat_extract WHERE vid <> '' AND sid <> '' GROUP BY 1, 2),
by_code AS (SELECT supplier_number, upper(substr(vendor_site_code, 1, 15)) AS code, arg_min(supplier_vat, row_number) FILTER (supplier_vat <> '') AS sv, arg_min(site_vat, row_number) FILTER (site_vat <> '') AS tv, arg_min(operating_unit, row_number) AS unit
  FROM vat_extract WHERE vid = '' OR sid = '' GROUP BY 1, 2),
based AS (SELECT *, {_iid('vid')} AS v, {_iid('sid')} AS raw, coalesce(nullif({_iid('sid')}, ''), {_iid('vid')} || '-' || trim(regexp_replace(lower(supplier_site), '[^a-z0-9]+', '-', 'g'), '-')) AS base FROM site_extract),
numbered AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY based.row_number) AS nth FROM based),
joined AS (
  SELECT b.*, CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END AS site_id, b.v AS supplier_id, coalesce(p.supplier_number, '') AS number, p.supplier_name AS p_name, p.tax_organization_type AS p_type, coalesce(p.tax_registration_number, '') AS p_reg, coalesce(p.taxpayer_id, '') AS p_payer,
    p.inactive_date AS p_inactive, coalesce(n.country, f.country, '') AS a_country, coalesce(n.address_line_1, f.address_line_1, '') AS a_line, coalesce(n.city, f.city, '') AS a_city,
    CASE WHEN i.vid IS NOT NULL THEN i.sv ELSE c.sv END AS sv, CASE WHEN i.vid IS NOT NULL THEN i.tv ELSE c.tv END AS tv, CASE WHEN i.vid IS NOT NULL THEN i.unit ELSE c.unit END AS unit
  FROM numbered b LEFT JOIN prof p ON p.v = b.v LEFT JOIN named n ON n.v = b.v AND n.address_name = upper(trim(b.address_name)) LEFT JOIN firsts f ON f.v = b.v
    LEFT JOIN by_ids i ON i.vid = b.v AND i.sid = b.raw LEFT JOIN by_code c ON c.supplier_number = p.supplier_number AND c.code = upper(substr(trim(b.supplier_site), 1, 15)))"""


@add("J10_supplier_sites", "SELECT site_id AS id, supplier_id, trim(address_name) AS address_name, nullif(unit, '') AS operating_unit, coalesce(nullif(a_country, ''), country_of_origin) AS country, a_line AS address_line1, a_city AS city, coalesce(tv, sv, '') AS site_vat, nullif(inactive_date, '') AS inactive_date FROM joined", EXTRACTS, EXTRACT_CTES)
def j10(d: Domain):
    _, sites = sup.map_extracts(d.profile_extract, d.site_extract, d.address_extract, d.vat_extract)
    return sites.select("id", "supplier_id", "address_name", "operating_unit", "country", "address_line1", "city", "site_vat", "inactive_date")


@add("W09_supplier_header", """SELECT supplier_id AS id, max(number) AS supplier_number, coalesce(arg_min(nm, row_number) FILTER (nm <> ''), '') AS name, coalesce(max(p_type), '') AS type, CASE WHEN coalesce(max(p_inactive), '') = '' THEN 'active' ELSE 'inactive' END AS status,
  coalesce(arg_min(vt, row_number) FILTER (vt <> ''), max(back), '') AS supplier_vat FROM (
    SELECT j.*, coalesce(nullif(p_name, ''), supplier_name) AS nm, coalesce(j.sv, nullif(p_reg, ''), p_payer) AS vt, CASE WHEN bi.vid IS NOT NULL THEN bi.sv ELSE bn.sv END AS back
    FROM joined j LEFT JOIN bi ON bi.vid = j.supplier_id LEFT JOIN bn ON bn.supplier_number = j.number) GROUP BY 1""", EXTRACTS, EXTRACT_CTES + """,
bi AS (SELECT vid, arg_min(supplier_vat, row_number) FILTER (supplier_vat <> '') AS sv FROM vat_extract WHERE vid <> '' GROUP BY 1),
bn AS (SELECT supplier_number, arg_min(supplier_vat, row_number) FILTER (supplier_vat <> '') AS sv FROM vat_extract GROUP BY 1)""")
def w09(d: Domain):
    suppliers, _ = sup.map_extracts(d.profile_extract, d.site_extract, d.address_extract, d.vat_extract)
    return suppliers.select("id", "supplier_number", "name", "type", "status", "supplier_vat")


@add("J11_vat_backfill", "SELECT vid AS id, coalesce(arg_min(supplier_vat, row_number) FILTER (supplier_vat <> ''), '') AS supplier_vat FROM vat_extract WHERE vid <> '' GROUP BY 1", EXTRACTS)
def j11(d: Domain):
    bare = d.vat_extract.filter("vid != ''").select(F.col("vid").alias("id"), F.lit("").alias("supplier_vat"), F.lit("").alias("supplier_number")).distinct()
    return sup.backfill_vat(bare, d.vat_extract.withColumn("number", F.col("supplier_number"))).select("id", "supplier_vat")


@add("A17_site_vat_units", "SELECT vid, sid, arg_min(supplier_vat, row_number) FILTER (supplier_vat <> '') AS supplier_vat, string_agg(operating_unit || '/' || org_id, ',' ORDER BY row_number) AS units FROM vat_extract WHERE vid <> '' AND sid <> '' GROUP BY 1, 2", EXTRACTS)
def a17(d: Domain):
    rows = d.vat_extract.filter("vid != '' and sid != ''")
    units = F.array_join(F.transform("operating_units", lambda u: F.concat_ws("/", u["name"], u["org_id"])), ",")
    return sup._collect_vat(rows, ["vid", "sid"]).select("vid", "sid", "supplier_vat", units.alias("units"))


@add("W10_unique_ids", "SELECT row_number, CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END AS id FROM numbered", EXTRACTS, EXTRACT_CTES)
def w10(d: Domain):
    s = d.site_extract
    from ..functions.text import integer_id

    based = s.withColumn("base", F.coalesce(F.nullif(integer_id("sid"), F.lit("")), F.concat_ws("-", integer_id("vid"), sup.slug(F.col("supplier_site")))))
    return sup.unique_ids(based, "base", "uid").select("row_number", F.col("uid").alias("id"))
