"""Supplier master data: extract mapping, data-quality issues, lists and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import assess_address
from ..functions.canonical import rationalise_hits
from ..functions.money import text_or_empty
from ..functions.text import integer_id
from ..functions.vat import normalise_vat, with_vat_assessment
from .ranking import distributed_row_number
from .reference_docs import fields_of

SOURCE = "oci-supplier"

# Severity per VAT status, and attributes that belong to the supplier header.
VAT_SEVERITY = {"missing": "high", "invalid_format": "high", "checksum_failed": "high", "country_mismatch": "medium", "missing_prefix": "medium"}
SUPPLIER_FIELDS = ("name", "type", "supplierVat", "supplierNumber", "taxRegistrationNumber", "taxpayerId", "status")
ISSUE_TYPES = ("missing_attribute", "invalid_vat", "invalid_address", "rationalise")


# --- extracts to working copy ------------------------------------------------

def slug(c: Column, longest: int = 40) -> Column:
    """Words joined by hyphens, at most ``longest`` characters as ids of the source have them; ids made equal by the cut get numbers."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.coalesce(F.nullif(F.substring(words, 1, longest), F.lit("")), F.lit("site"))


def site_code_key(number: Column, code: Column, width: int = 15) -> Column:
    """Key of a site in the tax extract, whose codes are ``width`` characters wide. See :func:`ambiguous_site_codes`."""
    return F.concat_ws("|", text_or_empty(number), F.upper(F.substring(text_or_empty(code), 1, width)))


def ambiguous_site_codes(sites: DataFrame, width: int = 15) -> DataFrame:
    """``(key, codes)``: keys that more than one whole code of a supplier number falls on, to be looked at by a person."""
    whole = F.upper(text_or_empty("site_code"))
    keyed = sites.select(site_code_key(F.col("supplier_number"), F.col("site_code"), width).alias("key"), whole.alias("code")).distinct()
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("codes")).filter("codes > 1")


def is_yes(c: Column) -> Column:
    """Starts with y, holds yes or true, or ends in 1."""
    return text_or_empty(c).rlike(r"(?i)^y|yes|true|1$")


def unique_ids(df: DataFrame, base: str, out: str) -> DataFrame:
    """``base`` for its first row, then ``base-2``, ``base-3``; a repeat that meets a
    literal id of the same text moves further on.

    Repeats are numbered in ``row_number`` order. The free suffixes of a base are
    its numbers 2, 3, … minus those taken literally by other rows.
    """
    numbered = distributed_row_number(df, [base], ["row_number"], "_nth")
    stem, tail = F.regexp_extract(base, r"^(.*)-([1-9]\d*)$", 1), F.regexp_extract(base, r"^(.*)-([1-9]\d*)$", 2).try_cast("bigint")
    literal = df.select(stem.alias(base), tail.alias("_taken")).filter((F.col(base) != "") & (F.col("_taken") >= 2)).distinct()
    taken = literal.groupBy(base).agg(F.sort_array(F.collect_set("_taken")).alias("_taken_all"))
    # Shift the n-th number up once per taken number not above it, in rising order.
    shifted = F.aggregate("_taken_all", F.col("_nth"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    nth = F.when((F.col("_nth") == 1) | F.col("_taken_all").isNull(), F.col("_nth")).otherwise(shifted)
    named = F.when(nth == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), nth.cast("string")))
    return numbered.join(taken, base, "left").withColumn(out, named).drop("_nth", "_taken_all")


def _collect_vat(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First filled VAT numbers and the distinct operating units per key, in row order."""
    filled = lambda c: F.min_by(F.nullif(text_or_empty(c), F.lit("")), F.when(text_or_empty(c) != "", F.col("row_number")))
    base = rows.groupBy(*keys).agg(filled("supplier_vat").alias("supplier_vat"), filled("site_vat").alias("site_vat"))
    unit = F.struct(text_or_empty("operating_unit").alias("name"), integer_id("org_id").alias("org_id"))
    units = (
        rows.withColumn("unit", unit).filter("unit.name != '' or unit.org_id != ''").groupBy(*keys, "unit").agg(F.min("row_number").alias("at"))
        .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "unit"))).alias("us"))
        .select(*keys, F.transform("us", lambda u: u["unit"]).alias("operating_units"))
    )
    return base.join(units, keys, "left")


def map_extracts(profiles: DataFrame, sites: DataFrame, addresses: DataFrame, vat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suppliers and sites from the four extracts; the site extract is the baseline."""
    blank = text_or_empty
    p = profiles.withColumn("vid", integer_id("vid")).filter("vid != ''")
    p = p.groupBy("vid").agg(F.max_by(F.struct(*[c for c in p.columns if c != "vid"]), F.col("row_number")).alias("p"))
    a = addresses.withColumn("vid", integer_id("vid")).filter("vid != ''")
    cells = F.struct(*[c for c in a.columns if c != "vid"])
    a_first = a.groupBy("vid").agg(F.min_by(cells, F.col("row_number")).alias("a_first"))
    a_named = (
        a.withColumn("name_key", F.upper(blank("address_name"))).filter("name_key != ''")
        .groupBy("vid", "name_key").agg(F.max_by(cells, F.col("row_number")).alias("a_named"))
    )
    v = vat.withColumns({"vid": integer_id("vid"), "sid": integer_id("sid"), "number": blank("supplier_number")})
    with_ids = (F.col("vid") != "") & (F.col("sid") != "")
    v_ids = _collect_vat(v.filter(with_ids), ["vid", "sid"]).select("vid", F.col("sid").alias("raw_sid"), F.struct("supplier_vat", "site_vat", "operating_units").alias("v_ids"))
    coded = v.filter(~with_ids & (F.col("number") != "") & (blank("vendor_site_code") != "")).withColumn("code_key", site_code_key(F.col("number"), F.col("vendor_site_code")))
    v_code = _collect_vat(coded, ["code_key"]).select("code_key", F.struct("supplier_vat", "site_vat", "operating_units").alias("v_code"))

    f = fields_of(sites)
    s = sites.withColumns({
        "vid": integer_id("vid"), "raw_sid": integer_id("sid"), "name_key": F.upper(blank("address_name")),
    })
    s = s.withColumn("base_id", F.coalesce(F.nullif("raw_sid", F.lit("")), F.concat_ws("-", "vid", slug(f("supplier_site")))))
    s = unique_ids(s, "base_id", "site_id").join(p, "vid", "left").withColumn("number", blank("p.supplier_number"))
    s = (
        s.withColumn("code_key", site_code_key(F.col("number"), F.col("supplier_site")))
        .join(a_named, ["vid", "name_key"], "left").join(a_first, "vid", "left")
        .join(v_ids, ["vid", "raw_sid"], "left").join(v_code, "code_key", "left")
        .withColumns({"v": F.coalesce("v_ids", "v_code"), "a": F.coalesce("a_named", "a_first")})
        .withColumn("supplier_id", F.coalesce(F.nullif("vid", F.lit("")), F.concat(F.lit("N-"), "number")))
    )
    has_a = set(addresses.columns)
    addr = lambda name: blank(f"a.{name}") if name in has_a else F.lit("")
    own = lambda name: text_or_empty(f(name))
    or_null = lambda c: F.nullif(c, F.lit(""))
    unit = F.get("v.operating_units", F.lit(0))
    out_sites = s.select(
        F.col("site_id").alias("id"), "supplier_id", own("supplier_site").alias("site_code"),
        F.coalesce(or_null(own("address_name")), addr("address_name")).alias("address_name"), own("procurement_bu").alias("procurement_bu"),
        or_null(unit["name"]).alias("operating_unit"), or_null(unit["org_id"]).alias("org_id"), F.col("v.operating_units").alias("operating_units"),
        or_null(own("inactive_date")).alias("inactive_date"), *[own(c).alias(c) for c in ("payment_terms", "pay_group", "payment_method", "invoice_currency", "payment_currency")],
        F.coalesce(or_null(addr("country")), own("country_of_origin")).alias("country"), addr("address_line_1").alias("address_line1"),
        or_null(addr("address_line_2")).alias("address_line2"), addr("city").alias("city"), *[or_null(addr(c)).alias(c) for c in ("state", "province", "county")],
        addr("postal_code").alias("postal_code"), F.coalesce("v.site_vat", "v.supplier_vat", F.lit("")).alias("site_vat"),
        F.coalesce(or_null(own("email")), or_null(addr("e_mail"))).alias("email"), F.lit(SOURCE).alias("source"), F.lit(1).cast("bigint").alias("version"),
    )
    # Header fields: the first filled value over the supplier's site rows.
    first_filled = lambda c: F.min_by(c, F.when(c != "", F.col("row_number")))
    tax, payer = blank("p.tax_registration_number"), blank("p.taxpayer_id")
    fields = {
        "supplier_number": F.col("number"), "name": F.coalesce(or_null(blank("p.supplier_name")), own("supplier_name")),
        "type": blank("p.tax_organization_type"), "tax_registration_number": tax, "taxpayer_id": payer,
        "supplier_vat": F.coalesce("v.supplier_vat", or_null(tax), payer),
    }
    rows = s.withColumns({f"h_{k}": c for k, c in fields.items()}).withColumns(
        {"h_inactive": or_null(blank("p.inactive_date")), "h_one_time": is_yes(F.col("p.one_time_supplier"))}
    )
    heads = rows.groupBy(F.col("supplier_id").alias("id")).agg(
        *[F.coalesce(first_filled(F.col(f"h_{k}")), F.lit("")).alias(k) for k in fields],
        F.min_by(F.struct("h_inactive", "h_one_time"), F.col("row_number")).alias("first_row"),
    )
    suppliers = heads.select(
        "id", *fields, F.when(F.col("first_row.h_inactive").isNull(), "active").otherwise("inactive").alias("status"),
        F.col("first_row.h_one_time").alias("one_time"), F.col("first_row.h_inactive").alias("inactive_date"),
        F.lit(SOURCE).alias("source"), F.lit(1).cast("bigint").alias("version"),
    )
    return backfill_vat(suppliers, v), out_sites


def backfill_vat(suppliers: DataFrame, vat: DataFrame) -> DataFrame:
    """Suppliers still without VAT take the first one their VAT rows carry, by vendor id, else by number.

    The rows by number count only where no row has the vendor id.
    """
    first_vat = F.min_by(F.nullif(text_or_empty("supplier_vat"), F.lit("")), F.when(text_or_empty("supplier_vat") != "", F.col("row_number")))
    by_id = vat.filter("vid != ''").groupBy(F.col("vid").alias("id")).agg(first_vat.alias("id_vat"), F.lit(True).alias("has_id"))
    by_number = vat.filter("number != ''").groupBy(F.col("number").alias("supplier_number")).agg(first_vat.alias("number_vat"))
    joined = suppliers.join(by_id, "id", "left").join(by_number, "supplier_number", "left")
    found = F.when(F.col("has_id"), F.col("id_vat")).otherwise(F.col("number_vat"))
    filled = F.coalesce(F.nullif("supplier_vat", F.lit("")), found, F.lit(""))
    return joined.withColumn("supplier_vat", filled).drop("id_vat", "has_id", "number_vat").select(*suppliers.columns)


# --- issues --------------------------------------------------------------------

def _issue(test: Column, parts: list, kind, severity, field, title, description, suggestion=None, on_supplier: bool | Column = False) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    supplier_side = F.lit(on_supplier) if isinstance(on_supplier, bool) else on_supplier
    return F.when(test, F.struct(
        F.concat_ws(":", *[lit(x) for x in parts]).alias("id"), lit(kind).alias("type"), lit(severity).alias("severity"), lit(field).alias("field"),
        lit(title).alias("title"), lit(description).alias("description"),
        (F.lit(None).cast("string") if suggestion is None else suggestion).alias("suggestion"),
        F.when(supplier_side, "supplier").otherwise("site").alias("record_type"),
        F.when(supplier_side, F.col("supplier_id")).otherwise(F.col("site_id")).alias("record_id"),
    ))


def records(suppliers: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site with its supplier's header fields, both kept apart by name."""
    head = suppliers.select(
        F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"), "supplier_number", F.col("type").alias("supplier_type"),
        "supplier_vat", "taxpayer_id", F.col("source").alias("supplier_source"),
    )
    return sites.withColumnRenamed("id", "site_id").join(head, "supplier_id")


def value_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy(text_or_empty(column).alias(column)).agg(F.count(F.lit(1)).alias(name))


def with_issues(suppliers: DataFrame, sites: DataFrame) -> DataFrame:
    """Site records with an ``issues`` array.

    Rarity is judged over all sites. Counts per value are joined back on the
    trimmed value; the value tables are small next to the sites.
    """
    population = sites.agg(F.count(F.lit(1)).alias("population"))
    r = records(suppliers, sites).withColumns({"_terms": text_or_empty("payment_terms"), "_group": text_or_empty("pay_group")})
    terms = value_counts(sites, "payment_terms", "term_count").withColumnRenamed("payment_terms", "_terms")
    groups = value_counts(sites, "pay_group", "group_count").withColumnRenamed("pay_group", "_group")
    r = r.join(terms, "_terms", "left").join(groups, "_group", "left").join(F.broadcast(population))
    r = r.withColumn("_vat", F.coalesce(F.nullif("supplier_vat", F.lit("")), "taxpayer_id", F.lit("")))
    r = with_vat_assessment(r, "_vat", "country", "sv")
    r = with_vat_assessment(r, "site_vat", "country", "tv")
    r = r.withColumns({
        "_addr": assess_address("country", "address_line1", "city", "postal_code"),
        "_rat": rationalise_hits("payment_terms", "pay_group", "payment_method", "supplier_type", "term_count", "group_count", "population"),
        "_sn": normalise_vat("_vat"), "_tn": normalise_vat("site_vat"),
    })
    site = F.col("site_id")
    missing = [
        _issue(text_or_empty(c) == "", ["miss", site, field], "missing_attribute", severity, field, f"Missing {label.lower()}", f"{label} is missing.", None, head)
        for c, field, label, severity, head in (
            ("supplier_name", "name", "Supplier name", "high", False), ("supplier_number", "supplierNumber", "Supplier number", "high", True),
            ("supplier_type", "type", "Supplier type", "medium", True), ("payment_terms", "paymentTerms", "Payment terms", "medium", False),
            ("pay_group", "payGroup", "Pay group", "medium", False), ("payment_method", "paymentMethod", "Payment method", "medium", False),
            ("country", "country", "Country", "medium", False),
        )
    ]

    def severity(status: Column) -> Column:
        chain = F.lit("medium")
        for k, s in VAT_SEVERITY.items():
            chain = F.when(status == k, s).otherwise(chain)
        return chain

    sv, tv, has_site_vat = F.col("sv"), F.col("tv"), F.coalesce("site_vat", F.lit("")) != ""
    none, bad = sv["status"] == "missing", sv["status"] != "ok"
    vat_issues = [
        _issue(bad, ["vat", "supplier", site, sv["status"]], F.when(none, "missing_attribute").otherwise("invalid_vat"), severity(sv["status"]), "supplierVat",
               F.when(none, "Missing supplier VAT").otherwise("Incorrect supplier VAT"), sv["message"], sv["suggestion"], True),
        _issue(~bad & sv["suggestion"].isNotNull(), ["vat", "supplier", site, "spacing"], "rationalise", "low", "supplierVat", "VAT ID spacing", sv["message"], sv["suggestion"], True),
        _issue(has_site_vat & (tv["status"] != "ok"), ["vat", "site", site, tv["status"]], "invalid_vat", severity(tv["status"]), "siteVat", "Incorrect site VAT", tv["message"], tv["suggestion"]),
        _issue(has_site_vat & (tv["status"] == "ok") & tv["suggestion"].isNotNull(), ["vat", "site", site, "spacing"], "rationalise", "low", "siteVat", "Site VAT spacing", tv["message"], tv["suggestion"]),
        _issue(~has_site_vat, ["vat", "site", site, "missing"], "missing_attribute", "medium", "siteVat", "Missing site VAT", "Site VAT ID is missing."),
        _issue((F.col("_sn") != "") & (F.col("_tn") != "") & (F.col("_sn") != F.col("_tn")), ["vat", "mismatch", site], "invalid_vat", "medium", "siteVat", "Supplier and site VAT differ",
               F.concat(F.lit("Supplier VAT "), "_vat", F.lit(" does not match site VAT "), "site_vat", F.lit(".")), F.col("_sn")),
    ]
    always = F.lit(True)
    lacking = lambda a: a["kind"].startswith("missing")
    address_issues = F.transform("_addr", lambda a: _issue(
        always, ["addr", site, a["kind"], a["field"]], F.when(lacking(a), "missing_attribute").otherwise("invalid_address"), F.when(lacking(a), "medium").otherwise("high"),
        a["field"], F.when(lacking(a), F.concat(F.lit("Missing "), a["field"])).otherwise("Incorrect address"), a["message"], a["suggestion"]))
    rat_issues = F.transform("_rat", lambda h: _issue(
        always, ["rat", site, h["field"], h["value"]], "rationalise", "low", h["field"], "Rationalise attribute", h["reason"], h["suggestion"], h["field"] == "type"))
    issues = F.concat(F.array_compact(F.array(*missing, *vat_issues)), address_issues, rat_issues)
    helpers = ("_terms", "_group", "_vat", "_addr", "_rat", "_sn", "_tn", "sv", "tv", "term_count", "group_count", "population")
    return r.withColumn("issues", issues).drop(*helpers)


def issue_table(with_issue_arrays: DataFrame) -> DataFrame:
    # An inner explode would push "has issues" below the assessment and evaluate all of it again.
    exploded = with_issue_arrays.select("supplier_id", "site_id", F.explode_outer("issues").alias("issue"))
    return exploded.filter("issue is not null").select("supplier_id", "site_id", "issue.*")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues by type and severity with subtotals, and the records that have any."""
    return issues.groupingSets([[F.col("type")], [F.col("severity")], []], F.col("type"), F.col("severity")).agg(
        F.count(F.lit(1)).alias("issues"), F.countDistinct("site_id").alias("records")
    )


def distributions(suppliers: DataFrame, sites: DataFrame, top: int | None = None) -> DataFrame:
    """``(attribute, value, count)``; blank is a value. With ``top``, the most frequent per attribute."""
    attributes = {"paymentTerms": "payment_terms", "payGroup": "pay_group", "paymentMethod": "payment_method", "country": "country"}
    stack = ", ".join(f"'{k}', {v}" for k, v in attributes.items())
    values = sites.selectExpr(f"stack({len(attributes)}, {stack}) AS (attribute, value)").unionByName(
        suppliers.select(F.lit("type").alias("attribute"), F.col("type").alias("value"))
    )
    counts = values.groupBy("attribute", text_or_empty("value").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if top is None:
        return counts
    w = Window.partitionBy("attribute").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def grouped(with_issue_arrays: DataFrame) -> DataFrame:
    """Per supplier: sites and issues that differ in record type, field, type or title."""
    key = F.concat_ws(":", "record_type", "field", "type", "title")
    sites = with_issue_arrays.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("site_count"))
    unique = issue_table(with_issue_arrays).groupBy("supplier_id", key.alias("issue_key")).agg(F.min("severity").alias("severity"))
    issues = unique.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("unique_issues"))
    return sites.join(issues, "supplier_id", "left").fillna(0, ["unique_issues"])


# --- lists -----------------------------------------------------------------------

def _haystack(*cols: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))


def filter_sites(sites: DataFrame, suppliers: DataFrame, q: str | None = None, **equal: str) -> DataFrame:
    """Sites by exact attributes and by a keyword in the site's or its supplier's text."""
    out = sites
    for name, value in equal.items():
        out = out.filter(F.col(name) == value)
    word = (q or "").strip().lower()
    if not word:
        return out
    hits = suppliers.filter(_haystack("name", "supplier_number", "supplier_vat").contains(word)).select(F.col("id").alias("supplier_id"), F.lit(True).alias("_hit"))
    hay = _haystack("site_code", "site_vat", "city", "payment_terms", "pay_group", "operating_unit", "org_id")
    return out.join(hits, "supplier_id", "left").filter(hay.contains(word) | F.col("_hit")).drop("_hit").select(*sites.columns)


def filter_records(with_issue_arrays: DataFrame, issue: str | None = None, q: str | None = None, **equal: str) -> DataFrame:
    out = with_issue_arrays
    if issue:
        # A semi-join on the issue table: a predicate on the array would be pushed below it and computed twice.
        wanted = issue_table(with_issue_arrays)
        wanted = wanted if issue == "any" else wanted.filter(F.col("type") == issue)
        out = out.join(wanted.select("site_id").distinct(), "site_id", "left_semi")
    for name, value in equal.items():
        out = out.filter(F.col(name) == value)
    word = (q or "").strip().lower()
    if word:
        out = out.filter(_haystack("supplier_name", "supplier_number", "supplier_vat", "site_code", "site_vat", "city", "payment_terms", "pay_group", "operating_unit", "org_id").contains(word))
    return out


def page(sites: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in id order; ``limit`` is 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset at least 0")
    return sites.orderBy("id").offset(offset).limit(limit)


def total(sites: DataFrame) -> DataFrame:
    """Number of rows that pages are cut from."""
    return sites.agg(F.count(F.lit(1)).alias("total"))


def site_labels(sites: DataFrame) -> DataFrame:
    """Label per site: its code, with terms or pay group where siblings share the code."""
    code = F.coalesce(F.nullif(text_or_empty("site_code"), F.lit("")), F.nullif(text_or_empty("city"), F.lit("")), F.lit("Site"))
    s = sites.select("id", "supplier_id", code.alias("code"), text_or_empty("payment_terms").alias("terms"), text_or_empty("pay_group").alias("grp"))
    shared = s.groupBy("supplier_id", "code").agg(F.count(F.lit(1)).alias("sharing"))
    extra = F.coalesce(F.nullif("terms", F.lit("")), F.nullif("grp", F.lit("")))
    label = F.when((F.col("sharing") > 1) & extra.isNotNull(), F.concat_ws(" · ", "code", extra)).otherwise(F.col("code"))
    return s.join(shared, ["supplier_id", "code"]).select("id", label.alias("label"))
