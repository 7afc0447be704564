"""The supplier import package: the working copy laid over the source extracts, as four sheets and a report of what differs.

A source row is a map of its cells, so columns that no sheet knows travel with it and new extract columns need no code. Lookups keep
one row per key before they meet the working copy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import strip
from ..functions.vat import split_vat
from .supplier_edits import in_scope

# The heads of the four sheets in order, the cells whose name does not follow from the head, flags and dates among them.
SUPPLIER_HEADS = (
    "Import Action", "Batch ID", "Supplier Name", "Supplier Number", "Alternate Name", "Inactive Date", "Supplier Type", "One Time Supplier Flag", "Customer Number", "Alias",
    "DUNS Number", "SIC", "National Insurance Number", "Corporate Website", "Chief Executive Title", "Chief Executive Name", "Tax Organization Type", "Taxpayer ID",
    "Federal Reportable", "Federal Income Tax Type", "Tax Reporting Name", "Name Control", "Tax Verification Date", "Withholding Tax Group", "VAT Code",
    "Tax Registration Number", "Business Relationship", "Taxpayer Country", "Parent Supplier Name", "Delivery Channel", "Bank Instruction 1", "Bank Instruction 2",
    "Bank Instruction", "Settlement Priority", "Payment Text Message 1", "Payment Text Message 2", "Payment Text Message 3", "Bank Charge Bearer", "Payment Reason",
    "Payment Reason Comments", "Payment Format", "Pay Each Document Alone", "Remittance Advice Fax",
)
ADDRESS_HEADS = (
    "Import Action", "Batch ID", "Supplier Name", "Supplier Number", "Address Name", "Country", "Address Line 1", "Address Line 2", "Address Line 3", "Address Line 4",
    "City", "State", "Province", "County", "Postal Code", "Addressee", "Phone Country Code", "Phone Area Code", "Phone", "Phone Extension", "Fax Country Code",
    "Fax Area Code", "Fax", "RFQ or Bidding", "Ordering", "Pay", "Email Address", "Inactive Date", "Language", "Global Location Number",
)
SITE_HEADS = (
    "Import Action", "Batch ID", "Supplier Name", "Supplier Number", "Procurement BU", "Address Name", "Supplier Site", "Alternate Site Name", "Inactive Date",
    "Purchasing", "Procurement Card", "Pay", "Primary Pay", "Sourcing Only", "Email", "Country of Origin", "Invoice Currency", "Invoice Amount Limit",
    "Invoice Match Option", "Payment Currency", "Payment Priority", "Pay Group", "Payment Terms", "Terms Date Basis", "Pay Date Basis", "Always Take Discount",
    "Exclude Freight From Discount", "Create Interest Invoices", "Payment Method", "Hold Flag", "Hold Reason", "Freight Terms", "Pay On Receipt", "FOB",
    "Communication Method", "Customer Number", "Invoice Summary Level", "Gapless Invoice Numbering", "Selling Company Identifier", "Delivery Channel",
    "Bank Instruction 1", "Bank Instruction 2", "Bank Instruction", "Settlement Priority", "Payment Text Message 1", "Payment Text Message 2",
    "Payment Text Message 3", "Bank Charge Bearer", "Payment Reason", "Payment Reason Comments", "Delivery Method", "Remittance Email", "Remittance Fax",
    "Pay Each Document Alone", "Tax Registration Number",
)
ASSIGNMENT_HEADS = (
    "Import Action", "Batch ID", "Supplier Name", "Supplier Number", "Supplier Site", "Procurement BU", "Client BU", "Bill-to BU", "Ship to Exception Action",
    "Bill to Exception Action", "Inactive Date",
)
SHEET_NAMES = {"suppliers": "POZ_SUPPLIERS_INT", "addresses": "POZ_SUP_ADDRESSES_INT", "sites": "POZ_SUPPLIER_SITES_INT", "assignments": "POZ_SITE_ASSIGNMENTS_INT", "overlays": "overlay-report"}
CELLS = {
    "suppliers": {"Supplier Type": "tax_organization_type", "One Time Supplier Flag": "one_time_supplier", "Corporate Website": "corporate_web_site", "Remittance Advice Fax": "remittance_fax"},
    "addresses": {}, "assignments": {"Client BU": "procurement_bu", "Bill-to BU": "procurement_bu"},
    "sites": {"Communication Method": "comm_method", "Tax Registration Number": "site_vat"},
}
#: Cells with a second name, tried if the first is absent.
EITHER = {("suppliers", "Alias"): ("alias1", "alias"), ("addresses", "Email Address"): ("e_mail", "email")}
#: Flags and what stands for a blank one.
FLAGS = {
    "suppliers": {"One Time Supplier Flag": "N", "Federal Reportable": "", "Pay Each Document Alone": ""},
    "addresses": {"RFQ or Bidding": "", "Ordering": "Y", "Pay": "Y"}, "assignments": {},
    "sites": {
        "Purchasing": "Y", "Procurement Card": "N", "Pay": "Y", "Primary Pay": "Y", "Sourcing Only": "N", "Always Take Discount": "", "Exclude Freight From Discount": "",
        "Create Interest Invoices": "", "Hold Flag": "", "Pay On Receipt": "", "Gapless Invoice Numbering": "", "Pay Each Document Alone": "",
    },
}
DATES = ("Inactive Date", "Tax Verification Date")
NEW_SITE = {"purchasing": "Y", "pay": "Y", "primary_pay": "Y", "procurement_card": "N", "invoice_match_option": "P", "payment_priority": "99", "terms_date_basis": "Invoice", "pay_date_basis": "DUE"}
NEW_ADDRESS = {"rfq_or_bidding": "N", "ordering": "Y", "pay": "Y"}
RELATIONSHIP = "SPEND_AUTHORIZED"
OVERLAY_COLUMNS = ("sheet", "key", "field", "from", "to")


def _blank(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def _or(*each: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(F.when(x != "", x) for x in each), F.lit(""))


def yes_no(value: Column, other: str = "") -> Column:
    v = _blank(value)
    return F.when(v == "", other).when(v.rlike("(?i)^(y|yes|true|1)$"), "Y").when(v.rlike("(?i)^(n|no|false|0)$"), "N").otherwise(F.upper(v))


def slashed_date(value: Column) -> Column:
    v = _blank(value)
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(F.substring(v, 1, 10), "-", "/")).otherwise(v)


def _cells(extract: DataFrame) -> Column:
    """A row's cells by column name, null cells left out."""
    names = [c for c in extract.columns if c != "row_number"]
    return F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in names)), F.array(*(F.col(f"`{c}`").cast("string") for c in names))), lambda _, v: v.isNotNull())


def _by(extract: DataFrame, key: Column, name: str, last: bool = True) -> DataFrame:
    """One row per key: the last in file order, or the first."""
    picked = (F.max_by if last else F.min_by)(_cells(extract), F.col("row_number")).alias(name)
    return extract.withColumn("_key", key).where("_key <> ''").groupBy("_key").agg(picked)


def _meet(df: DataFrame, found: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("_key", key).join(found, "_key", "left").drop("_key")


def _overlaid(df: DataFrame, source: Column, fields: dict[str, Column], sheet: str, key: Column, new: dict[str, str], ids: dict[str, Column]) -> DataFrame:
    """``df`` with ``row`` (cells of the source with the working copy's over them), ``synthesized`` and ``differences``.

    A null value leaves the cell alone. Rows without a source get the defaults of ``new``; their cells are no differences.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    d = df.withColumns({"_src": F.coalesce(source, empty), "synthesized": source.isNull()})
    d = d.withColumns({f"_o_{f}": v for f, v in fields.items()})
    held = lambda f: F.coalesce(F.col("_src")[f], F.lit(""))
    changed = [F.when(F.col(f"_o_{f}") != held(f), F.struct(F.lit(f).alias("field"), held(f).alias("from"), F.col(f"_o_{f}").alias("to"))) for f in fields]
    d = d.withColumn("_moves", F.array_compact(F.array(*changed)))
    over = F.map_from_entries(F.transform("_moves", lambda m: F.struct(m["field"].alias("k"), m["to"].alias("v"))))
    d = d.withColumn("_over", over)
    d = d.withColumn("_made", F.map_concat(F.map_filter("_src", lambda k, _: ~F.map_contains_key(F.col("_over"), k)), "_over"))
    filled = {**ids, **{f: F.when(F.col("synthesized"), v) for f, v in new.items()}}
    given = [F.when((F.coalesce(F.col("_made")[f], F.lit("")) == "") & v.isNotNull(), F.struct(F.lit(f).alias("k"), v.alias("v"))) for f, v in filled.items()]
    d = d.withColumn("_more", F.map_from_entries(F.array_compact(F.array(*given))) if given else empty)
    row = F.map_concat(F.map_filter("_made", lambda k, _: ~F.map_contains_key(F.col("_more"), k)), "_more")
    told = F.transform(F.when(~F.col("synthesized"), F.col("_moves")), lambda m: F.struct(F.lit(sheet).alias("sheet"), key.alias("key"), m["field"].alias("field"), m["from"].alias("from"), m["to"].alias("to")))
    return d.withColumns({"row": row, "differences": F.coalesce(told, F.array().cast("array<struct<sheet:string,key:string,field:string,from:string,to:string>>"))}).drop("_src", "_moves", "_over", "_made", "_more", *(f"_o_{f}" for f in fields))


def _sheet(name: str, heads: tuple[str, ...], given: dict[str, Column]) -> list[Column]:
    """The sheet's columns: given ones, else the cell that the head names, as a flag or date where it is one."""

    def cell(head: str) -> Column:
        if head in given:
            return given[head]
        row = F.col("row")
        names = EITHER.get((name, head)) or (CELLS[name].get(head) or head.lower().replace(" ", "_"),)
        value = F.coalesce(*(row[n] for n in names), F.lit(""))
        if head in FLAGS[name]:
            return yes_no(value, FLAGS[name][head])
        return slashed_date(value) if head in DATES else value

    return [cell(h).alias(h) for h in heads]


@dataclass
class Package:
    """The sheets by name, the differences, and what the sheets were made of."""

    batch: str
    action: str
    sheets: dict[str, DataFrame]
    overlays: DataFrame
    counts: DataFrame


def build_package(
    suppliers: DataFrame, sites: DataFrame, audit: DataFrame, profiles: DataFrame, source_sites: DataFrame, addresses: DataFrame, batch: str, scope: str = "all", action: str | None = None,
    relationship: str = RELATIONSHIP,
) -> Package:
    """The package of a scope (see `in_scope`). Suppliers and sites go in the order of their ids; extracts need ``row_number``.

    Of suppliers with one number the first makes the row, of addresses of one number and name as well; rows without a source
    are created, the others get ``action``. Differences are listed for all rows in scope, also for those that make no row.
    """
    action = action or ("CREATE" if scope == "new" else "UPDATE")
    wanted = in_scope(suppliers, sites, profiles, source_sites, audit, scope, action).drop("import_action")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    optional = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    # lookups: one row per key
    by_vid, by_number = _by(profiles, _blank("vid"), "_p_vid"), _by(profiles, _blank("supplier_number"), "_p_number")
    number_of = by_vid.select(F.col("_key").alias("_vid"), _blank(F.col("_p_vid")["supplier_number"]).alias("_number"))
    with_number = source_sites.withColumn("_vid", _blank("vid")).join(number_of, "_vid", "left").drop("_vid")
    coded = F.when((F.col("_number") != "") & (_blank("supplier_site") != ""), F.concat("_number", F.lit("|"), F.upper(_blank("supplier_site")))).otherwise("")
    by_code = with_number.withColumn("_code", coded).where("_code <> ''").groupBy(F.col("_code").alias("_key")).agg(F.max_by(_cells(source_sites), F.col("row_number")).alias("_s_code"))
    by_sid = _by(source_sites, _blank("sid"), "_s_sid")
    named = F.when((_blank("vid") != "") & (F.upper(_blank("address_name")) != ""), F.concat(_blank("vid"), F.lit("|"), F.upper(_blank("address_name")))).otherwise("")
    by_name, by_first = _by(addresses, named, "_a_name"), _by(addresses, _blank("vid"), "_a_first", last=False)

    # suppliers
    heads = _meet(_meet(wanted, by_vid, F.col("id")), by_number, text("supplier_number"))
    source = F.coalesce("_p_vid", "_p_number")
    vat, trn = _blank("supplier_vat"), text("tax_registration_number")
    taxpayer = _or(_blank("taxpayer_id"), F.when(_blank(source["taxpayer_id"]) == _blank(source["tax_registration_number"]), vat).otherwise(_blank(source["taxpayer_id"])))
    once = F.when(F.col("one_time"), "Y").otherwise("N") if dict(suppliers.dtypes)["one_time"] == "boolean" else yes_no(F.col("one_time"), "N")
    heads = _overlaid(heads, source, {
        "supplier_name": F.col("name"), "supplier_number": F.col("supplier_number"), "tax_organization_type": F.col("type"), "inactive_date": text("inactive_date"),
        "one_time_supplier": once, "tax_registration_number": _or(vat, trn), "taxpayer_id": taxpayer,
    }, "suppliers", _or(F.col("supplier_number"), F.col("id")), {}, {"vid": F.col("id")})
    heads = heads.withColumn("number", _or(_blank(F.col("row")["supplier_number"]), F.col("supplier_number")))
    countries = sites.where(_blank("country") != "").groupBy("supplier_id").agg(F.min_by("country", "id").alias("_country")).withColumnRenamed("supplier_id", "id")
    heads = heads.join(countries, "id", "left")
    split = split_vat(_or(vat, F.col("row")["tax_registration_number"]), F.coalesce("_country", F.lit("")))
    code = F.coalesce(F.when(split["country_code"] == "EL", "GR").otherwise(split["country_code"]), F.substring(F.upper(_blank("_country")), 1, 2))
    import_action = lambda d: F.when(F.col("synthesized"), "CREATE").otherwise(action)
    common = {"Import Action": import_action(heads), "Batch ID": F.lit(batch)}
    first = heads.groupBy(_or(F.col("number"), F.col("id")).alias("_once")).agg(F.min("id").alias("id"))
    printed = heads.join(first.select("id"), "id", "left_semi")
    supplier_sheet = printed.select("id", *_sheet("suppliers", SUPPLIER_HEADS, {**common, "Business Relationship": F.lit(relationship), "Taxpayer Country": code}))

    # sites and their addresses
    owner = heads.select(F.col("id").alias("supplier_id"), F.col("name").alias("_name"), F.col("supplier_number").alias("_their_number"), F.col("number").alias("_printed_number"))
    places = sites.join(owner, "supplier_id")
    key = F.concat(_blank("_their_number"), F.lit("|"), F.upper(_blank("site_code")))
    address_name = _or(F.col("address_name"), F.col("site_code"))
    at = _meet(_meet(places, by_sid, F.col("id")), by_code, key)
    at = _overlaid(at, F.coalesce("_s_sid", "_s_code"), {
        "supplier_name": F.col("_name"), "procurement_bu": F.col("procurement_bu"), "address_name": address_name, "supplier_site": F.col("site_code"), "inactive_date": text("inactive_date"),
        "email": F.coalesce(optional(sites, "email"), F.lit("")), "invoice_currency": F.col("invoice_currency"), "payment_currency": F.col("payment_currency"), "pay_group": F.col("pay_group"),
        "payment_terms": F.col("payment_terms"), "payment_method": F.col("payment_method"), "site_vat": F.col("site_vat"),
    }, "sites", key, NEW_SITE, {"vid": F.col("supplier_id"), "sid": F.col("id")})
    of_site = {"Import Action": import_action(at), "Batch ID": F.lit(batch), "Supplier Number": F.col("_printed_number")}
    site_sheet = at.select("id", *_sheet("sites", SITE_HEADS, of_site))
    blank = {"Ship to Exception Action": F.lit(""), "Bill to Exception Action": F.lit("")}
    assignment_sheet = at.select("id", *_sheet("assignments", ASSIGNMENT_HEADS, {**of_site, **blank}))
    by_site = _meet(_meet(places, by_name, F.concat("supplier_id", F.lit("|"), F.upper(_blank(address_name)))), by_first, F.col("supplier_id"))
    found = F.coalesce("_a_name", "_a_first")
    extra = lambda c: F.coalesce(optional(sites, c), F.lit(""))
    rows = _overlaid(by_site, found, {
        "supplier_name": F.col("_name"), "address_name": address_name, "country": F.col("country"), "address_line_1": F.col("address_line1"), "address_line_2": extra("address_line2"), "city": F.col("city"),
        "state": extra("state"), "province": extra("province"), "county": extra("county"), "postal_code": F.col("postal_code"), "e_mail": F.coalesce(optional(sites, "email"), found["e_mail"], F.lit("")),
    }, "addresses", F.concat(text("_their_number"), F.lit("|"), address_name), NEW_ADDRESS, {"vid": F.col("supplier_id")})
    rows = rows.withColumn("_once", F.concat("_printed_number", F.lit("|"), F.upper(_blank(F.col("row")["address_name"]))))
    firsts = rows.groupBy("_once").agg(F.min_by(F.col("id"), F.struct("supplier_id", "id")).alias("id"))
    number = _or(F.col("_printed_number"), F.col("row")["supplier_number"])
    address_sheet = rows.join(firsts.select("id"), "id", "left_semi").select("id", *_sheet("addresses", ADDRESS_HEADS, {"Import Action": import_action(rows), "Batch ID": F.lit(batch), "Supplier Number": number}))

    every = heads.select("synthesized", "differences").unionByName(at.select("synthesized", "differences")).unionByName(rows.select("synthesized", "differences"))
    overlays = every.select(F.explode("differences").alias("d")).select("d.*")
    counts = every.agg(F.count_if(F.size("differences") > 0).alias("overlayed"), F.count_if("synthesized").alias("synthesized"))
    return Package(batch, action, {"suppliers": supplier_sheet, "addresses": address_sheet, "sites": site_sheet, "assignments": assignment_sheet}, overlays, counts)


def package_counts(package: Package) -> DataFrame:
    """One row: rows of each sheet, rows that were overlaid and rows that were made up, and differences."""
    out = package.counts
    for name, df in {**package.sheets, "overlays": package.overlays}.items():
        out = out.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return out.withColumn("batch", F.lit(package.batch))


def list_packages(files: DataFrame, manifests: DataFrame, prefix: str) -> DataFrame:
    """Saved packages, newest first by ``rank``: ``batch, created_at, actor, scope, action, counts, files``.

    ``files``: ``key, size, last_modified`` of the stored objects; ``manifests``: ``key, content`` of those that end in manifest.json. A package without a
    readable manifest is as old as its newest file. Loose files beside the package folders are no packages.
    """
    root = prefix.rstrip("/") + "/"
    rest = F.when(F.col("key").startswith(root), F.substring("key", F.lit(len(root) + 1), F.length("key"))).otherwise(F.col("key"))
    batch = F.get(F.filter(F.split(rest, "/"), lambda p: p != ""), F.lit(0))
    keyed = files.withColumn("batch", batch).where(F.col("batch").isNotNull() & ~F.lower("batch").rlike(r"\.(csv|zip)$"))
    name = F.element_at(F.split("key", "/"), -1)
    grouped = keyed.groupBy("batch").agg(
        F.max("last_modified").alias("_newest"), F.array_sort(F.collect_list(F.struct("key", name.alias("name"), "size"))).alias("files"),
    )  # a package has a handful of files
    schema = "createdAt string, actor string, scope string, importAction string, counts map<string,bigint>"
    told = manifests.withColumn("batch", batch).groupBy("batch").agg(F.from_json(F.min("content"), schema).alias("m"))
    out = grouped.join(told, "batch", "left").select(
        "batch", F.coalesce("m.createdAt", "_newest").alias("created_at"), "m.actor", "m.scope", F.col("m.importAction").alias("action"), "m.counts", "files",
    )
    newest = Window.orderBy(F.desc("created_at"), "batch")  # one row per package, written by hand
    return out.withColumn("rank", F.row_number().over(newest))
