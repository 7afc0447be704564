"""Edits of supplier records: versions, audit, review, registry checks and import packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import text_or_empty
from ..functions.vat import split_vat

# Legal-form words left out of registry comparisons, and countries the registry serves.
LEGAL_SUFFIXES = (
    "NV", "BV", "BVBA", "SA", "SAS", "SARL", "SRL", "SPA", "SL", "LDA", "LTD", "LLC", "PLC", "GMBH", "AG", "KG", "OHG",
    "SRO", "SPOL", "OY", "AB", "AS", "APS", "KFT", "SIA", "UAB", "OOO", "INC", "CORP", "CO", "COMPANY", "LIMITED", "PUBLIC",
)
REGISTRY_COUNTRIES = (
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "EL", "ES", "FI", "FR", "HR", "HU", "IE", "IT", "LT", "LU", "LV", "MT",
    "NL", "PL", "PT", "RO", "SE", "SI", "SK", "XI",
)
NAME_MATCH = 0.5
ADDRESS_MATCH = 0.45


def net_field_changes(audit: DataFrame) -> DataFrame:
    """First old and last new value per record and field, where they differ."""
    updates = audit.filter("action = 'update' and field != ''")
    order = F.struct("created_at", "id")
    return (
        updates.groupBy("record_type", "record_id", "field")
        .agg(F.min_by(F.coalesce("old_value", F.lit("")), order).alias("from_value"), F.max_by(F.coalesce("new_value", F.lit("")), order).alias("to_value"),
             F.count(F.lit(1)).alias("updates"))
        .filter(F.col("from_value") != F.col("to_value"))
    )


def latest(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Newest row per key; of several at one time the first by id."""
    packed = F.struct("id", *values)
    newest = df.groupBy(key, "created_at").agg(F.min_by(packed, F.col("id")).alias("r"))
    return newest.groupBy(key).agg(F.max_by(F.struct("created_at", "r"), F.col("created_at")).alias("n")).select(key, "n.created_at", "n.r.*")


def newest(audit: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` newest audit rows with their ``rank``; a top-k report, so only those rows reach one task."""
    if rows < 1:
        raise ValueError("rows is at least 1")
    top = audit.orderBy(F.desc("created_at"), F.desc("id")).limit(rows)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).cast("bigint"))


def review(suppliers: DataFrame, sites: DataFrame, audit: DataFrame, vat_checks: DataFrame) -> DataFrame:
    """Edited suppliers: net header changes, sites with net changes, last edit and latest check.

    One row per (supplier, site) of those listed; a header-only edit keeps the
    supplier's first site so that its VAT can still be checked.
    """
    updates = audit.filter("action = 'update' and record_id != '*'")
    changes = net_field_changes(updates).groupBy("record_type", "record_id").agg(
        F.sort_array(F.collect_list(F.struct("field", "from_value", "to_value"))).alias("changes"))
    last = updates.groupBy("record_type", "record_id").agg(
        F.max_by(F.struct("created_at", "actor"), F.struct("created_at", F.col("id"))).alias("last"), F.count(F.lit(1)).alias("update_count"))
    of = lambda df, kind: df.filter(F.col("record_type") == kind).drop("record_type")
    site_rows = (
        sites.select(F.col("id").alias("site_id"), "supplier_id").join(of(last, "site").withColumnRenamed("record_id", "site_id"), "site_id", "left")
        .join(of(changes, "site").withColumnRenamed("record_id", "site_id"), "site_id", "left")
    )
    heads = (
        suppliers.select(F.col("id").alias("supplier_id"))
        .join(of(last, "supplier").select(F.col("record_id").alias("supplier_id"), F.col("last").alias("head_last"), F.col("update_count").alias("head_updates")), "supplier_id", "left")
        .join(of(changes, "supplier").select(F.col("record_id").alias("supplier_id"), F.col("changes").alias("head_changes")), "supplier_id", "left")
    )
    per_supplier = site_rows.groupBy("supplier_id").agg(F.count("update_count").alias("edited_sites"), F.min("site_id").alias("first_site"))
    rows = site_rows.join(per_supplier, "supplier_id").join(heads, "supplier_id")
    edited = F.col("changes").isNotNull()
    header_only = (F.col("edited_sites") == 0) & F.col("head_changes").isNotNull() & (F.col("site_id") == F.col("first_site"))
    header_with_quiet_sites = (F.col("edited_sites") > 0) & F.col("head_changes").isNotNull() & F.col("changes").isNull()
    kept = rows.filter(edited | header_only | (header_with_quiet_sites & (F.col("site_id") == F.col("first_site"))))
    kept = kept.withColumn("site_id", F.when(edited | header_only, F.col("site_id")))
    newest = F.coalesce("last", "head_last")
    checks = latest(vat_checks, "site_id", "validity").select("site_id", F.col("validity").alias("vat_check"))
    return kept.join(checks, "site_id", "left").select(
        "supplier_id", "site_id", "head_changes", "changes", newest["actor"].alias("last_actor"), newest["created_at"].alias("last_updated_at"),
        F.coalesce("update_count", F.lit(0)).alias("update_count"), "vat_check",
    )


# --- applying edits -----------------------------------------------------------

def apply_edits(records: DataFrame, patches: DataFrame, fields: tuple[str, ...], record_type: str, stamp: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next records, version snapshots and field audit for one batch of patches.

    ``records``: ``id, version`` and text ``fields``; ``patches``: ``id, field,
    value, actor``, at most one per (id, field). A patch that changes nothing is
    ignored. Where ``status`` changes, ``inactive_date`` follows: today when it
    becomes inactive without a date, empty when it becomes active.
    """
    wanted = patches.filter(F.col("field").isin(*fields) & F.col("value").isNotNull())
    packed = wanted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"), F.first("actor").alias("_actor"))
    joined = records.join(packed, "id", "left")
    current = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    new = lambda c: F.try_element_at("_new", F.lit(c))
    changed = {c: new(c).isNotNull() & (new(c) != current(c)) for c in fields}
    follows = "status" in fields and "inactive_date" in records.columns and "inactive_date" not in fields
    moved = [F.when(changed[c], F.struct(F.lit(c).alias("field"), current(c).alias("old_value"), new(c).alias("new_value"))) for c in fields]
    if follows:
        date = F.when(new("status") == "inactive", F.coalesce(F.nullif(current("inactive_date"), F.lit("")), F.lit(stamp[:10]))).otherwise("")
        date_moves = changed["status"] & (date != current("inactive_date"))
        moved.insert(0, F.when(date_moves, F.struct(F.lit("inactive_date").alias("field"), current("inactive_date").alias("old_value"), date.alias("new_value"))))
    staged = joined.withColumn("_moves", F.array_compact(F.array(*moved)))
    touched = F.size("_moves") > 0
    values = {c: F.when(changed[c], new(c)).otherwise(F.col(c)) for c in fields}
    if follows:
        values["inactive_date"] = F.when(date_moves, F.nullif(date, F.lit(""))).otherwise(F.col("inactive_date"))
    values["version"] = F.when(touched, F.col("version") + 1).otherwise(F.col("version"))
    next_records = staged.withColumns(values).select(*records.columns)
    versions = staged.filter(touched).select(
        F.lit(record_type).alias("record_type"), F.col("id").alias("record_id"), "version", F.to_json(F.struct(*records.columns)).alias("snapshot"),
        F.lit(stamp).alias("created_at"), F.col("_actor").alias("actor"))
    audit = staged.select("id", "version", "_actor", F.posexplode_outer("_moves").alias("position", "m")).filter("m is not null").select(
        F.lit(record_type).alias("record_type"), F.col("id").alias("record_id"), F.lit("update").alias("action"), "m.field", "m.old_value", "m.new_value",
        F.col("_actor").alias("actor"), F.lit(stamp).alias("created_at"), (F.col("version") + 1).alias("version"), "position")
    return next_records, versions, audit


# --- registry -------------------------------------------------------------------

def words(c: Column | str) -> Column:
    text = F.regexp_replace(F.upper(F.col(c) if isinstance(c, str) else c), r"[^A-Z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*LEGAL_SUFFIXES)))


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def compare_names(local: Column | str, registered: Column | str) -> Column:
    a, b = text_or_empty(local), text_or_empty(registered)
    score = overlap(words(a), words(b))
    return (
        F.when((a == "") | (b == ""), "unknown").when(F.upper(a) == F.upper(b), "match")
        .when(score >= NAME_MATCH, "match").when(score == 0, "mismatch").otherwise("unknown")
    )


def compare_addresses(street, city, postal, registered) -> Column:
    line, town, code, reg = (text_or_empty(x) for x in (street, city, postal, registered))
    tight = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    local = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (line, code, town)])
    has_code = (code != "") & tight(reg).contains(tight(code))
    far_town = (town != "") & ~F.upper(reg).contains(F.upper(town)) & (overlap(words(town), words(reg)) == 0)
    return (
        F.when((reg == "") | (local == ""), "unknown").when((code != "") & ~has_code, "mismatch").when(far_town, "mismatch")
        .when((overlap(words(local), words(reg)) >= ADDRESS_MATCH) | has_code, "match").otherwise("unknown")
    )


def registry_check(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Compare records with a registry table on (country, number).

    ``records``: ``site_id, vat, country, name, address_line1, city, postal_code``;
    ``registry``: ``country_code, vat_number, valid, registered_name, registered_address``.
    """
    r = records.withColumn("s", split_vat("vat", "country")).withColumns({"country_code": F.col("s.country_code"), "vat_number": F.col("s.vat_number")}).drop("s")
    j = r.join(registry, ["country_code", "vat_number"], "left")
    supported = F.col("country_code").isin(*REGISTRY_COUNTRIES)
    validity = F.when(F.col("country_code").isNull() | ~supported, "unsupported").when(F.col("valid"), "valid").when(~F.col("valid"), "invalid").otherwise("inconclusive")
    j = j.withColumn("validity", validity)
    only_valid = lambda c: F.when(F.col("validity") == "valid", c).otherwise("unknown")
    return j.select(
        "site_id", "country_code", "vat_number", "validity", only_valid(compare_names("name", "registered_name")).alias("name_match"),
        only_valid(compare_addresses("address_line1", "city", "postal_code", "registered_address")).alias("address_match"))


# --- import package ---------------------------------------------------------------

def source_matches(suppliers: DataFrame, sites: DataFrame, source_profiles: DataFrame, source_sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``suppliers`` with ``has_source`` and ``sites`` with ``has_source``.

    A profile is found by vid, else by supplier number; a site by sid, else by the supplier's number and its code without
    regard to case, the number of a source site being that of the last profile row with its vid. Sources need ``row_number``.
    """
    filled = lambda df, c: df.select(text_or_empty(c).alias("_key")).filter("_key != ''").distinct().withColumn("_hit", F.lit(True))
    hit = lambda df, keys, c, out: df.join(keys.withColumnRenamed("_hit", out), text_or_empty(c) == F.col("_key"), "left").drop("_key")
    heads = hit(hit(suppliers, filled(source_profiles, "vid"), "id", "_by_id"), filled(source_profiles, "supplier_number"), "supplier_number", "_by_number")
    heads = heads.withColumn("has_source", F.coalesce("_by_id", "_by_number", F.lit(False))).drop("_by_id", "_by_number")
    last = source_profiles.groupBy(text_or_empty("vid").alias("_vid")).agg(F.max_by(text_or_empty("supplier_number"), "row_number").alias("_number"))
    key = lambda number, code: F.concat_ws("|", number, F.upper(text_or_empty(code)))
    named = source_sites.join(last, text_or_empty("vid") == F.col("_vid")).filter((F.col("_number") != "") & (text_or_empty("supplier_site") != ""))
    named = named.select(key(F.col("_number"), "supplier_site").alias("_code"))
    numbers = suppliers.select(F.col("id").alias("supplier_id"), text_or_empty("supplier_number").alias("_number"))
    places = sites.join(numbers, "supplier_id", "left").withColumn("_code", key(F.coalesce("_number", F.lit("")), "site_code"))
    places = hit(hit(places, filled(source_sites, "sid"), "id", "_by_id"), filled(named, "_code"), "_code", "_by_code")
    return heads, places.withColumn("has_source", F.coalesce("_by_id", "_by_code", F.lit(False))).drop("_by_id", "_by_code", "_code", "_number")


def in_scope(
    suppliers: DataFrame, sites: DataFrame, source_profiles: DataFrame, source_sites: DataFrame, audit: DataFrame, scope: str = "all", action: str | None = None,
) -> DataFrame:
    """Suppliers of a package with their ``import_action``.

    ``new`` takes those without a source profile or with a site that has no source row; ``changed`` also those with a site
    of which, or of whose supplier, an update is on record. A supplier that has no source is created; others get
    ``action``, by default CREATE for the scope ``new``, else UPDATE.
    """
    if scope not in ("all", "new", "changed"):
        raise ValueError(f"no such scope: {scope}")
    heads, places = source_matches(suppliers, sites, source_profiles, source_sites)
    edits = audit.filter("action = 'update' and record_id != '*'").select(F.col("record_id").alias("_record")).distinct()
    seen = lambda df, c, out: df.join(edits.withColumn(out, F.lit(True)), F.col(c) == F.col("_record"), "left").drop("_record")
    facts = seen(seen(places, "id", "_site_edit"), "supplier_id", "_head_edit").groupBy(F.col("supplier_id").alias("_supplier")).agg(
        F.bool_or(~F.col("has_source")).alias("_new_site"), F.bool_or(F.coalesce("_site_edit", "_head_edit", F.lit(False))).alias("_changed"))
    out = heads.join(facts, F.col("id") == F.col("_supplier"), "left").drop("_supplier")
    is_new = ~F.col("has_source") | F.coalesce("_new_site", F.lit(False))
    kept = {"all": F.lit(True), "new": is_new, "changed": is_new | F.coalesce("_changed", F.lit(False))}[scope]
    given = F.lit(action or ("CREATE" if scope == "new" else "UPDATE"))
    return out.filter(kept).withColumn("import_action", F.when(~F.col("has_source"), "CREATE").otherwise(given)).drop("has_source", "_new_site", "_changed")


def overlay_report(working: DataFrame, source: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Field-level differences between the working copy and the source extract."""
    w, s = working.alias("w"), source.alias("s")
    j = w.join(s, F.col(f"w.{key}") == F.col(f"s.{key}"))
    pairs = [F.struct(F.lit(f).alias("field"), text_or_empty(f"s.{f}").alias("source_value"), text_or_empty(f"w.{f}").alias("package_value")) for f in fields]
    diffs = j.select(F.col(f"w.{key}").alias("id"), F.explode(F.array(*pairs)).alias("d")).select("id", "d.*")
    return diffs.filter("source_value != package_value")


def package_manifest(sheets: dict[str, DataFrame], batch: str) -> DataFrame:
    """One row per sheet with its row count."""
    out = None
    for name, df in sheets.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(batch).alias("batch"), F.lit(name).alias("sheet"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
