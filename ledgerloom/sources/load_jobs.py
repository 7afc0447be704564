"""Load jobs: extract files of a landing area to tables, with a report per file.

All files of a job are read in one pass. Rows are numbered and written once; tables, row counts and errors come from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import to_cents
from ..operators import reference_docs as ref
from ..operators.suppliers import map_extracts
from ..session import materialise
from . import csv_records as csv
from . import landing
from .sinks import replace_snapshot, replace_working_copy

# How files are recognised (role, area, order of preference, pattern of the name, names that are something else).
REFERENCE_FILES = (
    ("ap_header", "ap", 1, "ap_invoice_header", ""), ("ap_header", "ap", 2, "inv_header", ""), ("ap_header", "ap", 3, "invoice_header", ""),
    ("ap_line", "ap", 1, "ap_invoice_line", ""), ("ap_line", "ap", 2, "inv_lines?", ""), ("ap_line", "ap", 3, "invoice_line", ""),
    ("po_header", "po", 1, "po_header", ""), ("po_header", "po", 2, "purchase_order_header", ""),
    ("po_line", "po", 1, "po_lines?", "location|distribution"), ("po_line", "po", 2, "purchase_order_line", ""),
    ("so_header", "so", 1, "sales_order_header", ""), ("so_header", "so", 2, "so_header", ""), ("so_charge", "so", 1, "charges_component", ""),
    ("remittance", "rem", 1, "remittance", ""),
)
SUPPLIER_FILES = (
    ("profile", "supplier", 1, "supplier_profile", ""), ("site", "supplier", 1, "supplier_site", "assignment|vat"), ("address", "supplier", 1, "supplier_address", "contact"),
    ("vat", "supplier", 1, "vatid|supplier_site_vat|suppliersitevat", ""),
)
RELOADED = "Reload working copy from object storage"


def file_rules(spark: SparkSession, rules: tuple, prefixes: dict[str, str]) -> DataFrame:
    """Rules as a table, each with the prefix of its area."""
    rows = [(role, prefixes[area], n, pattern, other) for role, area, n, pattern, other in rules if area in prefixes]
    return spark.createDataFrame(rows, "role string, prefix string, priority int, pattern string, other string")


def pick_role_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``role, key``: of the CSV files under the rule's prefix the last listed that its first fitting pattern names."""
    name = F.lower(F.element_at(F.split("key", "/"), -1))
    listed = files.where(F.lower("key").endswith(".csv")).select("key", name.alias("_name"))
    met = listed.crossJoin(F.broadcast(rules)).where(  # some rules for each file
        "startswith(key, prefix) AND _name rlike pattern AND (other = '' OR NOT _name rlike other)")
    return met.groupBy("role").agg(F.max_by("key", F.struct(-F.col("priority"), "key")).alias("key"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Keys under a root, relative to it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return found.select(relative_key(root, F.col("path")).alias("key"))


def relative_key(root: str, path: Column) -> Column:
    return F.regexp_replace(F.url_decode(path), r"^.*?" + root.strip("/").replace(".", r"\.") + "/", "")


class Loaded:
    """Rows of the picked files by role, and what was read of each file."""

    def __init__(self, spark: SparkSession, root: str, picked: DataFrame):
        picked = materialise(picked)
        key = relative_key(root, F.col("file_path"))
        records = csv.csv_records(spark, root, only=picked.select("key"), key=key).withColumn("key", key)
        self.records = materialise(records.join(F.broadcast(picked), "key").select("role", "key", "row_number", "record"))  # a file per role
        open_rows = csv.open_quotes(spark, root, only=picked.select("key"), key=key).select(key.alias("key"), "error")
        self.errors = open_rows.groupBy("key").agg(F.min("error").alias("error"))
        rows = self.records.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        self.files = picked.join(rows, "key", "left").select("role", "key", F.coalesce("rows", F.lit(0)).alias("rows"))

    def table(self, role: str) -> DataFrame:
        """The rows of a role as columns; without any, ``row_number`` alone."""
        mine = self.records.where(F.col("role") == role)
        first = mine.select(F.map_keys("record").alias("names")).first()  # one file, one header
        names = first["names"] if first else []
        return mine.select("row_number", *(F.col("record")[n].alias(n) for n in names if n and n != "row_number"))

    def name(self, role: str) -> str | None:
        """Key of the role's file."""
        row = self.files.where(F.col("role") == role).select("key").first()
        return row["key"] if row else None


def load_reference(spark: SparkSession, root: str, prefixes: dict[str, str], target: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Sales orders, purchase orders with AP invoices, and remittances from the newest extracts, replacing those in ``target``.

    Gives the report per file (``role, key, rows``), the errors (``key, error``) and the rows of each table. ``prefixes`` names the
    areas ap, po, so and rem. A missing file leaves its table empty.
    """
    loaded = Loaded(spark, root, pick_role_files(files if files is not None else list_files(spark, root), file_rules(spark, REFERENCE_FILES, prefixes)))
    t = loaded.table
    invoices = ref.ap_invoices(t("ap_header"), t("ap_line"), loaded.name("ap_header"))
    orders = ref.purchase_orders(t("po_header"), t("po_line"), loaded.name("po_header"))
    tables = {
        "sales_orders": ref.sales_orders(t("so_header"), t("so_charge"), loaded.name("so_header")),
        "purchase_orders": ref.merge_purchase_orders(orders, invoices), "remittances": ref.remittances(t("remittance"), loaded.name("remittance")),
    }
    replace_snapshot(tables, target)
    counts = {name: spark.read.parquet(f"{target}/{name}").count() for name in tables}
    return loaded.files, loaded.errors, {**counts, "ap_invoices": invoices.count()}


def load_suppliers(spark: SparkSession, root: str, prefix: str, target: str, stamp: str, sample_root: str | None = None, actor: str = "ingest") -> tuple[DataFrame, DataFrame, bool]:
    """Suppliers and sites from the newest extracts, replacing the working copy; the history gets one event.

    Samples are read where the prefix holds no CSV file. Gives the report per file, the errors, and whether samples were used.
    """
    files = list_files(spark, root).where(F.col("key").startswith(prefix) & F.lower("key").endswith(".csv"))
    used_samples = sample_root is not None and files.isEmpty()
    if used_samples:
        root, prefix = sample_root, ""
        files = list_files(spark, root)
    loaded = Loaded(spark, root, pick_role_files(files, file_rules(spark, SUPPLIER_FILES, {"supplier": prefix})))
    columns = {"profile": PROFILE_CELLS, "site": SITE_CELLS, "address": ADDRESS_CELLS, "vat": VAT_CELLS}
    tables = {role: _with_columns(loaded.table(role), names) for role, names in columns.items()}
    suppliers, sites = (materialise(df) for df in map_extracts(tables["profile"], tables["site"], tables["address"], tables["vat"]))
    told = F.to_json(F.struct(F.lit(suppliers.count()).alias("suppliers"), F.lit(sites.count()).alias("sites"), F.lit(loaded.files.count()).alias("files")))
    event = spark.range(1).select(
        F.concat(F.lit("AUD-"), F.uuid()).alias("id"), F.lit("supplier").alias("record_type"), F.lit("*").alias("record_id"), F.lit("ingest").alias("action"), F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("old_value"), told.alias("new_value"), F.lit(actor).alias("actor"), F.lit(RELOADED).alias("reason"), F.lit(stamp).alias("created_at"), F.lit(1).cast("bigint").alias("version"),
    )
    replace_working_copy(suppliers, sites, target, event)
    return loaded.files, loaded.errors, used_samples


# Cells of the supplier extracts that the mapping reads.
PROFILE_CELLS = ("vid", "supplier_number", "supplier_name", "tax_organization_type", "inactive_date", "one_time_supplier", "taxpayer_id", "tax_registration_number")
SITE_CELLS = ("vid", "sid", "supplier_name", "procurement_bu", "address_name", "supplier_site", "inactive_date", "email", "country_of_origin", "invoice_currency", "payment_terms")
ADDRESS_CELLS = ("vid", "address_name", "country", "address_line_1", "city", "postal_code")
VAT_CELLS = ("vid", "sid", "operating_unit", "org_id", "supplier_number", "supplier_vat", "vendor_site_code", "site_vat")


def _with_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def load_baseline(
    spark: SparkSession, root: str, statement_prefix: str, accounts: DataFrame, prefixes: dict[str, str], target: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Start again: statements and reference tables of ``target`` are replaced by what the landing area holds.

    Gives the statements taken, the errors of both loads, and the report of the reference files.
    """
    files = materialise(list_files(spark, root))
    none = files.where("false")
    plan = materialise(landing.plan_statements(files.where(F.col("key").startswith(statement_prefix)), statement_prefix, accounts, none))
    statements, lines, errors = (materialise(df) for df in landing.ingest_statements(spark, root, plan))
    replace_snapshot({"statements": statements, "bank_transactions": lines}, target)
    report, bad, _ = load_reference(spark, root, prefixes, target, files)
    return statements, errors.unionByName(bad), report


def uploaded_statement(spark: SparkSession, path: str, statement_id: str, account_id: str, currency: str, today: str, uploaded_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One uploaded bank file of a known account: its statement, lines and row errors. Without any line the period is today."""
    records = csv.csv_records(spark, path).withColumns({"statement_id": F.lit(statement_id), "account_id": F.lit(account_id)})
    rows = materialise(csv.bank_rows(records, currency))
    lines = csv.good(rows)
    name = path.rstrip("/").split("/")[-1]
    statement = lines.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("transaction_count")).select(
        F.lit(statement_id).alias("id"), F.lit(account_id).alias("account_id"), F.lit(name).alias("file_name"), F.lit("upload").alias("source"), F.coalesce("first", F.lit(today)).alias("period_start"),
        F.coalesce("last", F.lit(today)).alias("period_end"), "transaction_count", F.lit(f"statements/{statement_id}-{name}").alias("storage_key"), F.lit(uploaded_at).alias("uploaded_at"),
    )
    broken = csv.open_quotes(spark, path).select(F.lit(statement_id).alias("statement_id"), F.col("row_number").alias("data_index"), "error")
    return statement, lines, csv.bad(rows).unionByName(broken)


# Columns of the sample files, major units among them.
SAMPLES = {
    "accounts": ("id string, name string, bank string, currency string, openingBalance double", "openingBalance"),
    "sales-orders": ("id string, customer string, amount double, currency string, orderDate string, dueDate string, status string", "amount"),
    "purchase-orders": ("id string, vendor string, amount double, currency string, orderDate string, dueDate string, status string", "amount"),
    "remittances": ("id string, party string, name string, reference string, amount double, currency string, date string", "amount"),
}


def read_samples(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Bundled sample rows; amounts are written in major units and become cents, names become snake case."""
    schema, money = SAMPLES[kind]
    rows = spark.read.schema(schema).option("multiLine", "true").json(f"{folder}/{kind}.json")
    snake = lambda n: "".join(f"_{c.lower()}" if c.isupper() else c for c in n)
    return rows.select(*((to_cents(c) if c == money else F.col(c)).alias(snake(c)) for c in rows.columns))


def merged_accounts(samples: DataFrame, stored: DataFrame, statements: DataFrame) -> DataFrame:
    """Stored accounts; samples beside them only while no statement came from the landing area, and only for ids that are not stored."""
    real = statements.select((F.col("source") == "oci").alias("has_real"))
    kept = samples.join(stored.select("id"), "id", "left_anti")
    return landing.without_samples(kept, stored, real)


def all_transactions(samples: DataFrame, stored: DataFrame, statements: DataFrame) -> DataFrame:
    """Sample lines and stored ones, both kept; samples only while no statement came from the landing area."""
    return landing.without_samples(samples, stored, statements.select((F.col("source") == "oci").alias("has_real")))


def supporting_documents(samples: dict[str, DataFrame], stored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Reference tables; samples count only while all stored ones are empty."""
    gate = None
    for df in stored.values():
        any_row = df.limit(1).select(F.lit(True).alias("has_real"))
        gate = any_row if gate is None else gate.unionByName(any_row)
    return {name: landing.without_samples(samples[name], stored[name], gate) for name in stored}
