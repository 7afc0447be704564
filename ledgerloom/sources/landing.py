"""Landing folders: which files to take, which to skip, and where they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import csv_records as csv

# Name patterns per file role, in order of preference.
ROLE_PATTERNS = {
    "ap_header": ("ap_invoice_header", "inv_header", "invoice_header"),
    "ap_line": ("ap_invoice_line", "inv_lines?", "invoice_line"),
    "po_header": ("po_header", "purchase_order_header"),
    "so_header": ("sales_order_header", "so_header"),
    "so_charge": ("charges_component",),
    "remittance": ("remittance",),
}


def extension(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.lower(F.regexp_extract(c, r"(\.[^./]+)$", 1))


def pick_files(files: DataFrame, roles: dict[str, tuple[str, ...]] = ROLE_PATTERNS) -> DataFrame:
    """Per role the file of the first pattern that any name meets; of several, the last listed.

    ``files``: ``key``, listed in key order.
    """
    name = F.lower(F.element_at(F.split("key", "/"), -1))
    last = [F.max(F.when(name.rlike(p), F.col("key"))).alias(f"_{r}_{i}") for r, ps in enumerate(roles.values()) for i, p in enumerate(ps)]
    # one row per task, no groups: names are neither sorted nor dealt by role
    found = [F.struct(F.lit(role).alias("role"), F.coalesce(*[F.col(f"_{r}_{i}") for i in range(len(ps))]).alias("key")) for r, (role, ps) in enumerate(roles.items()) if ps]
    return files.agg(*last).select(F.explode(F.array(*found)).alias("f")).select("f.*").filter("key is not null")


def statement_id(key: Column) -> Column:
    """Id of a statement file: its key's whole digest, so that no two files meet at any number of files."""
    return F.concat(F.lit("OCI-"), F.sha1(key))


def plan_statements(files: DataFrame, prefix: str, accounts: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Outcome per bank CSV in the landing area: take, skipped, or an error with its reason."""
    rel = F.when(F.col("key").startswith(prefix), F.substring("key", F.lit(len(prefix) + 1), F.length("key"))).otherwise(F.col("key"))
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    f = files.filter(extension("key") == ".csv").select("key").distinct().withColumn("parts", parts)
    f = f.withColumns({"account_id": F.when(F.size("parts") >= 2, F.col("parts")[0]), "file_name": F.element_at("parts", -1), "statement_id": statement_id(F.col("key"))})
    held = accounts.select(F.col("id").alias("account_id"), F.col("currency").alias("account_currency"))
    seen = known_keys.select("key").distinct().withColumn("seen", F.lit(True))
    out = f.join(held, "account_id", "left").join(seen, "key", "left")
    problem = F.when(F.size("parts") < 2, F.lit(f"expected {prefix}<accountId>/<file>.csv")).when(
        F.col("account_currency").isNull(), F.concat(F.lit("unknown account '"), "account_id", F.lit("'")))
    outcome = F.when(F.col("seen"), "skipped").when(problem.isNotNull(), "error").otherwise("take")
    reason = F.when(F.col("seen"), "already ingested").otherwise(problem)
    return out.select("key", "statement_id", "account_id", "account_currency", "file_name", outcome.alias("outcome"), reason.alias("reason"))


def ingest_statements(spark: SparkSession, root: str, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statements, lines and errors of the files a plan takes; ``key`` is relative to ``root``. Other files' lines are dropped before they are numbered."""
    taken = plan.filter("outcome = 'take'")
    key = F.regexp_replace("file_path", r"^.*?" + root.strip("/").replace(".", r"\.") + "/", "")
    records = csv.csv_records(spark, root, only=taken.select("key"), key=key).withColumn("key", key).join(taken, "key")
    rows = csv.bank_rows(records, F.col("account_currency"))
    lines = csv.good(rows)
    rolled = lines.groupBy("statement_id").agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"), F.count(F.lit(1)).alias("transaction_count"))
    statements = taken.join(rolled, "statement_id").select(
        F.col("statement_id").alias("id"), "account_id", "file_name", F.lit("oci").alias("source"), "period_start", "period_end", "transaction_count", F.col("key").alias("storage_key"))
    open_rows = csv.open_quotes(spark, root, only=taken.select("key"), key=key).select(key.alias("key"), "error")
    first_bad = csv.bad(rows).groupBy("statement_id").agg(F.min_by("error", "data_index").alias("error"))
    empty = taken.join(rolled, "statement_id", "left_anti").join(first_bad, "statement_id", "left")
    errors = empty.select("key", F.coalesce("error", F.lit("no transactions parsed")).alias("error")).unionByName(
        plan.filter("outcome = 'error'").select("key", F.col("reason").alias("error"))).unionByName(open_rows)
    return statements, lines, errors


def content_hash(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def plan_documents(landing: DataFrame, known: DataFrame, keep_duplicates: bool) -> DataFrame:
    """New documents of a landing area.

    ``landing``: ``key, content_hash``; ``known``: ``doc_id, original_key, content_hash``.
    Known keys are left out. A repeated content is dropped, or with
    ``keep_duplicates`` gets its own row naming the document it repeats.
    """
    fresh = landing.join(known.select(F.col("original_key").alias("key")), "key", "left_anti")
    first_new = fresh.groupBy("content_hash").agg(F.min("key").alias("first_key"))
    first_known = known.groupBy("content_hash").agg(F.min("doc_id").alias("known_doc"))
    out = fresh.join(first_new, "content_hash").join(first_known, "content_hash", "left")
    repeats = F.coalesce("known_doc", F.when(F.col("key") != F.col("first_key"), F.col("first_key")))
    out = out.select("key", "content_hash", repeats.alias("duplicate_of"))
    return out if keep_duplicates else out.filter("duplicate_of is null").drop("duplicate_of")


def landing_listing(landing: DataFrame, known: DataFrame) -> DataFrame:
    docs = known.select(F.col("original_key").alias("key"), "doc_id")
    return landing.join(docs, "key", "left").select("key", "doc_id", F.col("doc_id").isNotNull().alias("processed"))


def without_samples(sample: DataFrame, real: DataFrame, gate: DataFrame) -> DataFrame:
    """Samples count only while ``gate`` (``has_real``, reduced to one row) says there is nothing real."""
    gate = gate.agg(F.coalesce(F.bool_or("has_real"), F.lit(False)).alias("has_real"))
    return sample.join(F.broadcast(gate.filter("not has_real")), how="left_semi", on=F.lit(True)).unionByName(real)
