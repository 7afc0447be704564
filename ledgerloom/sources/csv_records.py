"""CSV files as keyed records with their row numbers, and bank statements from them.

Files are read as splittable text. Row numbers come from per-block counts, so a
large file is numbered by many tasks; the only windows run inside one file block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import csv_date
from ..functions.money import csv_amount, strip

BLOCK = ["file_path", "block_start"]
# Fixed pattern: one CSV cell after its comma; quotes protect commas and line ends.
CELL = r',((?:"[^"]*+(?:"|$)|[^,"]++)*+)'

# Header spellings of bank files, in order of preference.
SYNONYMS = {
    "date": ("date", "posting date", "transaction date", "value date"),
    "description": ("description", "details", "narrative"),
    "reference": ("reference", "ref"),
    "counterparty": ("counterparty", "payee", "name"),
    "amount": ("amount", "value"),
    "debit": ("debit", "withdrawal", "paid out"),
    "credit": ("credit", "deposit", "paid in"),
    "currency": ("currency", "ccy"),
    "balance": ("balance", "running balance"),
}


def running_total(df: DataFrame, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` over a file's lines: inside the block, plus all earlier blocks."""
    inside = Window.partitionBy(*BLOCK).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*BLOCK).agg(F.sum(value).alias("_sum")).select(*BLOCK, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before"))
    summed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(blocks, BLOCK).withColumn(name, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw lines with the file they come from and a line order within each block."""
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(list(paths))
    return raw.select(
        F.regexp_replace("value", "\r", "").alias("line"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("_id"),
    )


def cells(record: Column) -> Column:
    """Cells of a row: a quote anywhere switches protection on or off, a doubled one inside stands for one."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(CELL))
    return F.transform(found, lambda c: strip(F.regexp_replace(F.regexp_replace(c, r'"((?:[^"]|"")*+)(?:"|$)', "$1"), '""', '"')))


def _numbered(spark: SparkSession, paths: tuple[str, ...], only: DataFrame | None, key: Column | None) -> DataFrame:
    """Lines with the row that each belongs to, whether it goes on a row, and whether its row never closes its quote."""
    lines = text_lines(spark, *paths)
    if only is not None:
        lines = lines.withColumn("key", key).join(only.distinct(), "key", "left_semi").drop("key")
    odd = F.length(F.regexp_replace("line", '[^"]', "")) % 2
    quoted = running_total(lines.withColumn("_odd", odd), F.col("_odd"), "_quotes", inclusive=False)
    quoted = quoted.withColumn("_goes_on", (F.col("_quotes") % 2).cast("int")).drop("_quotes")
    starts = running_total(quoted, 1 - F.col("_goes_on"), "row_number")
    open_rows = starts.groupBy("file_path").agg(F.sum("_odd").alias("_all"), F.max("row_number").alias("_last")).filter("_all % 2 = 1")
    starts = starts.join(open_rows.select("file_path", "_last"), "file_path", "left")
    return starts.withColumn("_open", F.coalesce(F.col("row_number") == F.col("_last"), F.lit(False))).drop("_last")


def open_quotes(spark: SparkSession, *paths: str, only: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """``file_path, row_number, error`` of rows that reach the end of their file inside quotes; :func:`csv_records` leaves them out."""
    starts = _numbered(spark, paths, only, key).filter("_open AND _goes_on = 0")
    return starts.select("file_path", F.col("row_number").cast("bigint"), F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(": a quote is not closed")).alias("error"))


def csv_records(spark: SparkSession, *paths: str, only: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """``file_path, row_number, data_index, record``: non-blank rows keyed by lower-case header.

    ``row_number`` is the physical row (header is 1, blank rows count); ``data_index`` counts the data rows kept.
    ``only`` (``key``) keeps the files whose ``key`` expression over ``file_path`` is listed there. A row whose quote is
    never closed would hold the rest of its file; it is left out, see :func:`open_quotes`.
    """
    starts = _numbered(spark, paths, only, key).filter("NOT _open")
    single = (F.col("_goes_on") == 0) & (F.col("_odd") == 0)
    rows = starts.filter(single).select(*BLOCK, "_id", "row_number", F.col("line").alias("text"))
    joined = (
        starts.filter(~single).groupBy("file_path", "row_number")
        .agg(F.array_sort(F.collect_list(F.struct("block_start", "_id", "line"))).alias("_parts"))
        .select("file_path", F.col("_parts")[0]["block_start"].alias("block_start"), F.col("_parts")[0]["_id"].alias("_id"), "row_number",
                F.array_join(F.transform("_parts", lambda p: p["line"]), "\n").alias("text"))
    )
    every = rows.unionByName(joined.select(*rows.columns))
    header = every.filter("row_number = 1").select("file_path", F.transform(cells(F.col("text")), lambda h: F.lower(strip(h))).alias("_header"))
    data = every.filter((F.col("row_number") > 1) & (strip("text") != ""))
    data = running_total(data.withColumn("_one", F.lit(1)), F.col("_one"), "data_index").withColumn("_cells", cells(F.col("text")))
    names = F.array_distinct("_header")
    at = lambda n: F.size("_header") - F.array_position(F.reverse("_header"), n).cast("int")
    record = F.map_from_arrays(names, F.transform(names, lambda n: F.coalesce(F.get("_cells", at(n)), F.lit(""))))
    return data.join(header, "file_path").select("file_path", F.col("row_number").cast("bigint"), F.col("data_index").cast("bigint"), record.alias("record"))


def _field(name: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at("record", F.lit(s)), F.lit("")) for s in SYNONYMS[name]])


def bank_rows(records: DataFrame, default_currency: Column | str = "USD") -> DataFrame:
    """Every data row of bank files with its canonical values and, where bad, an ``error``.

    ``records`` needs ``statement_id`` and ``account_id`` besides the CSV columns.
    A row without any amount counts as zero; debit and credit apply only where the
    amount cell is blank.
    """
    fallback = F.lit(default_currency) if isinstance(default_currency, str) else default_currency
    zero = F.lit(0).cast("bigint")
    side = lambda n: F.coalesce(F.abs(csv_amount(_field(n))), zero)
    raw_date, signed = _field("date"), _field("amount")
    out = records.select(
        "statement_id", "account_id", "data_index", F.concat(F.col("statement_id"), F.lit("-L"), F.col("data_index").cast("string")).alias("id"),
        raw_date.alias("_raw_date"), csv_date(raw_date).alias("date"),
        F.when(signed.isNotNull(), csv_amount(signed)).otherwise(side("credit") - side("debit")).alias("amount"),
        F.coalesce(_field("description"), F.lit("")).alias("description"), _field("reference").alias("reference"), _field("counterparty").alias("counterparty"),
        F.coalesce(_field("currency"), fallback).alias("currency"), csv_amount(_field("balance")).alias("balance_after"),
    )
    row = F.concat(F.lit("Row "), F.col("data_index").cast("string"))
    error = F.when(F.col("date").isNull(), F.concat(row, F.lit(': unparseable or missing date "'), F.coalesce("_raw_date", F.lit("")), F.lit('"'))).when(
        F.col("amount").isNull(), F.concat(row, F.lit(": unparseable amount")))
    return out.withColumn("error", error).drop("_raw_date")


def good(rows: DataFrame) -> DataFrame:
    return rows.filter("error is null").drop("error", "data_index")


def bad(rows: DataFrame) -> DataFrame:
    return rows.filter("error is not null").select("statement_id", "data_index", "error")
