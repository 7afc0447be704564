"""Small functions over the given tables, each against SQL written from its rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, dates, doc_names, doc_text, latin, money, text
from ..sources.adapters import Domain
from .catalog import Catalog

CATALOG = Catalog()
add = CATALOG.add


@add("H02_money_text", """SELECT o_orderkey AS id, format('{:,.2f}', CAST(round(o_totalprice * 100) AS DOUBLE) / 100) AS plain, '£' || format('{:,.2f}', CAST(round(o_totalprice * 100) AS DOUBLE) / 100) AS sterling,
  format('{:.1f}', (o_orderkey % 1000) / 7.0) || '%' AS percent FROM orders""")
def h02(d: Domain):
    cents = F.round(F.col("o_totalprice").cast("double") * 100).cast("bigint")
    share = (F.col("o_orderkey") % 1000).cast("double") / 700
    return d.orders.select(F.col("o_orderkey").alias("id"), money.format_cents_plain(cents).alias("plain"), money.format_currency(cents, F.lit("GBP")).alias("sterling"), money.format_percent(share).alias("percent"))


_AMOUNT = "CASE o_orderkey % 5 WHEN 0 THEN '-' WHEN 1 THEN ' ' WHEN 2 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '.50' WHEN 3 THEN '-' || CAST(o_orderkey % 90 AS STRING) || '.25' ELSE 'n/a' END"


@add("H04_uk_amount", f"SELECT id, CASE WHEN replace(trim(t), ',', '') IN ('', '-') THEN NULL ELSE CAST(round(try_cast(replace(t, ',', '') AS DOUBLE) * 100) AS BIGINT) END AS cents FROM (SELECT o_orderkey AS id, {_AMOUNT.replace('STRING', 'VARCHAR')} AS t FROM orders)")
def h04(d: Domain):
    return d.orders.select(F.col("o_orderkey").alias("id"), money.uk_amount(F.expr(_AMOUNT)).alias("cents"))


@add("H08_csv_date", """SELECT id, CASE WHEN k = 2 THEN NULL ELSE day END AS day FROM (SELECT o_orderkey AS id, o_orderkey % 3 AS k, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day FROM orders)""")
def h08(d: Domain):
    day = F.col("o_orderdate").cast("date")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "d/M/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    return d.orders.select(F.col("o_orderkey").alias("id"), dates.csv_date(shown).alias("day"))


@add("H09_uk_date", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day FROM orders")
def h09(d: Domain):
    day = F.col("o_orderdate").cast("date")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "d MMM yyyy"))
    return d.orders.select(F.col("o_orderkey").alias("id"), dates.uk_date(shown).alias("day"))


@add("H22_bank_narrative", "SELECT id, coalesce(nullif(trim(narrative), ''), trim(description), '') AS told FROM bank_transactions", ("bank_transactions",))
def h22(d: Domain):
    return d.bank_transactions.select("id", text.bank_narrative("narrative", "description").alias("told"))


@add("H48_address_parts", r"""SELECT id, CASE WHEN p <> '' THEN nullif(trim(regexp_replace(substr(a, 1, strpos(upper(a), upper(p)) - 1), '[/.,]+$', '')), '') ELSE a END AS street, nullif(trim(regexp_replace(p, '\s+', ' ', 'g')), '') AS postal_code,
  CASE WHEN p <> '' THEN nullif(trim(regexp_replace(substr(a, strpos(upper(a), upper(p)) + length(p)), '^[/,\s]+', '')), '') END AS city
FROM (SELECT id, a, coalesce(nullif(regexp_extract(a, '(?i)\b(\d{4}\s*[A-Z]{2})\b', 1), ''), nullif(regexp_extract(a, '\b(\d{5})\b', 1), ''), regexp_extract(a, '\b(\d{2}\s*\d{3})\b', 1)) AS p
  FROM (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name || ' / 1234 AB, Town ' || c_custkey WHEN 1 THEN c_name || ', 12 345 Place' WHEN 2 THEN 'Road 5, 54321' ELSE 'No code' END AS a FROM customer))""")
def h48(d: Domain):
    line = F.expr("CASE c_custkey % 4 WHEN 0 THEN c_name || ' / 1234 AB, Town ' || c_custkey WHEN 1 THEN c_name || ', 12 345 Place' WHEN 2 THEN 'Road 5, 54321' ELSE 'No code' END")
    return d.customer.select(F.col("c_custkey").alias("id"), address.split_registered(line).alias("a")).select("id", "a.*")


@add("H49_latin", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'OUzo ' WHEN 1 THEN 'Shttsyu ' ELSE 'Plain ' END || c_custkey AS latin, c_custkey % 3 <> 2 AS foreign_script FROM customer""")
def h49(d: Domain):
    name = F.concat(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'ΟΥζο ' WHEN 1 THEN 'Щцю ' ELSE 'Plain ' END"), F.col("c_custkey").cast("string"))
    return d.customer.select(F.col("c_custkey").alias("id"), latin.transliterate(name).alias("latin"), latin.has_non_latin(name).alias("foreign_script"))


@add("H54_document_names", """SELECT o_orderkey AS id, 'landing/Deal_' || o_orderkey || '.pdf' AS landing_key, 'processed/' || strftime(CAST(o_orderdate AS DATE), '%d-%m-%Y') || '/Deal_' || o_orderkey || '__x.pdf' AS object_key, o_orderkey AS title FROM orders""".replace("o_orderkey AS title", "CAST(o_orderkey AS VARCHAR) AS title"))
def h54(d: Domain):
    name = F.concat(F.lit("Deal/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    return d.orders.select(
        F.col("o_orderkey").alias("id"), doc_names.landing_key(F.lit(""), name).alias("landing_key"),
        doc_names.day_key(F.lit(""), "processed", name, F.col("o_orderdate").cast("date"), F.lit("x")).alias("object_key"), doc_names.display_title(name).alias("title"),
    )


@add("H55_keys_and_types", """SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS safe, CASE o_orderkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'application/octet-stream' END AS mime,
  CASE o_orderkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'xlsx' ELSE 'unsupported' END AS kind FROM orders""")
def h55(d: Domain):
    key = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'a/b.PDF' WHEN 1 THEN '/a.csv' WHEN 2 THEN 'a/../b.xlsm' ELSE 'a\\\\b.doc' END")
    return d.orders.select(F.col("o_orderkey").alias("id"), text.is_safe_key(key).alias("safe"), doc_names.mime_of(key).alias("mime"), doc_names.kind_of(key).alias("kind"))


@add("H58_prefixes", "SELECT o_orderkey AS id, 'root/' || CAST(o_orderkey AS VARCHAR) || '/' AS prefix FROM orders")
def h58(d: Domain):
    key = F.col("o_orderkey").cast("string")
    return d.orders.select(F.col("o_orderkey").alias("id"), text.join_prefix(F.lit("/root//"), F.lit("/"), F.concat(key, F.lit("/"))).alias("prefix"))


@add("H60_symbol_currency", "SELECT doc_id, CASE WHEN contains(text, '$') THEN 'AUD' WHEN contains(text, '£') THEN 'GBP' WHEN contains(text, '€') THEN 'EUR' END AS currency FROM documents")
def h60(d: Domain):
    return d.documents.select("doc_id", doc_text.currency_from_symbol("text").alias("currency"))
