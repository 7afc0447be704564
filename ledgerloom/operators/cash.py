"""Cash position: opening and closing balances, flows and the daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import distributed_row_number


def chronological() -> Column:
    """Sort key, oldest first: listings are newest-first, so a larger line number is older."""
    return F.struct(F.col("date"), F.coalesce(-F.col("line_number"), F.lit(0)), F.col("id"))


def balance_aggregates() -> list[Column]:
    """Opening before the oldest line with a balance, and the newest reported balance."""
    known = F.col("balance_after").isNotNull()
    return [
        F.min_by(F.when(known, F.col("balance_after") - F.col("amount")), F.when(known, chronological())).alias("derived_opening"),
        F.max_by(F.when(known, F.col("balance_after")), F.when(known, chronological())).alias("reported_closing_balance"),
    ]


def _inflow() -> Column:
    return F.coalesce(F.sum(F.when(F.col("amount") > 0, F.col("amount"))), F.lit(0)).cast("bigint")


def _outflow() -> Column:
    return F.coalesce(F.sum(F.when(F.col("amount") < 0, -F.col("amount"))), F.lit(0)).cast("bigint")


def opening_balances(transactions: DataFrame) -> DataFrame:
    """Per account and currency: derived opening and reported closing, null without balances."""
    return transactions.groupBy("account_id", "currency").agg(*balance_aggregates())


def in_reporting_currency(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Lines whose currency is their account's currency."""
    held = accounts.select(F.col("id").alias("account_id"), "currency")
    return transactions.join(held, ["account_id", "currency"], "left_semi")


def account_positions(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per account; accounts without lines keep their stored opening."""
    key = ["account_id", "currency"]
    sums = transactions.groupBy(*key).agg(_inflow().alias("inflows"), _outflow().alias("outflows"), F.count(F.lit(1)).alias("transaction_count"))
    # apart from the sums, which need no sort: first and last of texts are found by sorting, and only lines with a balance count
    balances = transactions.filter("balance_after is not null").groupBy(*key).agg(*balance_aggregates())
    held = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"), "bank", "currency", "opening_balance")
    out = held.join(sums, key, "left").join(balances, key, "left")
    zero = F.lit(0).cast("bigint")
    out = out.withColumns({
        "opening_balance": F.coalesce("derived_opening", "opening_balance"),
        "inflows": F.coalesce("inflows", zero), "outflows": F.coalesce("outflows", zero),
        "transaction_count": F.coalesce("transaction_count", zero),
    })
    closing = F.col("opening_balance") + F.col("inflows") - F.col("outflows")
    return out.withColumn("closing_balance", closing).select(
        "account_id", "account_name", "bank", "currency", "opening_balance", "inflows", "outflows", "closing_balance",
        "transaction_count", "reported_closing_balance",
    )


def currency_positions(positions: DataFrame) -> DataFrame:
    total = lambda name: F.sum(name).cast("bigint")
    out = positions.groupBy("currency").agg(
        total("opening_balance").alias("opening_balance"), total("inflows").alias("total_inflows"),
        total("outflows").alias("total_outflows"), F.count(F.lit(1)).alias("account_count"),
    )
    net = F.col("total_inflows") - F.col("total_outflows")
    return out.withColumns({"net_cash_flow": net, "closing_balance": F.col("opening_balance") + net})


def daily_flows(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    return in_reporting_currency(accounts, transactions).groupBy("currency", "date").agg(
        _inflow().alias("inflow"), _outflow().alias("outflow")
    ).withColumn("net", F.col("inflow") - F.col("outflow"))


def daily_series(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Daily flows with the running balance; the window sees one row per day and currency."""
    opening = currency_positions(account_positions(accounts, transactions)).select("currency", F.col("opening_balance").alias("opening"))
    w = Window.partitionBy("currency").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        daily_flows(accounts, transactions).join(opening, "currency")
        .withColumn("running_balance", (F.col("opening") + F.sum("net").over(w)).cast("bigint"))
        .drop("opening")
    )


def close_check(positions: DataFrame) -> DataFrame:
    """Computed against reported closing, per account that reports one."""
    diff = F.col("closing_balance") - F.col("reported_closing_balance")
    return positions.select(
        "account_id", "currency", "closing_balance", "reported_closing_balance", diff.alias("difference"),
        F.when(diff.isNull(), "no_reported_balance").when(diff == 0, "agrees").otherwise("differs").alias("check"),
    )


def continuity(lines: DataFrame) -> DataFrame:
    """Lines whose balance is not the next (older) line's balance plus their own amount.

    ``lines`` needs ``statement_id, line_number, amount, balance_after``. The next line is the one with the next larger
    number that is there: rejected rows leave gaps. Lines are numbered without gaps and joined to their successors, so no
    statement has to fit one task.
    """
    slim = lines.select("statement_id", "line_number", "amount", "balance_after")
    numbered = distributed_row_number(slim, ["statement_id"], ["line_number"], "_at")
    older = numbered.select("statement_id", (F.col("_at") - 1).alias("_at"), F.col("balance_after").alias("older_balance"))
    expected = F.col("older_balance") + F.col("amount")
    return (
        numbered.join(older, ["statement_id", "_at"]).drop("_at")
        .filter("balance_after is not null and older_balance is not null")
        .filter(F.col("balance_after") != expected)
        .withColumn("expected_balance", expected)
    )


def ensure_accounts(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Accounts plus an "Unknown" one for every account id seen only on lines."""
    seen = transactions.groupBy("account_id").agg(F.min_by("currency", F.struct("date", "id")).alias("currency"))
    missing = seen.join(accounts.select(F.col("id").alias("account_id")), "account_id", "left_anti").select(
        F.col("account_id").alias("id"), F.col("account_id").alias("name"), F.lit("Unknown").alias("bank"), "currency",
        F.lit(0).cast("bigint").alias("opening_balance"),
    )
    return accounts.unionByName(missing, allowMissingColumns=True)


def order_currencies(df: DataFrame, reporting: str) -> DataFrame:
    """Distinct currencies, the reporting currency first."""
    first = F.when(F.col("currency") == reporting, 0).otherwise(1)
    return df.select("currency").distinct().select("currency", first.alias("group")).orderBy("group", "currency")


def statement_rollup(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("statement_id").agg(
        F.min("account_id").alias("account_id"), F.min("date").alias("period_start"), F.max("date").alias("period_end"),
        F.count(F.lit(1)).alias("transaction_count"),
    )


def attach_source(transactions: DataFrame, statements: DataFrame) -> DataFrame:
    """Bank file of a line: its own, else the base name of its statement's file."""
    from ..functions.text import base_name

    files = statements.select(F.col("id").alias("statement_id"), F.coalesce(base_name("file_name"), "file_name").alias("_file"))
    return transactions.join(files, "statement_id", "left").withColumn("source_file", F.coalesce(F.nullif("source_file", F.lit("")), "_file")).drop("_file")
