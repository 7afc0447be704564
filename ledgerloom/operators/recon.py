"""Reconciliation: identify every bank line from its supporting documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import (
    AMOUNT_CLASS, HOT_REFERENCE_DOCS, LISTED_NAMES, amount_classes, bank_lines, crowded_classes, crowded_name_hits, distinct_names, documents, listed_name_hits, name_lists,
    of_classes, reference_hits,
)

AMOUNT_RULE = "exact amount"

RESULT_COLUMNS = (
    "transaction_id", "account_id", "date", "amount", "currency", "flow", "status", "matched_type", "matched_id",
    "confidence", "amount_diff", "match_pattern", "approach", "candidate_count",
)
HIT_COLUMNS = ("id_n", "po_n", "ref_n", "rem_n", "named_n", "com_n")


def amount_context(transactions: DataFrame, docs: DataFrame, listed_names: int = LISTED_NAMES) -> DataFrame:
    """Each bank line with what its exact amount and its party's name hit."""
    lines, names = bank_lines(transactions), distinct_names(docs)
    klass = list(AMOUNT_CLASS)
    classes = amount_classes(docs).withColumnRenamed("amount", "abs_amount").join(name_lists(names, listed_names), klass, "left")
    with_amounts = lines.join(classes, klass, "left")
    crowded = crowded_classes(names, listed_names)
    crowd = crowded_name_hits(bank_lines(of_classes(transactions, crowded)), names, listed_names, crowded)
    return (
        listed_name_hits(with_amounts, listed_names).join(crowd, "transaction_id", "left")
        .withColumns({"named_n": F.coalesce("crowd_n", "named_n"), "named_doc": F.coalesce("crowd_doc", "named_doc")})
        .drop("names", "crowd_n", "crowd_doc")
    )


def line_context(
    transactions: DataFrame, sales_orders: DataFrame, purchase_orders: DataFrame, remittances: DataFrame, hot_docs: int = HOT_REFERENCE_DOCS, listed_names: int = LISTED_NAMES,
) -> DataFrame:
    """Each bank line with its hit counts and the single documents behind them.

    ``hot_docs`` and ``listed_names`` choose between two plans with the same result; see :mod:`matching`.
    """
    docs = documents(sales_orders, purchase_orders, remittances)
    hits = reference_hits(bank_lines(transactions), docs, hot_docs)
    out = amount_context(transactions, docs, listed_names).join(hits, "transaction_id", "left")
    counts = [*HIT_COLUMNS, "id_equal_n", "po_equal_n", "ref_equal_n"]
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts})


def _verdict(status: str, kind: Column, doc: Column | None, confidence: float, pattern: str, approach: Column) -> Column:
    """Outcome of one rule, in one shape for all of them."""
    found = doc is not None
    return F.struct(
        F.lit(status).alias("status"),
        (kind if found else F.lit(None).cast("string")).alias("matched_type"),
        (doc["id"] if found else F.lit(None).cast("string")).alias("matched_id"),
        F.lit(confidence).alias("confidence"),
        (F.col("abs_amount") - doc["amount"] if found else F.lit(0).cast("bigint")).alias("amount_diff"),
        F.lit(pattern).alias("match_pattern"),
        approach.cast("string").alias("approach"),
    )


def decide(context: DataFrame) -> DataFrame:
    """Apply the lookup order; the first rule that isolates one document decides."""
    c = F.col
    kind = F.when(c("flow") == "O2C", "SO").otherwise("PO")
    rem = F.lit("remittance")
    total = c("abs_amount")
    several_refs = F.concat(F.lit("remittance invoice/payment ref → "), c("ref_n").cast("string"), F.lit(", unique amount among refs"))
    by_ref = F.lit("remittance invoice/payment ref → 1")
    by_amount = F.lit(f"remittance {AMOUNT_RULE} → 1 unique")
    by_name = F.lit(f"remittance {AMOUNT_RULE} + counterparty name in bank text → 1")
    id_text = F.concat(kind, F.lit(" id token → 1"))
    po_text = F.lit("PO/AP invoice or PO number → 1")
    same, differs = F.lit(" (amount match)"), F.lit(" (amount differs)")

    one_ref_equal = (c("ref_n") == 1) & (c("ref_equal_n") == 1)
    many_refs_one_equal = (c("ref_n") > 1) & (c("ref_equal_n") == 1)

    # Ways in which a remittance alone settles the line at its exact amount.
    settles = (
        (one_ref_equal, "ref_doc", 0.96, "remittance_invoice_ref", F.concat(by_ref, same)),
        (many_refs_one_equal, "ref_equal_doc", 0.90, "remittance_invoice_ref", several_refs),
        (c("rem_n") == 1, "rem_doc", 0.80, "remittance_amount_window", by_amount),
        (c("named_n") == 1, "named_doc", 0.85, "remittance_amount_name", by_name),
    )

    rules: list[tuple[Column, Column]] = []

    def commercial(is_hit: Column, doc: str, who: Column, confidence: float, pattern: str, text: Column) -> None:
        rules.append((is_hit & (c(doc)["amount"] == total), _verdict("matched", who, c(doc), confidence, pattern, F.concat(text, same))))
        for test, rem_doc, sure, rem_pattern, rem_text in settles:
            how = F.concat(text, differs, F.lit("; "), rem_text)
            rules.append((is_hit & test, _verdict("matched", rem, c(rem_doc), sure, rem_pattern, how)))
        rules.append((is_hit, _verdict("partial", who, c(doc), 0.60, pattern, F.concat(text, differs))))

    commercial(c("id_n") == 1, "id_doc", kind, 0.99, "so_po_id", id_text)
    commercial((c("flow") == "P2P") & (c("po_n") == 1), "po_doc", F.lit("PO"), 0.95, "po_invoice_number", po_text)
    for test, rem_doc, sure, rem_pattern, rem_text in settles:
        rules.append((test, _verdict("matched", rem, c(rem_doc), sure, rem_pattern, rem_text)))
        if rem_doc == "ref_doc":
            rules.append((c("ref_n") == 1, _verdict("partial", rem, c("ref_doc"), 0.65, rem_pattern, F.concat(by_ref, differs))))
    rules.append((
        c("com_n") == 1,
        _verdict("matched", kind, c("com_doc"), 0.70, "so_po_unique_amount", F.concat(kind, F.lit(" unique exact amount → 1 (no reference)"))),
    ))
    rules.append((candidates() > 0, _verdict("partial", kind, None, 0.30, "exhausted", attempts_text())))

    chain = None
    for test, outcome in rules:
        chain = F.when(test, outcome) if chain is None else chain.when(test, outcome)
    chain = chain.otherwise(_verdict("unmatched", kind, None, 0.0, "exhausted", attempts_text()))
    decided = context.withColumn("verdict", chain).select("*", "verdict.*").drop("verdict")
    exhausted = F.col("match_pattern") == "exhausted"
    return decided.withColumn("candidate_count", F.when(exhausted, candidates()).otherwise(F.lit(1)).cast("bigint"))


def candidates() -> Column:
    """Distinct documents on the table when no rule isolates one."""
    c = F.col
    # Hits at the line's own amount are already among the amount candidates.
    referenced = F.when(c("flow") == "O2C", c("id_n") - c("id_equal_n")).otherwise(c("po_n") - c("po_equal_n"))
    remittances = F.when(c("ref_n") > 0, c("ref_n")).when(c("named_n") == 1, F.lit(1)).otherwise(c("rem_n"))
    return c("com_n") + referenced + remittances


def attempt_list() -> Column:
    """Lookups tried on a line, in order, as ``array<struct<pattern, approach, hits>>``."""
    c = F.col
    kind = F.when(c("flow") == "O2C", "SO").otherwise("PO")

    def attempt(pattern: str, approach: Column, hits: str) -> Column:
        return F.struct(F.lit(pattern).alias("pattern"), approach.alias("approach"), c(hits).alias("hits"))

    po = F.when(c("flow") == "P2P", attempt("po_invoice_number", F.lit("PO/AP invoice or PO number"), "po_n"))
    return F.array_compact(F.array(
        attempt("so_po_id", F.concat(kind, F.lit(" id token")), "id_n"),
        po,
        attempt("remittance_invoice_ref", F.lit("remittance invoice/payment ref"), "ref_n"),
        attempt("remittance_amount_window", F.lit(f"remittance {AMOUNT_RULE}"), "rem_n"),
        attempt("remittance_amount_name", F.lit(f"remittance {AMOUNT_RULE} + counterparty name in bank text"), "named_n"),
        attempt("so_po_unique_amount", F.concat(kind, F.lit(" unique amount")), "com_n"),
    ))


def attempts_text() -> Column:
    numbered = F.transform(
        attempt_list(),
        lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a["approach"], F.lit(" → "), a["hits"].cast("string")),
    )
    return F.array_join(numbered, " · ")


def reconcile(transactions: DataFrame, sales_orders: DataFrame, purchase_orders: DataFrame, remittances: DataFrame) -> DataFrame:
    """One result row per bank line."""
    return decide(line_context(transactions, sales_orders, purchase_orders, remittances)).select(*RESULT_COLUMNS)


def summarise(results: DataFrame) -> DataFrame:
    """Counts per status and the value-weighted share of reconciled lines."""
    value = F.abs("amount")
    done = F.sum(F.when(F.col("status") != "unmatched", value))
    out = results.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "partial", "unmatched")],
        F.coalesce(F.sum(value), F.lit(0)).alias("all_value"), F.coalesce(done, F.lit(0)).alias("done_value"),
    )
    rate = F.when(F.col("all_value") == 0, F.lit(0.0)).otherwise(F.col("done_value") / F.col("all_value"))
    return out.withColumn("match_rate", rate).drop("all_value", "done_value")


def filter_results(results: DataFrame, status: str = "all", currency: str = "all") -> DataFrame:
    out = results if status == "all" else results.filter(F.col("status") == status)
    return out if currency == "all" else out.filter(F.col("currency") == currency)


def status_shares(results: DataFrame) -> DataFrame:
    """Share of lines per status."""
    from pyspark.sql import Window

    counts = results.groupBy("status").agg(F.count(F.lit(1)).alias("lines"))
    return counts.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy(F.lit(1))))
