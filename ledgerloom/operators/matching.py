"""Lookups behind reconciliation: references, exact amounts and party names.

All three are equi-joins that attach at most a bounded number of rows to each
bank line. Documents are counted per key *before* a join, so a reference or an
amount shared by a large share of the documents costs one class row per line
instead of one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import block_keys, distinctive_words, loosely_match, normalise_party
from ..functions.text import is_distinctive_reference, join_filled, match_tokens, norm_keys
from ..session import drop_finished, materialise

TOKEN_FIELDS = ("reference", "description", "narrative", "customer_reference", "bank_reference", "counterparty")
PARTY_FIELDS = ("narrative", "description", "customer_reference", "counterparty", "bank_reference")

# References held by more documents than this are looked up through classes.
HOT_REFERENCE_DOCS = 32
# Hashes of such references go to every task up to this number (a few bytes each); more are joined by a shuffle.
BROADCAST_MARKS = 500_000
# References of lines are known to every task by bitmaps of 4 KB, this many at most; with very many tokens more documents pass them, never fewer.
MENTION_BITMAPS, BITMAP_BITS = 8192, 32768
# Names per amount class compared in place; classes with more go through blocking keys.
LISTED_NAMES = 16
AMOUNT_CLASS = ("flow", "currency", "abs_amount")


def _flow() -> Column:
    return F.when(F.col("amount") >= 0, "O2C").otherwise("P2P")


def bank_lines(transactions: DataFrame) -> DataFrame:
    """The columns matching needs, one row per bank line."""
    t = transactions
    return t.select(
        F.col("id").alias("transaction_id"), "account_id", "date", "amount", "currency",
        _flow().alias("flow"),
        F.abs("amount").alias("abs_amount"),
        match_tokens(*TOKEN_FIELDS).alias("tokens"),
        normalise_party(join_filled(*PARTY_FIELDS)).alias("party_text"),
    )


def doc_struct(kind: Column) -> Column:
    return F.struct(
        F.coalesce(F.col("source_row"), F.lit(0)).cast("bigint").alias("ordinal"), F.col("id").alias("id"),
        F.col("amount").alias("amount"), kind.alias("kind"),
    )


def documents(sales_orders: DataFrame, purchase_orders: DataFrame, remittances: DataFrame) -> DataFrame:
    """Supporting documents of all kinds with the references that can identify them.

    ``pool`` says which list a document belongs to: SO, PO or REM. ``flow`` is the
    direction of the bank lines it can support.
    """
    none, empty = F.array(F.lit(None).cast("string")), F.array().cast("array<string>")
    # a list without its nulls and repeats, no row of it looked at one by one
    listed = lambda numbers, *single: F.array_except(F.concat(F.coalesce(numbers, empty), F.array(*single)), none)
    so = sales_orders.select(
        F.lit("O2C").alias("flow"), F.lit("SO").alias("pool"), "currency", "amount", doc_struct(F.lit("SO")).alias("doc"), empty.alias("refs"), F.col("customer").alias("name"),
    )
    po = purchase_orders.select(
        F.lit("P2P").alias("flow"), F.lit("PO").alias("pool"), "currency", "amount", doc_struct(F.lit("PO")).alias("doc"),
        listed("po_numbers", F.nullif("invoice_number", F.lit("")), F.col("id")).alias("refs"), F.col("vendor").alias("name"),
    )
    rem = remittances.select(
        F.when(F.col("party") == "customer", "O2C").otherwise("P2P").alias("flow"), F.lit("REM").alias("pool"), "currency", "amount",
        doc_struct(F.lit("remittance")).alias("doc"),
        listed("invoice_numbers", *[F.when(is_distinctive_reference(c), F.col(c)) for c in ("remittance_number", "reference")]).alias("refs"),
        "name",
    )
    keyed = [d.withColumn("refs", F.array_distinct(norm_keys(F.col("refs")))) for d in (po, rem)]
    return so.unionByName(keyed[0]).unionByName(keyed[1])


def id_entries(docs: DataFrame) -> DataFrame:
    """Documents findable by their own id; the last of several with one id counts."""
    commercial = docs.filter(F.col("pool").isin("SO", "PO"))
    return (
        commercial.groupBy("flow", F.upper("doc.id").alias("ref"))
        .agg(F.max_by(F.struct("currency", "doc"), F.col("doc.ordinal")).alias("last"))
        .select("flow", F.lit("ID").alias("pool"), F.col("last.currency").alias("currency"), "ref", F.col("last.doc").alias("doc"))
    )


ANY_AMOUNT = -1


def few(found: DataFrame) -> DataFrame:
    """``found``, a table read from its checkpoint, sent to every task while its rows are few."""
    return F.broadcast(found) if found.count() <= BROADCAST_MARKS else found


def _place(mark: Column) -> list[Column]:
    """Where a 64-bit hash stands in the bitmaps: number of the bitmap and of the bit in it."""
    return [F.pmod(mark, F.lit(MENTION_BITMAPS)).alias("bitmap"), F.shiftrightunsigned(mark, 40).bitwiseAND(BITMAP_BITS - 1).alias("bit")]


def bitmaps(marks: DataFrame) -> DataFrame:
    """``(bitmap, words)``: at most ``MENTION_BITMAPS`` bitmaps, as words of 64 bits, with a bit set for every ``mark``, a 64-bit hash."""
    # dealt before they are set: a bitmap per task and number would be most of it empty
    told = marks.select(*_place(F.col("mark"))).repartition("bitmap").groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
    words = F.expr("transform(sequence(0, CAST(length(bits) DIV 8 AS INT) - 1), i -> CAST(conv(hex(substring(bits, i * 8 + 1, 8)), 16, -10) AS BIGINT))")
    return materialise(told.select("bitmap", words.alias("words")))


def where_set(df: DataFrame, mark: Column, said: DataFrame, is_set: bool = True) -> DataFrame:
    """The rows of ``df`` whose bit is set in the `bitmaps`, or those where it is not. None that was marked has it not set; some others have it set."""
    bitmap, bit = _place(mark)
    # the first byte of a word is its highest
    found = F.expr("shiftright(get(words, CAST(shiftright(_bit, 6) AS INT)), CAST(56 - (_bit & 56) + (_bit & 7) AS INT)) & 1 = 1")
    met = df.withColumn("_bitmap", bitmap).withColumn("_bit", bit)
    return met.join(F.broadcast(said), (F.col("_bitmap") == F.col("bitmap")) & found, "left_semi" if is_set else "left_anti").drop("_bitmap", "_bit")


def mentions(lines: DataFrame) -> DataFrame:
    """The `bitmaps` of all tokens of the lines."""
    return bitmaps(lines.select("flow", F.explode_outer("tokens").alias("token")).filter("token is not null").select(F.xxhash64("flow", "token").alias("mark")))


def mentioned(refs: DataFrame, said: DataFrame) -> DataFrame:
    """The rows of ``refs`` (flow, ref, ...) whose bit is set. No reference of a line is lost; some others stay."""
    return where_set(refs, F.xxhash64("flow", "ref"), said)


def _live(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """A row per document and reference or id that lines may hold; the others meet no line and are left before any shuffle.

    ``is_ref`` and ``is_id`` say what the text is to its document, ``row`` and ``id_mark`` tell rows and ids of documents apart.
    """
    own_id, commercial = F.upper("doc.id"), F.col("pool").isin("SO", "PO")
    # explode_outer: before explode, lists would be worked out once more to leave rows with an empty one
    known = docs.withColumns({
        "row": F.monotonically_increasing_id(), "id_mark": F.xxhash64("flow", F.col("pool") == "REM", own_id),
        "refs": F.coalesce("refs", F.array().cast("array<string>")), "own_id": F.when(commercial, own_id),
    })
    every = known.withColumn("ref", F.explode_outer(F.array_distinct(F.concat("refs", F.array("own_id"))))).filter("ref is not null")
    return mentioned(every, mentions(lines)).withColumns({
        "is_ref": F.array_contains("refs", F.col("ref")), "is_id": F.coalesce(F.col("ref") == F.col("own_id"), F.lit(False)),
    }).withColumn("mark", F.when(F.col("is_ref"), F.hash("flow", "currency", "ref")))


def _marks(live: DataFrame, hot_docs: int) -> tuple[DataFrame, DataFrame]:
    """``(id_mark, repeated)`` of ids that several documents have and ``(mark, is_hot)`` of references that more than ``hot_docs`` hold, from one pass.

    A document with a repeated id that is there several times counts several times as a holder: a reference may then be taken as hot though few hold it.
    """
    told = F.explode(F.array(F.struct(F.lit(True).alias("of_id"), F.col("id_mark").alias("mark"), "row"), F.struct(F.lit(False).alias("of_id"), F.col("mark").cast("bigint").alias("mark"), "row")))
    held = live.select(told.alias("t")).select("t.*").filter("mark is not null").groupBy("of_id", "mark").agg(F.count(F.lit(1)).alias("held"), F.min("row").alias("first"), F.max("row").alias("last"))
    found = materialise(held.filter((F.col("of_id") & (F.col("first") != F.col("last"))) | (~F.col("of_id") & (F.col("held") > hot_docs))).select("of_id", "mark"))
    repeated = few(found.filter("of_id").select(F.col("mark").alias("id_mark"), F.lit(True).alias("repeated")))
    return repeated, few(found.filter("not of_id").select(F.col("mark").cast("int").alias("mark"), F.lit(True).alias("is_hot")))


def _entries(live: DataFrame, repeated: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(direct, by_id, in_class)``: rows met one by one, the documents found by an id they share, and the rows of hot references.

    Documents that share an id with others are few, and only they are grouped: equal ones put their references together, and the
    last of an id is found by it. They and the rows of hot references are written once.
    """
    key = ["flow", "pool", "currency", "doc"]
    told = live.join(repeated, "id_mark", "left").join(hot, "mark", "left").withColumn("in_class", F.col("is_ref") & F.col("is_hot").isNotNull())
    columns = [*key, "refs", "ref", "mark", "is_ref", "is_id", "in_class"]
    apart = materialise(told.filter("repeated or in_class").select(*columns, "repeated"))
    single = told.filter("repeated is null and (not in_class or is_id)").select(*columns)
    several = apart.filter("repeated")
    merged = several.filter("is_ref").groupBy(*key).agg(F.collect_set("ref").alias("refs"))
    of_several = merged.select(*key, "refs", F.explode("refs").alias("ref")).withColumn("mark", F.hash("flow", "currency", "ref")).join(hot, "mark", "left").select(
        *key, "refs", "ref", "mark", F.lit(True).alias("is_ref"), F.lit(False).alias("is_id"), F.col("is_hot").isNotNull().alias("in_class"))
    in_class = apart.filter("repeated is null and in_class").select(*columns).unionByName(of_several.filter("in_class"))
    return single.unionByName(of_several.filter("not in_class")), id_entries(several.filter("is_id")), in_class


def reference_hits(lines: DataFrame, docs: DataFrame, hot_docs: int = HOT_REFERENCE_DOCS) -> DataFrame:
    """Per line: how many documents its tokens hit in each pool, and which when it is one.

    For ``x`` in id, po, ref the columns are ``x_n``, ``x_doc`` (first hit),
    ``x_equal_n`` and ``x_equal_doc`` (hits at exactly the line's amount).

    References held by few documents join directly. The others ("hot") are
    grouped: documents with the same set of hot references form one class with a
    count, kept once for any amount and once per amount, and a line meets a class
    once, through the smallest token they share. A document reached both ways is
    counted only in its class.

    Which references are hot is kept as hashes, counted once: two that share a hash
    may both be taken as hot, which changes the way to a result, never the result.
    A document meets a line with the references it holds, so none is put together
    again from its references but the few with hot ones. References that stand on no
    line are left where they are read.
    """
    key = ["flow", "currency", "ref"]
    live = _live(docs, lines)
    repeated, hot = _marks(live, hot_docs)
    found, by_id, in_class = _entries(live, repeated, hot)
    drop_finished(lines.sparkSession)  # the marks and bitmaps are written, what they were made by is not read again
    by_doc = ["flow", "pool", "currency", "doc"]
    hot_by_doc = in_class.groupBy(*by_doc).agg(F.sort_array(F.collect_set("ref")).alias("hot_refs"))
    one, any_amount = F.lit(1).cast("bigint").alias("n"), F.lit(ANY_AMOUNT).cast("bigint").alias("at")
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("array<string>")
    # by a reference that few hold, or one by one by an id, whether it is a hot reference as well or none
    cold = F.col("is_ref") & ~F.col("in_class")
    direct = found.filter(cold | F.col("is_id")).select(
        *key, any_amount, F.when(cold, F.col("pool")).otherwise("ID").alias("pool"), "doc", one, F.when(cold & (F.size("refs") > 1), F.col("refs")).alias("held"), "is_id", no.alias("is_class"))
    ids = by_id.select(*key, any_amount, "pool", "doc", one, none.alias("held"), yes.alias("is_id"), no.alias("is_class"))
    # counted in one pass for any amount and per amount; a line's own amount is never negative
    at = F.when(F.col("doc.amount") >= 0, F.array(F.lit(ANY_AMOUNT).cast("bigint"), F.col("doc.amount"))).otherwise(F.array(F.lit(ANY_AMOUNT).cast("bigint")))
    counted = hot_by_doc.withColumn("at", F.explode(at)).groupBy("flow", "pool", "currency", "hot_refs", "at").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
    classes = (
        counted
        .withColumn("ref", F.explode("hot_refs"))
        .select(*key, "at", "pool", "doc", "n", F.col("hot_refs").alias("held"), no.alias("is_id"), yes.alias("is_class"))
    )
    entries = direct.unionByName(ids).unionByName(classes)

    # Only tokens that may be hot look for classes, which are kept per amount as well.
    any_or_own = F.when(F.col("is_hot"), F.array(any_amount, F.col("abs_amount"))).otherwise(F.array(any_amount))
    probe = (
        lines.select("transaction_id", "flow", "currency", "abs_amount", F.when(F.size("tokens") > 1, F.col("tokens")).alias("tokens"), F.explode_outer("tokens").alias("ref"))
        .filter("ref is not null")
        .withColumn("mark", F.hash(*key)).join(hot, "mark", "left")
        .withColumn("at", F.explode(any_or_own)).drop("mark", "is_hot")
    )
    shared = F.array_intersect("held", F.coalesce("tokens", F.array("ref")))
    meets = ~F.col("is_class") | (F.array_min(shared) == F.col("ref"))
    met = probe.join(entries, [*key, "at"]).filter(meets).withColumn("shared", F.when(~F.col("is_class"), shared))

    is_class, at_line = F.col("is_class"), F.col("at") != ANY_AMOUNT
    # A document reached through several tokens counts once, hence the set.
    gathered = [
        F.collect_set(F.when(~is_class, F.struct("pool", "doc", "shared", "is_id"))).alias("listed"),
        F.collect_set(F.when(is_class, F.col("ref"))).alias("through"), F.first("abs_amount").alias("line_amount"),
    ]
    for pool in ("PO", "REM"):
        of_pool = is_class & (F.col("pool") == pool)
        for name, test in ((f"{pool}_any", of_pool & ~at_line), (f"{pool}_at", of_pool & at_line)):
            gathered += [F.sum(F.when(test, F.col("n"))).alias(f"{name}_n"), F.min(F.when(test, F.col("doc"))).alias(f"{name}_doc")]
    per_line = met.groupBy("transaction_id").agg(*gathered)
    not_in_class = F.filter("listed", lambda h: (h["pool"] != "ID") & ~F.coalesce(F.arrays_overlap(h["shared"], F.col("through")), F.lit(False)))
    by_ids = F.transform(F.filter("listed", lambda h: h["is_id"]), lambda h: F.struct(F.lit("ID").alias("pool"), h["doc"].alias("doc")))
    by_refs = F.transform(not_in_class, lambda h: F.struct(h["pool"].alias("pool"), h["doc"].alias("doc")))
    per_line = per_line.withColumn("direct", F.array_distinct(F.concat(by_ids, by_refs)))

    out = [F.col("transaction_id")]
    zero = F.lit(0).cast("bigint")
    for pool, name in (("ID", "id"), ("PO", "po"), ("REM", "ref")):
        own = F.transform(F.filter("direct", lambda h: h["pool"] == pool), lambda h: h["doc"])
        equal = F.filter(own, lambda d: d["amount"] == F.col("line_amount"))
        for label, docs_of, suffix in (("", own, "any"), ("_equal", equal, "at")):
            n, doc = F.size(docs_of).cast("bigint"), F.array_min(docs_of)
            if pool != "ID":
                n = n + F.coalesce(F.col(f"{pool}_{suffix}_n"), zero)
                doc = F.least(doc, F.col(f"{pool}_{suffix}_doc"))
            out += [n.alias(f"{name}{label}_n"), doc.alias(f"{name}{label}_doc")]
    return per_line.select(*out)


def amount_classes(docs: DataFrame) -> DataFrame:
    """One row per (flow, currency, amount): counts and first document, per side."""
    is_rem = F.col("pool") == "REM"
    return docs.groupBy("flow", "currency", "amount").agg(
        F.count_if(is_rem).alias("rem_n"), F.min(F.when(is_rem, F.col("doc"))).alias("rem_doc"),
        F.count_if(~is_rem).alias("com_n"), F.min(F.when(~is_rem, F.col("doc"))).alias("com_doc"),
    )


def distinct_names(docs: DataFrame) -> DataFrame:
    """Distinct normalised remittance names per exact amount, with counts."""
    return (
        docs.filter("pool = 'REM'")
        .select("flow", "currency", F.col("amount").alias("abs_amount"), normalise_party("name").alias("norm_name"), "doc")
        .filter("norm_name != ''")
        .groupBy(*AMOUNT_CLASS, "norm_name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
    )


def name_lists(names: DataFrame, listed: int = LISTED_NAMES) -> DataFrame:
    """Per amount class the names as an array; one element more than the limit marks a crowded class."""
    value = F.struct("norm_name", "n", "doc")
    return first_k(names, list(AMOUNT_CLASS), [F.col("norm_name")], value, listed + 1, "names")


def listed_name_hits(context: DataFrame, listed: int = LISTED_NAMES) -> DataFrame:
    """Adds ``named_n`` and ``named_doc`` where the class lists all its names."""
    text_words = F.when(F.size("names").between(1, listed), distinctive_words(F.col("party_text")))
    fits = F.filter("names", lambda m: loosely_match(m["norm_name"], F.col("party_text"), F.col("_text_words")))
    return (
        context.withColumn("_text_words", text_words)
        .withColumn("_fits", F.when(F.col("_text_words").isNotNull(), fits))
        .withColumn("named_n", F.aggregate("_fits", F.lit(0).cast("bigint"), lambda acc, m: acc + m["n"]))
        .withColumn("named_doc", F.array_min(F.transform("_fits", lambda m: m["doc"])))
        .drop("_text_words", "_fits")
    )


def crowded_pairs(context: DataFrame, names: DataFrame, listed: int = LISTED_NAMES) -> DataFrame:
    """``(transaction_id, norm_name, party_text, n, doc)`` of lines and names in crowded classes that share a blocking key."""
    lines = context.filter((F.size("names") > listed) & (F.col("party_text") != "")).select("transaction_id", *AMOUNT_CLASS, "party_text")
    return _keyed_pairs(lines, names, ["transaction_id"], crowded_classes(names, listed))


def crowded_classes(names: DataFrame, listed: int = LISTED_NAMES) -> DataFrame:
    """Amount classes with more names than are listed, sent to every task while they are few."""
    return few(materialise(names.groupBy(*AMOUNT_CLASS).agg(F.count(F.lit(1)).alias("_names")).filter(F.col("_names") > listed).drop("_names")))


def of_classes(transactions: DataFrame, classes: DataFrame) -> DataFrame:
    """The transactions of some amount classes, before any text of theirs is worked on."""
    flow, size = _flow(), F.abs("amount")
    told = classes.select(F.col("flow").alias("_flow"), F.col("currency").alias("_currency"), F.col("abs_amount").alias("_abs_amount"))
    return transactions.join(told, (flow == F.col("_flow")) & (F.col("currency") == F.col("_currency")) & (size == F.col("_abs_amount")), "left_semi")


def _keyed_pairs(texts: DataFrame, names: DataFrame, ids: list[str], crowded: DataFrame) -> DataFrame:
    """Texts (one per ``ids``) and names of their crowded class that share a blocking key."""
    probe = texts.withColumn("key", F.explode(block_keys(F.col("party_text"), False)))
    keyed = names.join(crowded, list(AMOUNT_CLASS), "left_semi").withColumn("key", F.explode(block_keys(F.col("norm_name"), True)))
    rest = [F.first(c).alias(c) for c in ("party_text", "n", "doc") if c not in ids]
    return probe.join(keyed, [*AMOUNT_CLASS, "key"]).groupBy(*ids, "norm_name").agg(*rest)


def crowded_name_hits(lines: DataFrame, names: DataFrame, listed: int = LISTED_NAMES, crowded: DataFrame | None = None) -> DataFrame:
    """Name hits for lines in classes with many names: only pairs that share a blocking key meet, and equal texts of a class are compared once.

    ``crowded`` are the classes if they are known already. An empty text has no key and meets nothing.
    """
    text = [*AMOUNT_CLASS, "party_text"]
    crowded = crowded_classes(names, listed) if crowded is None else crowded
    # as a generated column, so that no test of the text is put before the join and every line's text is worked out for it
    told = lines.join(crowded, list(AMOUNT_CLASS), "left_semi").select("transaction_id", *AMOUNT_CLASS, F.explode(F.array("party_text")).alias("party_text"))
    fitting = _keyed_pairs(told.select(*text).distinct(), names, text, crowded).filter(loosely_match(F.col("norm_name"), F.col("party_text")))
    hits = fitting.groupBy(*text).agg(F.sum("n").alias("crowd_n"), F.min("doc").alias("crowd_doc"))
    return told.join(hits, text).groupBy("transaction_id").agg(F.max("crowd_n").alias("crowd_n"), F.min("crowd_doc").alias("crowd_doc"))


def first_k(df: DataFrame, keys: list[str], order: list[Column], value: Column, k: int, name: str) -> DataFrame:
    """First ``k`` values per key as an array; rows beyond ``k`` are dropped before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    packed = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", value.alias("v")))).alias("_vs"))
    return packed.select(*keys, F.transform("_vs", lambda s: s["v"]).alias(name))
