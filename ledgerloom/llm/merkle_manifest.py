"""Merkle manifest of a table: leaf coordinates by bitmap rank, levels reduced by keyed slot arrays.

Ids of a group (a source) become bitmaps: words of 64 ids merged by OR inside map tasks, 16 words to a container, empty words left
out. A container keeps a popcount directory (rows before each word) and a directory over containers gives the rows before it. The
place of a leaf is then a rank query, directory + popcount of the lower bits of its word; leaves are never sorted. A level is reduced
by collecting at most FANOUT digests under (tree, node) and hashing them in the order of their slots.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import distributed_row_number
from ..session import materialise

FANOUT = 16
#: Bits of an id below its container's number: 16 words of 64.
CONTAINER_BITS = 10
#: The container of rows without an id: before any container a 64-bit id can have.
NO_ID = -(1 << 54)


def h(*digests: Column) -> Column:
    return F.sha2(F.concat(*digests), 256)


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def rows_before(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Sum of `value` over the earlier rows of the group, with no group in one task.

    Rows are dealt by range and written once, so a row's slice is fixed; slices are summed by themselves and shifted.
    """
    sliced = materialise(df.repartitionByRange(group, order).withColumn("_slice", F.spark_partition_id()))
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sliced.groupBy(group, "_slice").agg(F.sum(value).alias("_n")).select(group, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(group, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(shifts, [group, "_slice"]).withColumn(name, F.col("_local") + F.col("_shift")).drop("_slice", "_local", "_shift")


def containers(rows: DataFrame) -> DataFrame:
    """Compressed bitmaps of `_tree, _id` rows, one line per (tree, container).

    `present`: which of the 16 words hold an id; `words`: those words; `before`: rows of the container before each word; `extra`: bits of a word
    whose id stands in several rows, with the rows beyond the first; `base`: rows of the tree in earlier containers; `_cnt`: rows of the tree.
    """
    has = F.col("_id").isNotNull()
    ids = rows.groupBy("_tree", "_id").agg(F.count(F.lit(1)).alias("n")).select(
        "_tree", F.when(has, F.shiftright("_id", CONTAINER_BITS)).otherwise(F.lit(NO_ID)).alias("_high"),
        F.when(has, F.shiftright("_id", 6).bitwiseAND(F.lit(15))).otherwise(F.lit(0)).cast("int").alias("w"),
        F.when(has, F.col("_id").bitwiseAND(F.lit(63))).otherwise(F.lit(0)).cast("int").alias("b"), "n",
    )
    words = ids.groupBy("_tree", "_high", "w").agg(
        F.expr("bit_or(shiftleft(1L, b))").alias("bits"), F.sum("n").alias("n"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("b", (F.col("n") - 1).alias("more")))).alias("extra"),
    )
    held = words.groupBy("_tree", "_high").agg(
        F.array_sort(F.collect_list(F.struct("w", "bits", "n", "extra"))).alias("held"), F.sum("n").alias("n"), F.expr("bit_or(shiftleft(1, w))").alias("present"),
    )
    before = "transform(held, (x, i) -> aggregate(slice(held, 1, i), 0L, (s, y) -> s + y.n))"
    packed = held.select("_tree", "_high", "n", "present", F.col("held.bits").alias("words"), F.expr(before).alias("before"), F.col("held.extra").alias("extra"))
    sizes = packed.groupBy("_tree").agg(F.sum("n").alias("_cnt"))
    return rows_before(packed, "_tree", "_high", "n", "base").join(sizes, "_tree").drop("n")


def located(leaves: DataFrame) -> DataFrame:
    """`leaves` (`_tree, _id, _item, _digest`) with `_pos`, the 0-based place in the tree by id, and `_cnt`, the tree's leaves.

    Rows without an id come first; rows of one id follow each other by digest.
    """
    maps = containers(leaves.select("_tree", "_id"))
    has = F.col("_id").isNotNull()
    keyed = leaves.withColumn("_high", F.when(has, F.shiftright("_id", CONTAINER_BITS)).otherwise(F.lit(NO_ID)))
    below = lambda bits: F.expr(f"~shiftleft(-1L, {bits})")
    found = (
        keyed.join(maps, ["_tree", "_high"])
        .withColumn("_b", F.coalesce(F.col("_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int"))
        .withColumn("_w", F.coalesce(F.shiftright("_id", 6).bitwiseAND(F.lit(15)), F.lit(0)).cast("int"))
        .withColumn("_i", F.bit_count(F.col("present").cast("bigint").bitwiseAND(below("_w"))))
        .withColumn("_more", F.expr("extra[_i]"))
        .withColumn("_rank", F.expr("base + before[_i]") + F.bit_count(F.expr("words[_i]").bitwiseAND(below("_b"))) + F.expr("aggregate(filter(_more, x -> x.b < _b), 0L, (s, x) -> s + x.more)"))
        .select("_tree", "_id", "_item", "_digest", "_cnt", "_rank", F.expr("exists(_more, x -> x.b = _b)").alias("_again"), F.monotonically_increasing_id().alias("_salt"))
    )
    found = materialise(found)
    single = found.where(~F.col("_again")).withColumn("_pos", F.col("_rank"))
    # equal rows differ by the salt, so that an id with very many rows is cut into slices
    again = distributed_row_number(found.where("_again"), ["_tree", "_id"], ["_digest", "_salt"], "_nth").withColumn("_pos", F.col("_rank") + F.col("_nth") - 1).drop("_nth")
    return single.unionByName(again).select("_tree", "_pos", "_cnt", "_digest", "_item")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Levels of a forest from its leaves (`_tree, _pos, _cnt, _digest, _item`) up: runs of FANOUT nodes with their members and digest.

    A run is `_tree, _pos` (its place a level higher), `_cnt` (nodes of the tree below), `_run` (the digests in order), `_digest` and `members`
    (`slot`, `digest`, `item`). A node that is alone in its tree goes on unhashed; the last level has one run per tree.
    """
    levels: list[DataFrame] = []
    while True:
        member = F.struct((F.col("_pos") % FANOUT).cast("int").alias("slot"), F.col("_digest").alias("digest"), F.col("_item").alias("item"))
        runs = (
            nodes.withColumn("_m", member).groupBy("_tree", F.expr(f"_pos div {FANOUT}").alias("_pos"))
            .agg(F.collect_list("_m").alias("_m"), F.max("_cnt").alias("_cnt"))
            .withColumn("members", F.array_sort("_m", lambda x, y: x["slot"] - y["slot"]))
            .withColumn("_run", F.array_join("members.digest", ""))
            .withColumn("_digest", F.when(F.col("_cnt") > 1, F.sha2("_run", 256)).otherwise(F.col("_run")))
            .select("_tree", "_pos", "_cnt", "_run", "_digest", "members")
        )
        levels.append(materialise(runs))
        if (levels[-1].agg(F.max("_cnt")).first()[0] or 0) <= FANOUT:
            return levels
        nodes = levels[-1].select("_tree", "_pos", F.expr(f"(_cnt + {FANOUT - 1}) div {FANOUT}").alias("_cnt"), "_digest", F.lit(None).cast("string").alias("_item"))


def descend(levels: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """Leaves of a forest with the runs above them: `_tree, digest, item, path` and the other columns of `tops`.

    `tops` has a row per tree: `_tree, path` and what else belongs to the tree. `path` goes from the leaf to the root: the digests of
    the run and the own slot in it. Runs travel once for FANOUT nodes; a tree's row meets only the run at its top.
    """
    given = [c for c in tops.columns if c not in ("_tree", "path")]
    above = tops.withColumn("_pos", F.lit(0).cast("bigint"))
    for level in reversed(levels):
        met = level.join(above, ["_tree", "_pos"]).select(
            "_tree", (F.col("_pos") * FANOUT).alias("_start"), "_cnt", "_run", "path", *given, F.explode("members").alias("_m"),
        )
        step = F.when(F.col("_cnt") > 1, F.array(F.struct(F.col("_run").alias("run"), F.col("_m.slot").alias("slot")))).otherwise(F.expr("slice(path, 1, 0)"))
        out = met.select("_tree", (F.col("_start") + F.col("_m.slot")).alias("_pos"), F.concat(step, F.col("path")).alias("path"), *given, "_m.digest", "_m.item")
        above = out.drop("digest", "item")
    return out.drop("_pos")


PATH = "array<struct<run:string,slot:int>>"


def manifest(
    docs: DataFrame, value_cols: Sequence[str], id_col: str = "doc_id", group_col: str = "source", changed: Callable[[], dict[str, Column]] | None = None,
    is_changed: Column | None = None,
) -> DataFrame:
    """`id, leaf, subroot, root, path, changed_leaf`: one row per row of `docs`.

    A leaf hashes `value_cols`. Groups are trees over their leaves by ascending id, their subroots by ascending group (null first, bytewise) the
    leaves of the root's tree. `path` holds the runs and slots from the leaf to the root. With `changed` (columns by name) the leaf of those
    rows for which `is_changed` holds is also hashed with these values in place.
    Ids are integers. A null id comes before all others; rows of one id follow each other by leaf, equal rows are interchangeable and all
    count; a null group is a group of its own; null values have a mark of their own, so null and '' differ. An empty table gives no rows. Other
    columns are not read.
    """
    cell = lambda c: F.col(f"`{c}`")
    values = {c: cell(c) for c in value_cols}
    leaf = h(*(field(v) for v in values.values()))
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(is_changed, h(*(field(v) for v in {**values, **changed()}.values())))
    group = cell(group_col).cast("string")
    leaves = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("_tree"), cell(id_col).cast("bigint").alias("_id"),
        F.struct(cell(id_col).alias("id"), other.alias("changed_leaf")).alias("_item"), leaf.alias("_digest"),
    )
    levels = climb(located(leaves))
    subroots = levels[-1].select("_tree", "_digest")
    # groups may be many: they are numbered by ranges as well
    numbered = distributed_row_number(subroots, [], ["_tree"], "_nth")
    n = numbered.agg(F.count(F.lit(1)).alias("_cnt"))
    top_nodes = numbered.crossJoin(n).select(  # n is a single row
        F.lit("").alias("_tree"), (F.col("_nth") - 1).alias("_pos"), "_cnt", "_digest", F.col("_tree").alias("_item"),
    )
    top = climb(top_nodes)
    root = top[-1].select("_tree", F.col("_digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descend(top, root).select(F.col("item").alias("_tree"), F.col("digest").alias("subroot"), "root", "path")
    return descend(levels, tops).select(F.col("item.id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", "item.changed_leaf")


def proof(path: Column) -> Column:
    """Digests of the siblings, level by level from the leaf to the root, left to right."""
    return F.array_join(F.transform(path, lambda p: F.overlay(p["run"], F.lit(""), p["slot"] * 64 + 1, F.lit(64))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that `leaf` and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.overlay(p["run"], acc, p["slot"] * 64 + 1, F.lit(64)), 256))
