"""Conflict-constrained best-fit packing.

Documents are cut into pieces no longer than a bin; pieces are dealt by hash to shards of bounded size, and each shard is
packed on its own, longest piece first. A shard's bins stand in order of what is left in them. A bin carries a bitmap of
the sources and one of the duplicate clusters that it holds; the search starts at the smallest bin that has room and
goes on to its successors until one has neither the piece's source nor its cluster: the tightest compatible bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .rows import text_or_empty, type_of

#: Room of a bin, in units of the length: by default bytes of UTF-8, the tokens of a byte-level model.
CAPACITY = 8192
#: Rows that a shard is meant to hold.
SHARD_ROWS = 4096
#: Share of a shard from which the rows of one id are dealt to all shards.
HEAVY = 16
#: Most rows of a broadcast list of ids; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000


class Bins:
    """Open bins in order of (room left, number)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, where in it the piece begins). `source` and `cluster` are single bits, or 0 where nothing can conflict."""
        at, order, sources, clusters = bisect_left(self.order, (length, -1)), self.order, self.sources, self.clusters
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = self.capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= source
        clusters[number] |= cluster
        if room > length:
            insort(order, (room - length, number))
        return number, self.capacity - room


def bits_of(values: list) -> list[int]:
    """A bit for each value that occurs more than once, 0 for others and for null: those conflict with nothing."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    bit: dict = {}
    for v, n in count.items():
        if n > 1 and v is not None:
            bit[v] = 1 << len(bit)
    return [bit.get(v, 0) for v in values]


def pack(
    df: DataFrame, capacity: int = CAPACITY, length: Column | None = None, cluster: Column | None = None, source_col: str = "source",
    id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, piece, piece_start, piece_length, bin_id, bin_start): where each piece of each document lies; nothing is left out.

    `length` is by default the text's bytes in UTF-8, `cluster` a hash of the text, so that copies share a cluster. A document
    longer than a bin gives full pieces, each a bin of its own, and a rest. In a bin no two pieces share a source or a cluster;
    null sources conflict with nothing. Texts of length 0 (null too) give one piece of length 0. Ties go by id. Repeated
    rows are packed each by itself, and as copies never share a bin. Null ids, and ids that repeat so often that they would fill a shard, are dealt by their row. An empty table gives an
    empty result; other columns are not read. A bin's number has its shard in the bits from 2^32 up.
    """
    if capacity < 1 or shard_rows < 1:
        raise ValueError("capacity and shard_rows are at least 1")
    text = text_or_empty(text_col)
    size = (F.octet_length(text) if length is None else length).cast("long")
    shards = -(-max(1, df.count()) // shard_rows)
    by_row = F.col(f"`{id_col}`").isNull()
    slim = df.select(
        F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").cast("string").alias("source"), (F.xxhash64(text) if cluster is None else cluster).cast("string").alias("cluster"),
        F.greatest(size, F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row"), by_row.alias("by_row"),
    )
    heavy = df.where(~by_row).groupBy(F.col(f"`{id_col}`").alias("doc")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, shard_rows // HEAVY))
    heavy = materialise(heavy.select("doc", F.lit(True).alias("heavy")))
    n_heavy = heavy.count()
    if n_heavy:
        slim = slim.join(F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy, "doc", "left").withColumn("by_row", F.col("by_row") | F.coalesce("heavy", F.lit(False)))
    salt = F.when(F.col("by_row"), F.col("row")).otherwise(F.lit(0))
    slim = slim.select(F.pmod(F.xxhash64("doc", salt), F.lit(shards)).alias("shard"), "doc", "source", "cluster", "size")

    def place(shard: pa.Table) -> pa.Table:
        number = shard.column("shard")[0].as_py()
        docs, sources, clusters, sizes = (shard.column(c).to_pylist() for c in ("doc", "source", "cluster", "size"))
        source_bits, cluster_bits = bits_of(sources), bits_of(clusters)
        order = sorted(range(len(docs)), key=lambda i: (-(sizes[i] % capacity), docs[i] is None, docs[i] if docs[i] is not None else 0, clusters[i] or "", sources[i] or ""))
        bins, out, full = Bins(capacity), [], 0
        for i in order:
            whole, rest = divmod(sizes[i], capacity)
            if rest or not whole:
                where, start = bins.put(rest, source_bits[i], cluster_bits[i])
                out.append((docs[i], whole, whole * capacity, rest, where, start))
        for i in order:  # full pieces after the shared bins, so that numbers follow each other
            for piece in range(sizes[i] // capacity):
                out.append((docs[i], piece, piece * capacity, capacity, len(bins.sources) + full, 0))
                full += 1
        columns = list(zip(*out))
        ids = pa.array(columns[0], shard.schema.field("doc").type)
        base = number << 32
        numbers = [pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3]), pa.array([base + b for b in columns[4]]), pa.array(columns[5])]
        return pa.table([ids, *(x.cast(pa.int64()) for x in numbers)], names=[id_col, "piece", "piece_start", "piece_length", "bin_id", "bin_start"])

    return slim.groupBy("shard").applyInArrow(
        place, f"`{id_col}` {type_of(df, id_col)}, piece bigint, piece_start bigint, piece_length bigint, bin_id bigint, bin_start bigint",
    )
