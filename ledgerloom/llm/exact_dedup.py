"""Exact dedup over a sharded cuckoo-filter index of live digests.

Digests and copy counts are combined before the shuffle, then dealt to shards by digest. A shard's index answers most
new digests from its fingerprints alone; a hit is verified against the full digests stored in the bucket. A full bucket
table is doubled and filled again from the stored keys. Digests can be taken out again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import text_or_empty, type_of

#: Most digests that a shard is meant to hold; more rows give more shards.
SHARD_ROWS = 200_000


class CuckooIndex:
    """Live digests with a value each. Two candidate buckets of four slots; a slot has a fingerprint and the full digest."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        if buckets < 2 or buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.values: dict[bytes, list] = {}
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.keys: list[list[bytes]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def find(self, digest: bytes) -> list | None:
        """The digest's value, or None; a fingerprint that only looks like it is refused by the stored digest."""
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if mark in self.prints[bucket] and digest in self.keys[bucket]:
                return self.values[digest]
        return None

    def insert(self, digest: bytes, value: list) -> None:
        """Add a digest that is not there."""
        self.values[digest] = value
        if not self._place(digest):
            self._grow()

    def _place(self, digest: bytes) -> bool:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if len(self.prints[bucket]) < self.SLOTS:
                self.prints[bucket].append(mark)
                self.keys[bucket].append(digest)
                return True
        bucket = first
        for kick in range(self.KICKS):  # push out one slot after another, in turn
            slot = kick % self.SLOTS
            self.prints[bucket][slot], mark = mark, self.prints[bucket][slot]
            self.keys[bucket][slot], digest = digest, self.keys[bucket][slot]
            bucket = self._other(bucket, mark)
            if len(self.prints[bucket]) < self.SLOTS:
                self.prints[bucket].append(mark)
                self.keys[bucket].append(digest)
                return True
        return False

    def _grow(self) -> None:
        """Double the buckets until all live digests have a place."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._empty(buckets)
            if all(map(self._place, self.values)):
                return

    def delete(self, digest: bytes) -> bool:
        """Take a digest out; False where it is not live."""
        if self.find(digest) is None:
            return False
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            if digest in self.keys[bucket]:
                slot = self.keys[bucket].index(digest)
                del self.keys[bucket][slot], self.prints[bucket][slot]
                break
        del self.values[digest]
        return True

    def __len__(self) -> int:
        return len(self.values)


def _digest(text_col: str):
    return F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))


def _shards(df: DataFrame) -> int:
    return -(-max(1, df.count()) // SHARD_ROWS)


def digest_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, keep_id, group_size): one row for each different whole text, null as ''; keep_id is the largest non-null id.

    Copies are combined in each map task and once more for each of eight salts, so a text that fills a third of the table
    reaches the index as at most eight rows.
    """
    kind, shards = type_of(df, id_col), _shards(df)
    combined = (
        df.select(F.col(f"`{id_col}`").alias("doc"), _digest(text_col).alias("digest"))
        .withColumn("salt", F.spark_partition_id() % 8)
        .groupBy("digest", "salt")
        .agg(F.max("doc").alias("doc"), F.count(F.lit(1)).alias("n"))
        .select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest", "doc", "n")
    )

    def index(shard: pa.Table) -> pa.Table:
        live = CuckooIndex()
        for digest, doc, n in zip(*(shard.column(c).to_pylist() for c in ("digest", "doc", "n"))):
            entry = live.find(digest)
            if entry is None:
                live.insert(digest, [doc, n])
            else:
                entry[0] = doc if entry[0] is None or doc is not None and doc > entry[0] else entry[0]
                entry[1] += n
        ids = pa.array([v[0] for v in live.values.values()], shard.schema.field("doc").type)
        return pa.table({"digest": pa.array(live.values, pa.binary()), "keep_id": ids, "group_size": pa.array([v[1] for v in live.values.values()], pa.int64())})

    return combined.groupBy("shard").applyInArrow(index, f"digest binary, keep_id {kind}, group_size bigint")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each row of `df`.

    Texts are equal when identical; null counts as ''. Of equal texts the row with the largest id stays. Null ids never
    win over others; among rows that share text and largest id (repeated rows, or only null ids) all are marked kept:
    they are one document. An empty table gives an empty result; other columns are not read.
    """
    texts = df.select(F.col(f"`{id_col}`"), _digest(text_col).alias("digest"))
    found = texts.join(digest_groups(df, id_col, text_col), "digest")
    return found.select(
        id_col, "keep_id", "group_size", F.col(f"`{id_col}`").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns as they are, that exact dedup keeps, each (id, text) once."""
    digest, keep = "__digest", "__keep"
    groups = digest_groups(df, id_col, text_col).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    kept = df.withColumn(digest, _digest(text_col)).join(groups, digest).where(F.col(f"`{id_col}`").eqNullSafe(F.col(keep)))
    return kept.dropDuplicates([digest, id_col]).select(*(F.col(f"`{c}`") for c in df.columns))


def live_digests(changes: DataFrame, change_col: str = "change", text_col: str = "text") -> DataFrame:
    """(text_sha256, copies) of the texts that are live after all changes: +1 for a row that comes, -1 for one that goes.

    The rows of one digest are summed before the shuffle on each side; a shard puts in what came, then takes out what went. A
    text that goes more often than it came is not live. A null change counts as 0.
    """
    step = F.coalesce(F.col(f"`{change_col}`").cast("long"), F.lit(0))
    summed = (
        changes.select(_digest(text_col).alias("digest"), step.alias("step"))
        .groupBy("digest")
        .agg(F.sum(F.when(F.col("step") > 0, F.col("step")).otherwise(0)).alias("came"), F.sum(F.when(F.col("step") < 0, -F.col("step")).otherwise(0)).alias("went"))
        .withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(_shards(changes))).cast("int"))
    )

    def index(shard: pa.Table) -> pa.Table:
        live, columns = CuckooIndex(), [shard.column(c).to_pylist() for c in ("digest", "came", "went")]
        for digest, came, _ in zip(*columns):
            if came:
                live.insert(digest, [came])
        for digest, _, went in zip(*columns):
            if went and (entry := live.find(digest)) is not None:
                entry[0] -= went
                if entry[0] <= 0:
                    live.delete(digest)
        return pa.table({"text_sha256": pa.array([d.hex() for d in live.values], pa.string()), "copies": pa.array([v[0] for v in live.values.values()], pa.int64())})

    return summed.groupBy("shard").applyInArrow(index, "text_sha256 string, copies bigint")
