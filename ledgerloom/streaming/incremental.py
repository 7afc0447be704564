"""Incremental ingestion: landing folders as file streams with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cash import currency_positions, account_positions
from ..sources.landing import content_hash


# Schema of Spark's binary file source, which a stream has to be told.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a landing folder with their content hash."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("key"), content_hash("content").alias("content_hash"), F.decode("content", "utf-8").alias("text"))


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Process what has arrived, each file once over all runs that share ``checkpoint``."""
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_new(table: str, key: str, order: str = "key", shards: int = 64) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps one row per ``key`` across all batches: of one batch the first by ``order``.

    Rows go under the batch's own partition and the batch compares itself with the other partitions, so a batch that
    is run again overwrites its own output and ends in the same state. Inside a batch rows lie by a hash of the key
    in ``shards`` folders, and only the shards that the batch touches are read again.
    """
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*").withColumn("shard", shard)
        fields = [*batch.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("shard", T.IntegerType())]
        try:
            stored = spark.read.schema(T.StructType(fields)).parquet(table)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            touched = [r["shard"] for r in first.select("shard").distinct().collect()]  # at most ``shards`` numbers
            stored = stored.filter((F.col("batch_id") != batch_id) & F.col("shard").isin(touched))
            first = first.join(stored.select("shard", key), ["shard", key], "left_anti")
        first.write.mode("overwrite").partitionBy("shard").parquet(f"{table}/batch_id={batch_id}")

    return write


def refresh_positions(accounts: DataFrame, transactions: DataFrame, touched: DataFrame, target: str) -> None:
    """Recompute the positions of the currencies an ingest touched and overwrite only those partitions."""
    wanted = accounts.join(touched.select(F.col("account_id").alias("id")).distinct(), "id", "left_semi").select("currency").distinct()
    some = accounts.join(wanted, "currency", "left_semi")
    theirs = transactions.join(some.select(F.col("id").alias("account_id")), "account_id", "left_semi")
    positions = currency_positions(account_positions(some, theirs))
    positions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("currency").parquet(target)


def replay_batch(spark: SparkSession, root: str, accounts: DataFrame, table: str, keys: DataFrame, batch_id: int) -> None:
    """Statements of the given files, under the batch's own partition, and the positions of the currencies they touch.

    A batch that is run again overwrites its own output. Files that an earlier batch took are passed over.
    """
    from ..session import materialise
    from ..sources import landing

    try:
        earlier = spark.read.parquet(f"{table}/statements").where(F.col("batch_id") != batch_id).select(F.col("storage_key").alias("key"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        earlier = keys.where("false")
    plan = materialise(landing.plan_statements(keys, "", accounts, earlier).where("outcome <> 'skipped'"))
    statements, lines, errors = (materialise(df) for df in landing.ingest_statements(spark, root, plan))
    for name, df in (("statements", statements), ("bank_transactions", lines), ("ingest_errors", errors)):
        df.write.mode("overwrite").parquet(f"{table}/{name}/batch_id={batch_id}")
    stored = spark.read.parquet(f"{table}/bank_transactions").drop("batch_id")
    if "line_number" not in stored.columns:
        stored = stored.withColumn("line_number", F.lit(None).cast("bigint"))
    refresh_positions(accounts, stored, statements.select("account_id"), f"{table}/positions")


def ingest_statement_stream(spark: SparkSession, root: str, checkpoint: str, accounts: DataFrame, table: str) -> None:
    """Bank files ``<account>/<file>.csv`` that have arrived since the last run: lines, errors, and positions of touched currencies."""
    from ..sources.load_jobs import relative_key

    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(root)

    def batch(found: DataFrame, batch_id: int) -> None:
        replay_batch(spark, root, accounts, table, found.select(relative_key(root, F.col("path")).alias("key")), batch_id)

    run_available(files.select("path"), checkpoint, batch)
