"""Shared plumbing: whole texts to Arrow columns inside tasks, row by row, nothing gathered."""

from __future__ import annotations

import gc
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts turned into Python strings at a time; bounds a worker's memory, not the result.
CHUNK = 256


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def held_out(id_col: str) -> Column:
    """Rows kept away from every fit: crc32 of the id as text leaves 2 when divided by 4. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def map_texts(
    df: DataFrame, key_cols: Sequence[str], text_col: str, schema: str, work: Callable[[], Callable[[list[str]], list[pa.Array]]],
) -> DataFrame:
    """One output row per input row: the key columns as they are, then what `work()` makes of the texts.

    `work` runs once per task and returns the function for a list of texts. Only the key columns and the text
    are read, so other columns of `df` cannot clash with the output. A null text is ''.
    """
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    keys = ", ".join(f"`{c}` {type_of(df, c)}" for c in key_cols)
    n = len(key_cols)

    def run(batches):
        of_texts = work()
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                made = of_texts(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *made], names=[*key_cols, *names])

    slim = df.select(*(F.col(f"`{c}`") for c in key_cols), text_or_empty(text_col).alias("__text"))
    return slim.mapInArrow(run, ", ".join(x for x in (keys, schema) if x))


def fold_texts(df: DataFrame, cols: Sequence[Column], schema: str, work: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """One partial result per task: `work()` gives (add(columns as lists), finish() -> iterable of record batches)."""
    slim = df.select(*(c.alias(f"__c{i}") for i, c in enumerate(cols)))

    def run(batches):
        add, finish = work()
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                add(*(c.to_pylist() for c in part.columns))
        yield from finish()

    return slim.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_finished(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files that nothing can read any more.

    It notices them when the driver collects garbage, which a driver with little to do hardly does; until then they fill the executors'
    disks. Called after results that took a large shuffle are written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
