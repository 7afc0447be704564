"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def distributed_row_number(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``row_number()`` per group without putting a group into one task.

    Rows are range-partitioned by group and order and written once, so that the
    slice number of a row is fixed. Each slice is numbered by itself and shifted
    by the rows its group has in earlier slices.
    """
    sliced = materialise(df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id()))
    w = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    numbered = sliced.withColumn("_local", local)
    matched = [numbered[c].eqNullSafe(shifts[c]) for c in [*group, "_slice"]]
    condition = matched[0]
    for m in matched[1:]:
        condition = condition & m
    joined = numbered.join(shifts, condition)
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_local") + F.col("_shift")).cast("bigint").alias(name))
