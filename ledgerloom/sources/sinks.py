"""Writers: snapshots, append-only history and CSV sheets."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.import_package import SHEET_NAMES, Package


def replace_snapshot(tables: dict[str, DataFrame], root: str) -> None:
    """Overwrite each table of a snapshot."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def replace_working_copy(suppliers: DataFrame, sites: DataFrame, root: str, audit_row: DataFrame) -> None:
    """Overwrite the supplier working copy; history tables only grow."""
    replace_snapshot({"suppliers": suppliers, "supplier_sites": sites}, root)
    audit_row.write.mode("append").parquet(f"{root}/audit_events")


def csv_cell(c: Column) -> Column:
    """Quoted only where the value holds a comma, a quote or a line end."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.regexp_replace(v, '"', '""'), F.lit('"'))).otherwise(v)


def csv_lines(df: DataFrame) -> DataFrame:
    cells = [csv_cell(F.col(c)) for c in df.columns]
    return df.select(reduce(lambda a, b: F.concat(a, F.lit(","), b), cells).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with CRLF line ends; the header line goes to its own file."""
    spark = df.sparkSession
    header = ",".join(df.columns)
    csv_lines(df).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/rows")
    spark.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")


def save_package(package: Package, root: str, created_at: str, actor: str = "operator", scope: str = "all") -> dict:
    """Write the sheets, the report of differences and a manifest under ``root/<batch>``; the manifest is returned.

    Rows are counted by the write itself, so the manifest says what was written.
    """
    folder, counts = f"{root.rstrip('/')}/{package.batch}", {}
    for name, df in {**package.sheets, "overlays": package.overlays}.items():
        seen = Observation(name)
        write_csv(df.drop("id").observe(seen, F.count(F.lit(1)).alias("rows")), f"{folder}/{SHEET_NAMES[name]}.csv")
        counts[name] = seen.get["rows"]
    made = package.counts.first()
    manifest = {
        "batchId": package.batch, "createdAt": created_at, "actor": actor.strip() or "operator", "scope": scope, "importAction": package.action,
        "counts": {**{n: c for n, c in counts.items() if n != "overlays"}, "overlayed": made["overlayed"], "synthesized": made["synthesized"]}, "overlayCount": counts["overlays"],
        "files": [{"name": f"{SHEET_NAMES[n]}.csv", "rows": c} for n, c in counts.items()],
    }
    spark = package.overlays.sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return manifest
