"""Input that is read in one piece is worked on by many tasks; printed statements are built and read line by line."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import statements as st
from ledgerloom.sources import adapters
from ledgerloom.sources.adapters import Domain


def _tables(spark, path, orders=400):
    spark.sql("SELECT 0 AS n_nationkey, 'N0' AS n_name, 0 AS n_regionkey UNION ALL SELECT 1, 'N1', 1").write.parquet(f"{path}/nation.parquet")
    spark.sql("SELECT CAST(id AS BIGINT) AS c_custkey, CAST(id % 2 AS INT) AS c_nationkey FROM range(1, 21)").write.parquet(f"{path}/customer.parquet")
    spark.sql("SELECT CAST(id AS BIGINT) AS s_suppkey, CAST(id % 2 AS INT) AS s_nationkey FROM range(1, 21)").write.parquet(f"{path}/supplier.parquet")
    spark.range(1, orders + 1, 1, 1).selectExpr(
        "id AS o_orderkey", "1 + id % 20 AS o_custkey", "'O' AS o_orderstatus", "CAST(id * 37.25 AS DOUBLE) AS o_totalprice", "CAST(DATE'1995-01-01' + CAST(id % 900 AS INT) AS TIMESTAMP) AS o_orderdate"
    ).write.parquet(f"{path}/orders.parquet")
    spark.range(1, orders * 2, 1, 1).selectExpr(
        "1 + id % 300 AS l_orderkey", "1 + id % 20 AS l_suppkey", "CAST(id AS DOUBLE) AS l_extendedprice", "CAST(DATE'1995-02-01' AS TIMESTAMP) AS l_shipdate"
    ).write.parquet(f"{path}/lineitem.parquet")
    return Domain(spark, str(path))


def test_facts_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    d, tasks = _tables(spark, tmp_path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.parquet(f"{tmp_path}/orders.parquet").rdd.getNumPartitions() == 1
    for name in ("order_facts", "purchase_facts"):
        assert d[name].rdd.getNumPartitions() == tasks > 1


def test_printed_items_are_those_of_their_select(spark, tmp_path):
    d = _tables(spark, tmp_path)
    wanted = spark.sql(adapters.DOMAIN["statement_items"], printed_postings=d.printed_postings)
    got = d.statement_items
    assert got.columns == wanted.columns and got.count() == wanted.count() > 1000
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    # the window over the postings is worked out for rows and for pages, not for each thing that is printed
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 12


@pytest.mark.parametrize("words, joined", [
    (["A"] * 20000, "A" * 20000), (["Abc", "d"] * 3 + ["longer"], "Abc dAbcdAbcd longer"), (["b2", "x", "y", "12"], "b2 xy 12"), (["plain", "words"], "plain words"), ([""], ""),
])
def test_long_runs_of_letters(spark, words, joined):
    row = spark.createDataFrame([(" ".join(words),)], "s string").select(st.collapse_spaced_letters(F.col("s")).alias("s")).first()
    assert row.s == joined


def test_a_line_of_very_many_items(spark):
    items = spark.range(30000).selectExpr("'D' AS doc_id", "id + 1 AS page", "id + 1 AS item_no", "CAST(id % 100 AS DOUBLE) * 50 AS x", "5D AS y", "CASE WHEN id % 2 = 0 THEN 50D END AS width", "8D AS height", "'word' AS str")
    (line,) = st.reading_lines(items).collect()
    assert (line.line_no, line.text.count("word")) == (1, 30000) and line.text.startswith("wordword")
