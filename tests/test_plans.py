"""Physical-plan checks: the shapes the scale design relies on."""

import pytest

import __spark_entry__ as entry
from conftest import SMALL

from shopfloor.plans.registry import REGISTRY

QUERIES = {k: f for k, f in entry.queries().items() if k in REGISTRY}
BATCH_KEYS = [k for k in QUERIES if not k.startswith("stream_")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_json_parsed_once(spark):
    p = plan(QUERIES["line_items"](spark, SMALL))
    assert p.count("from_json") == 1, p


def test_top_clients_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_clients"](spark, SMALL))


@pytest.mark.parametrize("key", BATCH_KEYS)
def test_no_python_in_batch_plans(spark, key):
    p = plan(QUERIES[key](spark, SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_column_pruning_reaches_scan(spark):
    p = plan(QUERIES["kpi_financial"](spark, SMALL))
    assert "o_orderpriority" not in p and "c_mktsegment" not in p


def test_paid_filter_pushed_to_parquet(spark, tmp_path):
    from shopfloor.operators.cleaning import is_paid
    path = str(tmp_path / "sales")
    spark.createDataFrame([("Paid Online", 1.0), ("Pending", 2.0)], "payment_status string, paid double") \
        .write.parquet(path)
    p = plan(spark.read.parquet(path).where(is_paid()))
    assert "StringContains(payment_status,Paid)" in p


def test_stock_deduct_preaggregates_before_join(spark):
    p = plan(QUERIES["stock_deduct"](spark, SMALL))
    # sold quantities are summed per SKU (partial + final aggregate) before joining the catalogue
    assert "partial_sum" in p


def test_line_numbers_skip_lines_without_a_part(spark, tmp_path):
    """Lines whose part is missing leave no gap in the numbering, whatever
    join Spark picks for the catalogue."""
    from shopfloor.plans import fixtures as fx
    d = str(tmp_path)
    spark.createDataFrame(
        [(1, 10, 1, 1, 2.0, 20.0), (1, 11, 1, 2, 1.0, 10.0), (1, 12, 1, 3, 1.0, 10.0)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    ).selectExpr("*", "date '2001-01-01' as l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(11, "a b", "x"), (12, "c d", "y")], "p_partkey long, p_name string, p_brand string") \
        .write.parquet(f"{d}/part.parquet")
    for threshold in ("-1", "10485760"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = sorted((r["line_no"], r["selling_price"]) for r in fx.fx_lines(spark, d).collect())
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert [n for n, _ in got] == [1, 2]
