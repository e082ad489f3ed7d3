"""Every dashboard figure out of one pass, equal to the operators that read sales themselves."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL

from shopfloor.operators import clients, facts, finance, inventory, items
from shopfloor.operators.cleaning import is_paid, normalize_purchases, normalize_sales
from shopfloor.plans import fixtures as fx
from shopfloor.sources.bucketed import catalogue_rows, drop_bucketed, sold_by_month, write_bucketed

SALES = ("row_pos bigint, sale_ts_text string, sale_date_text string, client_name string, handle string, "
         "line_items_json string, cost_text string, courier_text string, paid_text string, payment_status string")


def sale(i, date, handle, paid, status, lines=None, ts="01/01/2001 10:00:00"):
    return (i, ts, date, "n", handle, lines, "1", "2", paid, status)


EDGES = [
    sale(1, "2001-07-31", "@a", "10", "Paid Online", '[{"Category": "ring", "Quantity": 2}, null, 5, {"Category": null, "Quantity": "3"}]'),
    sale(2, "2001-07-01", "@a", "20.5", "Paid (UPI/Bank)", '[{"Category": "other", "Custom Details": "a very long text of details", "Quantity": NaN}]'),
    sale(3, "n/a", "", "7", "Paid Online", "not json", ts=None),
    sale(4, None, None, "9", "Not Paid", "[]"),
    sale(5, "01/08/2001 23:59:59", "@b", "x", "Paid Online", '{"Category": "Ring", "Quantity": 1}'),
    sale(6, "2001-08-01", "@c", "100", "Pending", '[{"Category": "Polki", "Quantity": 50}]'),
    sale(6, "2001-08-01", "@c", "100", None, '[{"Category": "Polki", "Quantity": 50}]'),
]


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


@pytest.mark.parametrize("case", ["edges", "no legacy status", "empty", "table"])
def test_facts_give_what_the_sales_give(spark, case):
    if case == "table":
        raw = fx.fx_sales(spark, SMALL, with_items=True)
    else:
        kept = [] if case == "empty" else [s for s in EDGES if case == "edges" or s[-1] != "Paid (UPI/Bank)"]
        raw = spark.createDataFrame(kept, SALES)
    sales, purchases, as_of = normalize_sales(raw), normalize_purchases(fx.fx_purchases(spark, SMALL)), fx.as_of_col()
    lines = items.line_items(sales.where(is_paid()), columns=["category", "details", "quantity"])
    # merged out of halves, as batches would be
    halves = [facts.sale_facts(sales.where(F.coalesce(F.col("row_pos") % 2, F.lit(0)) == i)) for i in (0, 1)]
    f = facts.merge_facts(halves[0].unionByName(halves[1])).cache()
    values = clients.client_value(sales, sort=False)
    direct = {
        "summary": finance.weekly_summary(sales, lines, purchases, as_of, 12000.0),
        "daily_trend": finance.daily_trend(sales, as_of), "category_mix": finance.category_mix(lines),
        "client_value": values, "top_clients": clients.top_clients(values), "repeat_rate": clients.repeat_rate(values),
    }
    out = facts.frames(f, purchases, as_of, 12000.0)
    for name, want in direct.items():
        assert out[name].columns == want.columns
        assert rows(out[name]) == rows(want), name
    assert facts.stacked(out).count() == sum(df.count() for df in direct.values())
    f.unpersist()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sales_are_scanned_and_parsed_once(spark, tmp_path):
    spark.createDataFrame(EDGES, SALES).write.parquet(str(tmp_path / "sales"))
    p = plan(facts.sale_facts(normalize_sales(spark.read.schema(SALES).parquet(str(tmp_path / "sales")))))
    assert p.count("Scan parquet") == 1 and p.count("from_json") == 1 and "StringContains(payment_status,Paid)" in p
    assert p.count("Exchange hashpartitioning") == 1


def test_a_hot_client_is_one_row(spark):
    s = spark.range(20000).select(F.col("id").alias("row_pos"), F.lit("2001-07-31").alias("sale_date_text"), F.lit("@hot").alias("handle"),
                                  F.lit("1").alias("paid_text"), F.lit("Paid Online").alias("payment_status"))
    f = facts.sale_facts(normalize_sales(s))
    assert f.count() == 2 and facts.client_value(f).first()["lifetime_spend"] == 20000.0


def test_bucketed_tables_join_without_moving_rows(spark):
    sales = normalize_sales(fx.fx_sales(spark, SMALL, with_items=True))
    lines = items.line_items(sales.withColumn("month", F.trunc(F.col("sale_ts").cast("date"), "month")), keep=["month"],
                             columns=["sku", "quantity"])
    vault = fx.fx_vault(spark, SMALL)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sold = write_bucketed(sold_by_month(lines, "month"), "t_sold", "sku_key", 4)
        stored = write_bucketed(catalogue_rows(vault), "t_vault", "sku_key", 4)
        out = inventory.deduct_sold(stored, sold.groupBy("sku_key").agg(F.sum("sold_qty").alias("sold_qty")))
        assert "Exchange" not in plan(out) and "SortMergeJoin" in plan(out)
        assert rows(out) == rows(inventory.stock_deduct(vault, lines))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        drop_bucketed(spark, "t_sold", "t_vault")
