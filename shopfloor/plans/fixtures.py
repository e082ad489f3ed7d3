"""Derive the reference's tables from the provided test tables (FIXTURES.md).

The same expressions are written in DuckDB SQL in ``plans/oracle.py``.
Everything here is a lazy DataFrame over the whole input tables; the scans
are pruned to the columns each fixture needs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfloor.functions.text import CATEGORIES

# Replaces "now" in every rolling window (the newest order date in the data).
AS_OF = "2001-08-01 00:00:00"
# Weekly marketing spend used by the CAC keys.
WEEKLY_SPEND = 12000.0


def as_of_col() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cents(n: Column) -> Column:
    """Integer cents -> ``123.45`` text without float rounding."""
    return F.concat(F.floor(n / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((n % 100).cast("string"), 2, "0"))


def category_of(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (k % 7 + 1).cast("int"))


def fx_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Cart lines: one per lineitem row, keyed by its order (= sale)."""
    li = (lineitem if lineitem is not None else table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    s = F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint")
    # partition the line numbering by the output key, so the per-sale
    # aggregates downstream reuse this shuffle instead of adding another
    w = Window.partitionBy("row_pos").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                              "l_extendedprice", "l_quantity")
    k = F.col("l_partkey")
    cat = category_of(k)
    renamed = li.withColumnRenamed("l_orderkey", "row_pos")
    joined = renamed.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "line_no", F.row_number().over(w))
    return joined.select("row_pos", "line_no", sku_text(k),
                         F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
                         .when(F.col("l_linenumber") == 2, F.lower(cat)).otherwise(cat).alias("category"),
                         F.when(k % 3 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.lit("")).alias("details"),
                         F.col("l_quantity").alias("quantity"),
                         (F.floor(s * 6 / 10).cast("bigint") / F.lit(100).cast("double")).alias("source_price"),
                         (s / F.lit(100).cast("double")).alias("selling_price"))


def sku_text(k: Column) -> Column:
    """SKU of a cart line: some are blank or not known."""
    return (F.when(k % 11 == 0, F.lit("")).when(k % 11 == 1, F.lit("N/A"))
            .otherwise(F.concat(F.lit("JK-"), k.cast("string"))).alias("sku"))


def fx_sold_lines(spark: SparkSession, sf_dir: str, lineitem: DataFrame) -> DataFrame:
    """SKU and quantity of the cart lines in sales whose items can be read
    (``fx_sales``), from a stream of lineitem; the other tables are static."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_quantity").where(~(F.col("l_orderkey") % 30).isin(0, 1))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey")
    sales = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return (li.join(sales, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(sku_text(F.col("l_partkey")), F.col("l_quantity").alias("quantity")))


def lines_json(lines: DataFrame) -> DataFrame:
    """Serialise each sale's cart lines to the reference's JSON array (J2),
    in line order.  Groups are single orders, so each list is small."""
    item = F.struct(F.col("sku").alias("Item_SKU"), F.col("category").alias("Category"),
                    F.col("details").alias("Custom Details"), F.col("quantity").alias("Quantity"),
                    F.col("source_price").alias("Source Price (₹)"),
                    F.col("selling_price").alias("Selling Price (₹)"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("line_no"), item.alias("item"))))
    return (lines.groupBy("row_pos")
            .agg(F.to_json(F.transform(ordered, lambda x: x["item"])).alias("items_json")))


def fx_sales(spark: SparkSession, sf_dir: str, with_items: bool = False,
             orders: DataFrame | None = None, lineitem: DataFrame | None = None) -> DataFrame:
    """Raw (text) sales: orders joined to customers, injected blanks/junk.

    ``orders`` may be a streaming read of the orders table; the customer
    side and the line-item JSON are then static (stream-static joins).
    ``lineitem``: all lines of these orders, by default the whole table."""
    o = (orders if orders is not None else table(spark, sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k, ck = F.col("o_orderkey"), F.col("c_custkey")
    n = F.round(F.col("o_totalprice")).cast("bigint")
    d = F.col("o_orderdate")
    status = F.col("o_orderstatus")
    ts = d + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("int"))
    base = o.join(c, o.o_custkey == c.c_custkey)
    cols = [
        k.alias("row_pos"),
        F.date_format(ts, "dd/MM/yyyy HH:mm:ss").alias("sale_ts_text"),
        F.when(k % 20 == 0, F.lit("")).when(k % 20 == 1, F.lit("n/a"))
         .when((k % 20).between(2, 5), F.date_format(d, "yyyy-MM-dd"))
         .when((k % 20).between(6, 8), F.date_format(d, "dd/MM/yyyy"))
         .otherwise(F.date_format(d, "MMMM dd, yyyy")).alias("sale_date_text"),
        F.when(k % 25 == 0, F.lit("")).when(k % 25 == 1, F.lit("  ")).otherwise(F.col("c_name")).alias("client_name"),
        F.when(ck % 75 == 0, F.lit("")).when(ck % 74 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("@u"), ck.cast("string"))).alias("handle"),
        F.when(k % 40 == 0, F.lit("n/a")).when(k % 40 == 1, F.lit("")).otherwise(cents(n)).alias("paid_text"),
        cents(F.floor(n / 2).cast("bigint")).alias("cost_text"),
        (k % 7 * 10).cast("string").alias("courier_text"),
        F.when((status == "F") & (k % 2 == 0), F.lit("Paid Online"))
         .when(status == "F", F.lit("Paid (UPI/Bank)"))
         .when(status == "O", F.lit("Cash on Delivery"))
         .when((status == "P") & (k % 50 == 0), F.lit("Not Paid"))
         .when((status == "P") & (k % 50 == 1), F.lit("Unpaid"))
         .when((status == "P") & (k % 50 == 2), F.lit(None).cast("string"))
         .when(status == "P", F.lit("Pending")).alias("payment_status"),
        d.alias("order_ts"),
    ]
    if not with_items:
        return base.select(*cols)
    sales = base.select(*cols)
    items = lines_json(fx_lines(spark, sf_dir, lineitem))
    j = F.col("items_json")
    return (sales.join(items, "row_pos", "left")
            .withColumn("line_items_json",
                        F.when(F.col("row_pos") % 30 == 0, F.lit(""))
                         .when(F.col("row_pos") % 30 == 1, F.lit("not json")).otherwise(j))
            .drop("items_json"))


def fx_faulty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales whose JSON is as people and scripts leave it: by sale, elements that are no
    object, quantities as text, quantities that are NaN or words, lone values."""
    s = fx_sales(spark, sf_dir, with_items=True).select("row_pos", "line_items_json")
    k, j = F.col("row_pos") % 17, F.col("line_items_json")
    quantities = lambda to: F.regexp_replace(j, r'"Quantity":([0-9.]+)', f'"Quantity":{to}')
    is_list = j.startswith("[")
    return s.withColumn("line_items_json",
                        F.when(is_list & (k == 3), F.concat(F.regexp_replace(j, r"\]$", ""), F.lit(',5,"x",null]')))
                        .when(is_list & (k == 4), quantities('"$1"'))
                        .when(is_list & (k == 5), quantities("NaN"))
                        .when(is_list & (k == 6), F.concat(quantities('"many"')))
                        .when(is_list & (k == 7), F.lit("42")).otherwise(j))


def fx_sheet_lines(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """Lines (``value``) of a sales sheet as text, spoilt by row: 3 of 19 lack their end,
    4 of 19 have something before or behind them."""
    s = fx_sales(spark, sf_dir).drop("order_ts")
    row, k = F.struct(*[F.col(c).cast("string").alias(c) for c in s.columns]), F.col("row_pos") % 19
    if fmt == "json":
        line = F.to_json(row)
        value = (F.when(k == 3, F.regexp_replace(line, r"\}$", "")).when(k == 4, F.concat(F.lit("x"), line)).otherwise(line))
    else:
        line = F.to_csv(row, {"nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
        value = (F.when(k == 3, F.regexp_replace(line, r",[^,]*$", "")).when(k == 4, F.concat(line, F.lit(",x"))).otherwise(line))
    return s.select(value.alias("value"))


def fx_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as two offices write them: ``here`` day-first, ``there`` month-first; a
    few typed the other way round, in words, blank or no date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")

    def written(usual: str, other: str, by: int) -> Column:
        return (F.when(k % by == 0, F.lit("")).when(k % by == 1, F.lit("soon")).when(k % by == 2, F.date_format(d, other))
                .when(k % by == 3, F.date_format(d, "yyyy-MM-dd")).when(k % by == 4, F.date_format(d, "MMMM dd, yyyy"))
                .otherwise(F.date_format(d, usual)))

    return o.select(k.alias("row_pos"), written("dd/MM/yyyy", "MM/dd/yyyy", 23).alias("here"),
                    written("MM/dd/yyyy", "dd/MM/yyyy", 29).alias("there"))


def fx_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate")
    k = F.col("l_orderkey")
    return li.select(
        F.when(k % 30 == 0, F.lit("")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("purchase_date_text"),
        F.when(k % 31 == 0, F.lit("x")).otherwise(cents(F.round("l_extendedprice").cast("bigint"))).alias("amount_text"),
    )


def _price_text(k: Column, mod: int, n: Column) -> Column:
    r = k % mod
    return (F.when(r == 0, F.lit(None).cast("string")).when(r == 1, F.lit("")).when(r == 2, F.lit("ask"))
            .otherwise(cents(n)))


def fx_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    n = F.round(F.col("p_retailprice") * 100).cast("bigint")
    sku = F.concat(F.lit("JK-"), k.cast("string"))
    return p.select(
        k.alias("row_pos"),
        sku.alias("sku"),
        cents(n).alias("sourcing_price_text"),
        F.concat_ws(", ", category_of(k), F.col("p_name"), F.col("p_type")).alias("tags"),
        F.concat(F.lit("https://img.example/"), sku).alias("image_url"),
        _price_text(k, 4, 2 * n).alias("standard_price_text"),
        _price_text(k, 5, 2 * n).alias("vip_price_text"),
        _price_text(k, 6, n).alias("clearance_price_text"),
        F.when(k % 13 == 0, F.lit("")).when(k % 7 == 0, F.lit("0")).when(k % 101 == 0, F.lit("x"))
         .otherwise(F.col("p_size").cast("string")).alias("stock_text"),
    )


def fx_movements(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Stock movements: every lineitem is a sale (or a return when flagged
    ``R``) of its part on the order date; opening stock is the part size.
    ``lineitem`` may be a streaming read (orders and part stay static)."""
    li = (lineitem if lineitem is not None else table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                 "l_quantity", "l_extendedprice", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
            .select(F.concat(F.lit("JK-"), F.col("l_partkey").cast("string")).alias("sku"),
                    F.col("o_orderdate").alias("ts"),
                    "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
                    F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
                     .otherwise(-F.col("l_quantity")).cast("bigint").alias("delta"),
                    F.col("p_size").cast("bigint").alias("s0")))


def order_block() -> Column:
    """Blocks of 2^14 order keys: a coarsening of the movement order inside a
    day, so that even one SKU-day with a third of all rows is many chunks."""
    return F.floor(F.col("l_orderkey") / (1 << 14))


ARRIVALS = 4


def arrival(key: str) -> Column:
    """Number of the delivery, from 0, with which rows of ``key`` arrive."""
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(ARRIVALS)).cast("int")


def fx_arrivals(spark: SparkSession, sf_dir: str, name: str, key: str, target: str) -> Iterator[int]:
    """Table ``name`` as a folder under ``target`` that grows by ``ARRIVALS`` deliveries, dealt
    by a hash of ``key``: every delivery has rows of all dates, so most rows after the first are
    late.  Gives the number of each delivery when its files are there; they are written by as
    many tasks as read the table."""
    for i in range(ARRIVALS):
        table(spark, sf_dir, name).where(arrival(key) == i).write.mode("append").parquet(f"{target}/{name}.parquet")
        yield i


MOVEMENT_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "delta"]


def fx_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests: every part is described in its own words (some
    descriptions repeat a word, some are blank)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    k = F.col("p_partkey")
    q = F.concat_ws(", ", "p_name", "p_type")
    return (p.select(k.alias("query_id"),
                    F.when(k % 70 == 0, F.lit(""))
                     .when(k % 50 == 0, F.concat(q, F.lit(" "), F.split("p_name", " ")[0]))
                     .otherwise(q).alias("query")))


def fx_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    cat = F.when(k % 7 == 0, F.lit("Kundan Choker Set")).otherwise(category_of(k))
    sep = F.when(k % 5 == 0, F.lit(" ")).otherwise(F.lit(" | "))
    return p.select(k.alias("response_id"),
                    F.concat(F.lit("Category: "), cat, sep, F.lit("Tags: "), F.col("p_name")).alias("response"))


def fx_restock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restock requests: one per part (``p_size - 10``; zero or negative
    quantities are no-ops), plus SKUs that are not in the catalogue."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    req = p.select(
        F.concat(F.lit("JK-"), F.col("p_partkey").cast("string")).alias("sku"),
        (F.col("p_size") - 10).cast("bigint").alias("qty"))
    missing = spark.createDataFrame([(f"JK-MISSING-{i}", 5) for i in (1, 2, 3)], "sku string, qty bigint")
    return req.unionByName(missing)


def fx_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests: every sold-out item (stock text ``0``), plus one SKU
    that is not in the catalogue."""
    v = fx_vault(spark, sf_dir)
    unknown = spark.createDataFrame([("JK-UNKNOWN",)], "sku string")
    return v.where(F.col("stock_text") == "0").select("sku").unionByName(unknown)


def fx_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue intake: a second delivery of every part, with the fields the
    intake form collects (category, extra tags, price overrides, stock)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    over = F.when(k % 4 == 0, F.col("p_retailprice") * 2).otherwise(F.lit(0.0))
    return p.select(
        k.alias("intake_id"),
        (as_of_col() + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0),
                                       k.cast("int"))).alias("intake_ts"),
        F.col("p_retailprice").alias("sourcing_price"),
        category_of(k).alias("category"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("p_name")).alias("raw_tags"),
        over.alias("std_override"), (over * 0.75).alias("vip_override"), F.lit(0.0).alias("clr_override"),
        F.col("p_size").cast("bigint").alias("stock_qty"),
    )
