"""Building sale rows from carts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.pii import protect
from shopfloor.operators.items import line_amount, quantity

LOCAL_ZONE = "Asia/Kolkata"


def build_sales(cart_lines: DataFrame, headers: DataFrame, zone: str = LOCAL_ZONE,
                pii_key: Column | None = None) -> DataFrame:
    """One sale row per cart.

    ``cart_lines``: row_pos, line_no, sku, category, details, quantity,
    source_price, selling_price.  ``headers``: row_pos, event_ts (instant),
    client_name, handle, payment_status, courier.  Cart totals are exact
    decimal sums (A11); the lines are serialised in line order (J2); stamps
    are local-time text (F7).  With ``pii_key`` the name and handle are
    written protected (Q9 fix)."""
    item = F.struct(F.col("sku").alias("Item_SKU"), F.col("category").alias("Category"),
                    F.col("details").alias("Custom Details"), F.col("quantity").alias("Quantity"),
                    F.col("source_price").alias("Source Price (₹)"),
                    F.col("selling_price").alias("Selling Price (₹)"))
    carts = (cart_lines.groupBy("row_pos")
             .agg(F.sort_array(F.collect_list(F.struct("line_no", item.alias("it")))).alias("_items"),
                  F.sum(quantity()).alias("_pieces"),
                  F.sum(line_amount("source_price")).alias("_cost"),
                  F.sum(line_amount("selling_price")).alias("_revenue")))
    local = F.from_utc_timestamp(F.col("event_ts"), zone)
    name, handle = F.col("client_name"), F.col("handle")
    if pii_key is not None:
        name, handle = protect(name, pii_key), protect(handle, pii_key)
    return headers.join(carts, "row_pos").select(
        "row_pos",
        F.date_format(local, "dd/MM/yyyy HH:mm:ss").alias("sale_ts_text"),
        F.date_format(local, "MMMM dd, yyyy").alias("sale_date_text"),
        name.alias("client_name"), handle.alias("handle"),
        F.to_json(F.transform("_items", lambda x: x["it"])).alias("line_items_json"),
        F.col("_pieces").try_cast("bigint").alias("total_pieces"),
        F.col("_cost").cast("double").alias("total_cost"),
        F.col("courier").cast("double").alias("courier"),
        F.col("_revenue").cast("double").alias("amount_paid"),
        "payment_status",
    )
