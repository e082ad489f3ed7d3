"""Declared schemas.  Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L = T.StringType(), T.DoubleType(), T.LongType()

# Fixed values that must equal the reference: the header names of the sales,
# purchases and catalogue sheets and of a JSON line item, each mapped to the
# column name used here.
SALES_HEADERS = {
    "Timestamp": "sale_ts_text",
    "Date of Sale": "sale_date_text",
    "Client Formal Name": "client_name",
    "Instagram/Facebook Handle": "handle",
    "Line_Items_JSON": "line_items_json",
    "Total Pieces Sold": "pieces_text",
    "Total Cost of These Items": "cost_text",
    "Courier Charge You Paid": "courier_text",
    "Total Amount Client Paid You": "paid_text",
    "Payment Status": "payment_status",
}
PURCHASE_HEADERS = {"Date of Purchase": "purchase_date_text", "Total Amount": "amount_text"}
VAULT_HEADERS = {
    "Item_SKU": "sku",
    "Sourcing_Price": "sourcing_price_text",
    "tags": "tags",
    "image_url": "image_url",
    "Standard_Price": "standard_price_text",
    "VIP_Price": "vip_price_text",
    "Clearance_Price": "clearance_price_text",
    "Stock_Quantity": "stock_text",
}
ITEM_FIELDS = {
    "Item_SKU": "sku",
    "Category": "category",
    "Custom Details": "details",
    "Quantity": "quantity",
    "Source Price (₹)": "source_price",
    "Selling Price (₹)": "selling_price",
    "Unit Price (₹)": "unit_price",
}

# Raw (text) tables as stored: one string column per sheet column plus the
# append position ``row_pos`` (pandas relied on physical order; we never do).
RAW_SALES = T.StructType([T.StructField("row_pos", L)] +
                         [T.StructField(c, S) for c in SALES_HEADERS.values()])
RAW_PURCHASES = T.StructType([T.StructField("row_pos", L)] +
                             [T.StructField(c, S) for c in PURCHASE_HEADERS.values()])
RAW_VAULT = T.StructType([T.StructField("row_pos", L)] +
                         [T.StructField(c, S) for c in VAULT_HEADERS.values()])

# Quantity is DOUBLE on purpose: with BIGINT, ``2.0`` parses to null.
LINE_ITEM = T.StructType([
    T.StructField("Item_SKU", S), T.StructField("Category", S), T.StructField("Custom Details", S),
    T.StructField("Quantity", D), T.StructField("Source Price (₹)", D),
    T.StructField("Selling Price (₹)", D), T.StructField("Unit Price (₹)", D),
])
LINE_ITEMS = T.ArrayType(LINE_ITEM)

# Typed catalogue after normalisation.
VAULT = T.StructType([
    T.StructField("row_pos", L), T.StructField("sku", S), T.StructField("sourcing_price", D),
    T.StructField("tags", S), T.StructField("image_url", S), T.StructField("standard_price", D),
    T.StructField("vip_price", D), T.StructField("clearance_price", D), T.StructField("stock_qty", L),
])
