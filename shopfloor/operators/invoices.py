"""Invoice data for every sale (A13, F4-F6, F8, F9, F11, J3, H3, P4f).

The reference draws one PDF for a selected sale; drawing stays out of
scope, the invoice *content* is produced for all sales as two tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.text import clean_number, clean_text, format_money, is_blank, truncate
from shopfloor.operators.items import parse_items

# Fixed values that must equal the reference: invoice id prefix, fallback
# line category, the currency label on amounts, and the description limit
# (longer than 35 characters -> first 32 plus "..").
INVOICE_PREFIX = "INV-"
FALLBACK_CATEGORY = "Item"
CURRENCY = "INR "


def invoice_id(ts_text: Column) -> Column:
    """``INV-`` + last 6 characters of the timestamp without ``/ :`` and
    spaces (the HHMMSS part)."""
    return F.concat(F.lit(INVOICE_PREFIX), F.right(F.regexp_replace(ts_text, "[/: ]", ""), F.lit(6)))


def invoice_headers(raw_sales: DataFrame, file_prefix: str = "Invoice_") -> DataFrame:
    """Header per sale.  The grand total is the paid amount, not the sum of
    the lines; an unparsable amount makes the invoice fail (``ok`` false)."""
    total = clean_number(F.col("paid_text"))
    name = F.coalesce(F.col("client_name"), F.lit(""))
    return raw_sales.select(
        "row_pos",
        invoice_id(F.coalesce(F.col("sale_ts_text"), F.lit("N/A"))).alias("invoice_id"),
        name.alias("billed_to"),
        F.coalesce(F.col("sale_date_text"), F.lit("N/A")).alias("invoice_date"),
        total.alias("grand_total"),
        F.concat(F.lit(CURRENCY), format_money(total, 2)).alias("grand_total_text"),
        total.isNotNull().alias("ok"),
        F.concat(F.lit(file_prefix), F.replace(name, F.lit(" "), F.lit("_")), F.lit(".pdf")).alias("file_name"),
    )


def line_description(cat: Column, custom: Column) -> Column:
    """other+details -> details; details -> ``cat (details)``; else cat;
    over 35 characters -> first 32 + ``..``."""
    name = (F.when((F.lower(cat) == "other") & (custom != ""), custom)
            .when(custom != "", F.concat(cat, F.lit(" ("), custom, F.lit(")")))
            .otherwise(cat))
    return truncate(name, 35, 32, "..")


def invoice_lines(raw_sales: DataFrame) -> DataFrame:
    """Lines per sale.  JSON that does not parse gives one synthetic line
    (``Item``, qty 1, unit price = paid amount) (J3); unit price is
    ``Unit Price``, else ``Selling Price``, else 0 (Q6 fix)."""
    total = clean_number(F.col("paid_text"))
    parsed = parse_items()
    fallback = F.array(F.struct(
        F.lit(None).cast("string").alias("Item_SKU"), F.lit(FALLBACK_CATEGORY).alias("Category"),
        F.lit(None).cast("string").alias("Custom Details"), F.lit(1.0).alias("Quantity"),
        F.lit(None).cast("double").alias("Source Price (₹)"), F.lit(None).cast("double").alias("Selling Price (₹)"),
        total.alias("Unit Price (₹)")))
    arr = F.coalesce(parsed, fallback)
    numbered = F.transform(arr, lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("it")))
    rows = (raw_sales.where(total.isNotNull())
            .select("row_pos", F.inline_outer(numbered)).where(F.col("it").isNotNull()))
    it = F.col("it")
    cat = F.coalesce(it["Category"], F.lit(FALLBACK_CATEGORY))
    custom = F.coalesce(clean_text(it["Custom Details"]), F.lit(""))
    qty = F.coalesce(it["Quantity"].try_cast("bigint"), F.lit(1).cast("bigint"))
    unit = F.coalesce(it["Unit Price (₹)"], it["Selling Price (₹)"], F.lit(0.0))
    out = rows.select("row_pos", "line_no", line_description(cat, custom).alias("description"),
                      qty.alias("qty"), unit.alias("unit_price"))
    out = out.withColumn("line_total", F.col("qty") * F.col("unit_price"))
    return out.select("*", F.concat(F.lit(CURRENCY), format_money(F.col("unit_price"), 2)).alias("unit_price_text"),
                      F.concat(F.lit(CURRENCY), format_money(F.col("line_total"), 2)).alias("amount_text"))


def recent_transactions(raw_sales: DataFrame, n: int = 10) -> DataFrame:
    """P4f/H3/F8: the ``n`` newest sales with a client name, newest first,
    labelled ``date - name (₹amount)`` from the stored text."""
    label = F.concat(F.coalesce(F.col("sale_date_text"), F.lit("")), F.lit(" - "),
                     F.coalesce(F.col("client_name"), F.lit("")), F.lit(" (₹"),
                     F.coalesce(F.col("paid_text"), F.lit("")), F.lit(")"))
    return (raw_sales.where(~is_blank(F.col("client_name")))
            .orderBy(F.col("row_pos").desc()).limit(n)
            .select("row_pos", label.alias("label")))
