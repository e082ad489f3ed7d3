"""Normalisation (N1-N6, N9): names, presence guards, typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.text import clean_number, clean_text, money, parse_date
from shopfloor.schemas import PURCHASE_HEADERS, SALES_HEADERS, VAULT_HEADERS

PAID_MARK = "Paid"


def standard_names(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Trim header names, then map sheet headers to column names."""
    trimmed = [c.strip() for c in df.columns]
    out = df.toDF(*trimmed)
    renames = {c: headers[c] for c in trimmed if c in headers}
    return out.withColumnsRenamed(renames) if renames else out


def require(df: DataFrame, required: list[str], optional: dict[str, object]) -> DataFrame:
    """A missing required column is an error, a missing optional column
    gets its default."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s) {missing}; columns found: {df.columns}")
    add = {c: F.lit(v).cast("string") for c, v in optional.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def normalize_sales(raw: DataFrame) -> DataFrame:
    """Typed sales.  Money is a wide decimal with unparsable -> 0; dates are
    timestamps with unparsable -> null; text columns are kept as written, among
    them the blind index of a protected handle, if there is one."""
    df = standard_names(raw, SALES_HEADERS)
    df = require(df, ["sale_date_text"], {
        "row_pos": None, "sale_ts_text": None, "client_name": None, "handle": None,
        "line_items_json": None, "cost_text": None, "courier_text": "0", "paid_text": None,
        "payment_status": None,
    })
    return df.select(
        F.col("row_pos").cast("bigint"),
        "sale_ts_text",
        F.try_to_timestamp("sale_ts_text", F.lit("d/M/yyyy H:m:s")).alias("sale_ts"),
        "sale_date_text",
        parse_date("sale_date_text").alias("sale_date"),
        "client_name", "handle", "line_items_json",
        money("cost_text").alias("cost"),
        money("courier_text").alias("courier"),
        money("paid_text").alias("paid"),
        "payment_status", *[c for c in ("handle_index",) if c in df.columns],
    )


def is_paid(status="payment_status"):
    """P1f filter: status contains ``Paid`` (case-sensitive).  A null status
    gives null, which a filter drops (= not paid).  Kept bare so it pushes
    to Parquet as ``StringContains``; use ``paid_flag`` for a value."""
    c = F.col(status) if isinstance(status, str) else status
    return c.contains(PAID_MARK)


def paid_flag(status="payment_status"):
    """P1f as a non-null boolean value (null status -> false)."""
    return F.coalesce(is_paid(status), F.lit(False))


def normalize_purchases(raw: DataFrame) -> DataFrame:
    df = standard_names(raw, PURCHASE_HEADERS)
    df = require(df, [], {"purchase_date_text": None, "amount_text": None})
    return df.select(parse_date("purchase_date_text").alias("purchase_date"),
                     money("amount_text").alias("amount"))


def stock_value(c, bad_as_zero: bool) -> F.Column:
    """Integer stock.  Blank -> 0; other text that is not an integer ->
    null (the row is skipped by a deduction) or 0 (restock)."""
    s = F.col(c) if isinstance(c, str) else c
    t = clean_text(s.cast("string"))  # int() strips any whitespace
    v = F.when(s.isNull() | (t == ""), F.lit(0).cast("bigint")).otherwise(t.try_cast("bigint"))
    return F.coalesce(v, F.lit(0).cast("bigint")) if bad_as_zero else v


def normalize_vault(raw: DataFrame) -> DataFrame:
    """Typed catalogue; prices are nullable doubles (blank/junk -> null) and
    ``stock_qty`` is the parsed integer (null when the cell is junk)."""
    df = standard_names(raw, VAULT_HEADERS)
    df = require(df, ["sku"], {
        "row_pos": None, "sourcing_price_text": None, "tags": None, "image_url": None,
        "standard_price_text": None, "vip_price_text": None, "clearance_price_text": None, "stock_text": None,
    })
    return df.select(
        F.col("row_pos").cast("bigint"), "sku",
        clean_number("sourcing_price_text").alias("sourcing_price"),
        "tags", "image_url",
        clean_number("standard_price_text").alias("standard_price"),
        clean_number("vip_price_text").alias("vip_price"),
        clean_number("clearance_price_text").alias("clearance_price"),
        stock_value("stock_text", bad_as_zero=False).alias("stock_qty"),
        F.col("stock_text"),
    )
