"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query derives its inputs from the provided tables (``fixtures``) and
runs one library operator over them.  Timestamps leave as TIMESTAMP_NTZ so
they compare as plain wall-clock values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.functions.pii import blind_index, key_column, protect, protect_with, ring_column, rotate, unprotect
from shopfloor.functions.text import clean_number, clean_text, is_blank, money
from shopfloor.operators import (catalog, clients, facts, finance, flows, formats, inventory, invoices, items, sales_log,
                                 sessions)
from shopfloor.operators.cleaning import (is_paid, normalize_purchases, normalize_sales, normalize_vault,
                                         standard_names)
from shopfloor.plans import fixtures as fx
from shopfloor.schemas import PURCHASE_HEADERS, SALES_HEADERS, VAULT_HEADERS
from shopfloor.session import shared_dir
from shopfloor.sources import append, read_table
from shopfloor.sources.bucketed import catalogue_rows, sold_by_month, write_bucketed
from shopfloor.sources.quarantine import read_checked
from shopfloor.sources.tables import stage
from shopfloor.streaming import queries as stream_q
from shopfloor.streaming import partials, runner, upsert

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def ntz(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


# ---------------------------------------------------------------- inputs
def sales(spark: SparkSession, d: str, with_items: bool = False) -> DataFrame:
    return normalize_sales(fx.fx_sales(spark, d, with_items=with_items))


def paid_lines(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Line items of paid sales (what the KPI and chart engines explode)."""
    return items.line_items(sales(spark, d, with_items=True).where(is_paid()), columns=columns)


def purchases(spark: SparkSession, d: str) -> DataFrame:
    return normalize_purchases(fx.fx_purchases(spark, d))


# ---------------------------------------------------------------- sources
def sheet(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """A derived table under the sheet's own header names, padded with a
    stray space as exports often are."""
    return df.withColumnsRenamed({c: f" {h} " for h, c in headers.items() if c in df.columns})


@query("scan_sales")
def scan_sales(spark, d):
    """The sales sheet with trimmed, mapped names."""
    return standard_names(sheet(fx.fx_sales(spark, d).drop("order_ts"), SALES_HEADERS), SALES_HEADERS)


@query("scan_purchases")
def scan_purchases(spark, d):
    """The purchases sheet."""
    return standard_names(sheet(fx.fx_purchases(spark, d), PURCHASE_HEADERS), PURCHASE_HEADERS)


@query("scan_vault")
def scan_vault(spark, d):
    """S3: the catalogue."""
    return standard_names(sheet(fx.fx_vault(spark, d), VAULT_HEADERS), VAULT_HEADERS)


@query("scan_quarantine")
def scan_quarantine(spark, d):
    """S1 on faulty CSV and JSON sheets: every line kept or set aside, and why."""
    header = [c for c in fx.fx_sales(spark, d).columns if c != "order_ts"]
    out = None
    for fmt in ("csv", "json"):
        path = shared_dir(spark, f"faulty_{fmt}") + "/data"
        fx.fx_sheet_lines(spark, d, fmt).write.text(path)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        kept, rejects = read_checked(spark, path, schema, fmt, required=["payment_status"],
                                     **({"header": "false", "nullValue": "\\N"} if fmt == "csv" else {}))
        rows = kept.select("row_pos", "paid_text", F.lit("kept").alias("outcome")).unionByName(rejects.select(
            F.regexp_extract("record", r'^x?(?:\{"row_pos":)?"?(\d+)', 1).alias("row_pos"),
            F.lit(None).cast("string").alias("paid_text"), F.col("reason").alias("outcome")))
        part = rows.select(F.lit(fmt).alias("sheet"), F.col("row_pos").cast("bigint").alias("row_pos"), "paid_text", "outcome")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- cleaning
@query("column_formats")
def q_column_formats(spark, d):
    """What each date column is written in, by the votes of all its values."""
    return formats.format_votes(fx.fx_dated(spark, d), ["here", "there"])


@query("voted_dates")
def q_voted_dates(spark, d):
    """Both columns read by their own votes."""
    read = formats.parse_dates(fx.fx_dated(spark, d), {"here": "here_ts", "there": "there_ts"})
    return read.select("row_pos", ntz("here_ts").alias("here_ts"), ntz("there_ts").alias("there_ts"))


@query("normalize_sales")
def q_normalize_sales(spark, d):
    s = sales(spark, d)
    return s.select("row_pos", ntz("sale_ts").alias("sale_ts"), ntz("sale_date").alias("sale_date"),
                    "client_name", "handle", F.col("cost").cast("double").alias("cost"),
                    F.col("courier").cast("double").alias("courier"), F.col("paid").cast("double").alias("paid"),
                    "payment_status")


@query("clean_amounts")
def q_clean_amounts(spark, d):
    raw = fx.fx_sales(spark, d)
    return raw.select("row_pos", "paid_text", clean_number("paid_text").alias("paid_num"),
                      money("paid_text").cast("double").alias("paid"),
                      money("cost_text").cast("double").alias("cost"),
                      money("courier_text").cast("double").alias("courier"))


@query("clean_dates")
def q_clean_dates(spark, d):
    s = sales(spark, d)
    return s.select("row_pos", "sale_date_text", ntz("sale_date").alias("sale_date"),
                    ntz("sale_ts").alias("sale_ts"), F.col("sale_date").cast("date").alias("sale_day"))


@query("clean_text")
def q_clean_text(spark, d):
    s = fx.fx_sales(spark, d)
    return s.select("row_pos", "client_name", clean_text("client_name").alias("client_name_clean"),
                    is_blank("client_name").alias("name_blank"))


# ---------------------------------------------------------------- filters / projections
@query("paid_sales")
def q_paid_sales(spark, d):
    s = sales(spark, d).where(is_paid())
    return s.select("row_pos", "handle", ntz("sale_date").alias("sale_date"),
                    F.col("paid").cast("double").alias("paid"), "payment_status")


@query("sale_profit")
def q_sale_profit(spark, d):
    return finance.sale_profit(sales(spark, d).where(is_paid()))


@query("recent_sales")
def q_recent_sales(spark, d):
    s = finance.recent_sales(sales(spark, d), fx.as_of_col(), 7)
    return s.select("row_pos", "handle", ntz("sale_date").alias("sale_date"), F.col("paid").cast("double").alias("paid"))


# ---------------------------------------------------------------- aggregates
@query("kpi_financial")
def q_kpi_financial(spark, d):
    return finance.kpi_financial(sales(spark, d))


@query("top_category")
def q_top_category(spark, d):
    return finance.top_category(paid_lines(spark, d, ["category", "quantity"]))


@query("dead_stock")
def q_dead_stock(spark, d):
    return finance.dead_stock(purchases(spark, d), fx.as_of_col())


@query("cac")
def q_cac(spark, d):
    return finance.cac(sales(spark, d), fx.as_of_col(), fx.WEEKLY_SPEND)


@query("monthly_revenue")
def q_monthly_revenue(spark, d):
    return finance.monthly_revenue(sales(spark, d))


@query("mom_growth")
def q_mom_growth(spark, d):
    return finance.mom_growth(sales(spark, d))


@query("daily_trend")
def q_daily_trend(spark, d):
    return finance.daily_trend(sales(spark, d), fx.as_of_col())


@query("client_value")
def q_client_value(spark, d):
    return clients.client_value(sales(spark, d))


@query("top_clients")
def q_top_clients(spark, d):
    return clients.top_clients(clients.client_value(sales(spark, d), sort=False))


@query("repeat_rate")
def q_repeat_rate(spark, d):
    return clients.repeat_rate(clients.client_value(sales(spark, d), sort=False))


# ---------------------------------------------------------------- nested
@query("line_items")
def q_line_items(spark, d):
    return items.line_items(sales(spark, d, with_items=True)).drop("unit_price")


@query("checked_lines")
def q_checked_lines(spark, d):
    """J1/P8f on faulty JSON: the lines that can be used, element by element."""
    return (items.line_items(fx.fx_faulty_sales(spark, d), columns=["sku", "category", "quantity", "selling_price"])
            .withColumn("quantity", items.quantity()))


@query("line_rejects")
def q_line_rejects(spark, d):
    """J1/P8f on faulty JSON: what can't be used, and why."""
    return items.item_rejects(fx.fx_faulty_sales(spark, d))


@query("cart_totals")
def q_cart_totals(spark, d):
    return items.cart_totals(all_lines(spark, d, ["quantity", "source_price", "selling_price"]))


@query("display_category")
def q_display_category(spark, d):
    li = all_lines(spark, d, ["category", "details"])
    return li.select("row_pos", "line_no", "category", "details",
                     items.display_category().alias("display_category"))


@query("category_mix")
def q_category_mix(spark, d):
    return finance.category_mix(paid_lines(spark, d, ["category", "details", "quantity"]))


@query("weekly_summary")
def q_weekly_summary(spark, d):
    return finance.weekly_summary(sales(spark, d), paid_lines(spark, d, ["category", "quantity"]), purchases(spark, d),
                                  fx.as_of_col(), fx.WEEKLY_SPEND)


@query("dashboard")
def q_dashboard(spark, d):
    """Every dataset of the dashboard out of one pass over sales."""
    return facts.stacked(flows.dashboard(fx.fx_sales(spark, d, with_items=True), fx.fx_purchases(spark, d),
                                         fx.as_of_col(), fx.WEEKLY_SPEND))


# ---------------------------------------------------------------- catalogue / inventory
def vault(spark: SparkSession, d: str) -> DataFrame:
    return fx.fx_vault(spark, d)


def all_lines(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return items.line_items(sales(spark, d, with_items=True), columns=columns)


@query("vault_add")
def q_vault_add(spark, d):
    """New items appended to the stored catalogue, which is read back."""
    v = vault(spark, d)
    path = shared_dir(spark, "vault_add") + "/data"
    existing = normalize_vault(v).drop("stock_text")
    append(existing, path)
    append(catalog.new_items(fx.fx_new_items(spark, d), v).select(*existing.columns), path)
    return read_table(spark, path, existing.schema)


@query("vault_delete")
def q_vault_delete(spark, d):
    """The stored catalogue after a commit that deletes the listed items."""
    log = upsert.catalogue(spark, shared_dir(spark, "vault_delete"))
    log.create(vault(spark, d))
    log.commit("deletes", lambda current: inventory.deleted_items(current, fx.fx_deletes(spark, d)))
    return log.read()


@query("vault_changes")
def q_vault_changes(spark, d):
    """A stored catalogue after a delivery, a sale of every line and the deletion
    of sold-out items, each a commit of its own rows."""
    log = upsert.catalogue(spark, shared_dir(spark, "vault_changes"))
    log.create(vault(spark, d))
    log.commit("restock", lambda current: inventory.changed_by_restock(current, fx.fx_restock(spark, d)))
    sold = inventory.sold_per_sku(all_lines(spark, d, ["sku", "quantity"]))
    log.commit("sales", lambda current: inventory.changed_by_sales(current, sold))
    log.commit("deletes", lambda current: inventory.deleted_items(current, fx.fx_deletes(spark, d)))
    return log.read().select("row_pos", "sku", "stock_text")


@query("stock_deduct")
def q_stock_deduct(spark, d):
    return inventory.stock_deduct(vault(spark, d), all_lines(spark, d, ["sku", "quantity"]))


@query("stock_copartitioned")
def q_stock_copartitioned(spark, d):
    """K1 on tables stored in buckets of the SKU: neither side is moved."""
    name, n = uuid.uuid4().hex[:12], 8
    lines = items.line_items(sales(spark, d, with_items=True).withColumn("month", F.trunc(F.col("sale_ts").cast("date"), "month")),
                             keep=["month"], columns=["sku", "quantity"])
    sold = write_bucketed(sold_by_month(lines, "month"), f"sold_{name}", "sku_key", n)
    stored = write_bucketed(catalogue_rows(vault(spark, d)), f"vault_{name}", "sku_key", n)
    return inventory.deduct_sold(stored, sold.groupBy("sku_key").agg(F.sum("sold_qty").alias("sold_qty")))


@query("stock_restock")
def q_stock_restock(spark, d):
    return inventory.restock(vault(spark, d), fx.fx_restock(spark, d))


@query("restock_rejects")
def q_restock_rejects(spark, d):
    return inventory.restock_rejects(vault(spark, d), fx.fx_restock(spark, d))


@query("unmatched_lines")
def q_unmatched_lines(spark, d):
    """Sold lines whose SKU is no longer in the catalogue after the
    sold-out items were deleted (they are skipped by the deduction)."""
    current = inventory.delete_items(vault(spark, d), fx.fx_deletes(spark, d))
    return inventory.unmatched_lines(current, all_lines(spark, d, ["sku", "quantity"]))


@query("stock_ledger")
def q_stock_ledger(spark, d):
    """Chunks are (SKU, day, block of order keys), an order-preserving
    coarsening of the movement order (day, order key, ...); their summaries
    are scanned by month and then by SKU."""
    moves = fx.fx_movements(spark, d)
    return inventory.floor_ledger(moves, "sku", fx.MOVEMENT_ORDER, [F.col("ts"), fx.order_block()],
                                  F.date_trunc("month", F.col("ts")))


@query("gallery")
def q_gallery(spark, d):
    return catalog.gallery(vault(spark, d), category="Ring", hide_sold_out=True)


@query("default_price")
def q_default_price(spark, d):
    return catalog.default_price(vault(spark, d))


@query("price_quotes")
def q_price_quotes(spark, d):
    return catalog.price_quotes(vault(spark, d))


@query("catalog_match")
def q_catalog_match(spark, d):
    return catalog.catalog_match(fx.fx_queries(spark, d), vault(spark, d))


@query("match_quotes")
def q_match_quotes(spark, d):
    v = vault(spark, d)
    best = catalog.catalog_match(fx.fx_queries(spark, d), v)
    quotes = catalog.price_quotes(v).select("row_pos", "cost", "standard_quote", "vip_quote", "clearance_quote")
    return best.join(quotes, "row_pos")


@query("tag_responses")
def q_tag_responses(spark, d):
    r = fx.fx_responses(spark, d)
    cat, tags = catalog.parse_tag_response(F.col("response"))
    return r.select("response_id", cat.alias("category"), tags.alias("tags"))


@query("tag_categories")
def q_tag_categories(spark, d):
    """how many parsed responses name each category."""
    return q_tag_responses(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("responses"))


# ---------------------------------------------------------------- invoices / sales log / PII
@query("invoice_headers")
def q_invoice_headers(spark, d):
    return invoices.invoice_headers(fx.fx_sales(spark, d))


@query("invoice_lines")
def q_invoice_lines(spark, d):
    return invoices.invoice_lines(fx.fx_sales(spark, d, with_items=True))


@query("recent_transactions")
def q_recent_transactions(spark, d):
    return invoices.recent_transactions(fx.fx_sales(spark, d))


def sale_headers(raw: DataFrame) -> DataFrame:
    """Header fields of a logged sale; the event instant is the order date
    plus the order's second-of-day offset, in UTC."""
    offset = F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0),
                             (F.col("row_pos") % 86400).cast("int"))
    return raw.select("row_pos", (F.col("order_ts") + offset).cast("timestamp").alias("event_ts"),
                      "client_name", "handle", "payment_status",
                      money("courier_text").alias("courier"))


#: Protects the fixture's made-up people; real data takes ``pii_key(spark)``.
FIXTURE_KEY = "key-of-the-test-fixture-32-bytes"


@query("log_sales")
def q_log_sales(spark, d):
    """Sale rows, name and handle protected, appended by sale month and read back."""
    key = key_column(spark, FIXTURE_KEY)
    built = sales_log.build_sales(fx.fx_lines(spark, d), sale_headers(fx.fx_sales(spark, d)), pii_key=key)
    path = shared_dir(spark, "sales_log") + "/data"
    append(built, path)
    logged = read_table(spark, path, built.schema)
    parsed = items.parse_items()
    return logged.withColumns({"client_name": unprotect("client_name", key), "handle": unprotect("handle", key)}).select(
        "*", F.size(parsed).cast("bigint").alias("n_items"),
        F.aggregate(parsed, F.lit(0.0), lambda acc, x: acc + x["Quantity"]).alias("json_qty"),
    ).drop("line_items_json")


@query("pii_roundtrip")
def q_pii_roundtrip(spark, d):
    key = key_column(spark, FIXTURE_KEY)
    raw = fx.fx_sales(spark, d)
    enc = raw.select("row_pos", "handle", protect("handle", key).alias("h"),
                     protect("client_name", key).alias("n"))
    return enc.select("row_pos", unprotect("h", key).alias("handle"), unprotect("n", key).alias("client_name"),
                      unprotect("handle", key).alias("handle_plain_read"),
                      F.coalesce(F.col("h") != F.col("handle"), F.lit(False)).alias("handle_protected"))


@query("client_value_protected")
def q_client_value_protected(spark, d):
    """Sales logged under two keys in turn, moved to the newer one; client value by the
    blind index equals that of the plain rows."""
    older, newer = "key-of-the-fixture-before-1995-x", FIXTURE_KEY
    index_key = "index-key-of-the-test-fixture"
    first = ring_column(spark, {"k1": older}, "k1", index_key)
    both = ring_column(spark, {"k1": older, "k2": newer}, "k2", index_key)
    raw = fx.fx_sales(spark, d)
    old = F.col("order_ts") < F.lit("1995-01-01").cast("timestamp_ntz")
    path = shared_dir(spark, "protected_sales") + "/data"
    for part, ring in ((raw.where(old), first), (raw.where(~old), both)):
        append(part.withColumns({"handle_index": blind_index("handle", ring), "handle": protect_with("handle", ring)}), path)
    logged = read_table(spark, path, spark.read.parquet(path).schema)
    moved = logged.withColumn("handle", rotate("handle", both))
    alone = ring_column(spark, {"k2": newer}, "k2", index_key)
    return clients.protected_client_value(normalize_sales(moved), alone)


@query("client_sketches")
def q_client_sketches(spark, d):
    """Distinct clients per window, and whether the estimate from the stream's daily
    sketches is within five standard errors of them."""
    s = sales(spark, d)
    sketched = _merge_stream(spark, stream_q.sales_stream(spark, d), "client_sketches", stream_q.CLIENT_SKETCHES)
    exact = stream_q.CLIENTS.finish(stream_q.CLIENTS.reduce(s))
    off = F.abs(F.col("estimate") - F.col("clients"))
    return exact.join(sketched, ["window_start", "window_end"]).select(
        "window_start", "window_end", "clients",
        (off <= F.greatest(F.lit(1.0), 5 * clients.SKETCH_ERROR * F.col("clients"))).alias("within_bound"))


# ---------------------------------------------------------------- sessions (batch)
@query("sessions")
def q_sessions(spark, d):
    ev = fx.table(spark, d, "events").select("user_id", "ts")
    return sessions.sessionize(ev, "user_id", "ts")


# ---------------------------------------------------------------- streaming (run with availableNow)
def _run(spark: SparkSession, built, name: str, partition_by: list[str] | None = None) -> DataFrame:
    df, mode, keys = built
    out = runner.run_stream(spark, df, name, mode, keys, partition_by=partition_by)
    return runner.read_output(spark, out, mode, df.schema, keys)


@query("stream_ingest")
def q_stream_ingest(spark, d):
    s = _run(spark, stream_q.ingest(spark, d), "stream_ingest", partition_by=["sale_month"])
    return s.select("row_pos", ntz("sale_ts").alias("sale_ts"), ntz("sale_date").alias("sale_date"),
                    "client_name", "handle", F.col("cost").cast("double").alias("cost"),
                    F.col("courier").cast("double").alias("courier"), F.col("paid").cast("double").alias("paid"),
                    "payment_status")


def _merge_stream(spark: SparkSession, stream: DataFrame, name: str, agg: partials.Mergeable) -> DataFrame:
    return partials.read_mergeable(spark, partials.run_mergeable(spark, stream, name, agg), stream, agg)


def _resumed(spark: SparkSession, name: str) -> dict[str, str]:
    """Folders with which a stream goes on from one delivery to the next."""
    return {"checkpoint": shared_dir(spark, "ckpt", name), "output": shared_dir(spark, "out", name)}


@query("stream_daily_trend")
def q_stream_daily_trend(spark, d):
    return _merge_stream(spark, stream_q.sales_stream(spark, d), "stream_daily_trend", stream_q.TREND)


@query("stream_weekly_clients")
def q_stream_weekly_clients(spark, d):
    return _merge_stream(spark, stream_q.sales_stream(spark, d), "stream_weekly_clients", stream_q.CLIENTS)


@query("stream_sessions")
def q_stream_sessions(spark, d):
    """T5: all sessions, those still open included."""
    return _merge_stream(spark, stream_q.event_stream(spark, d), "stream_sessions", stream_q.SESSIONS)


@query("stream_stock")
def q_stream_stock(spark, d):
    moves = stream_q.movement_stream(spark, d)
    return stream_q.read_stock(spark, stream_q.run_stock(spark, moves, "stream_stock"), moves)


@query("stream_late")
def q_stream_late(spark, d):
    """The daily trend of orders that arrive in four deliveries, each with orders of all
    dates; equals the recount of everything."""
    tables, again = shared_dir(spark, "late"), _resumed(spark, "stream_late")
    for _ in fx.fx_arrivals(spark, d, "orders", "o_orderkey", tables):
        stream = normalize_sales(fx.fx_sales(spark, d, orders=runner.read_stream_table(spark, tables, "orders")))
        out = partials.run_mergeable(spark, stream, "stream_late", stream_q.TREND, **again)
    return partials.read_mergeable(spark, out, stream, stream_q.TREND)


@query("stream_dashboard")
def q_stream_dashboard(spark, d):
    """The dashboard out of facts kept up to date, orders arriving in four deliveries;
    a delivery is joined with the lines of its own orders."""
    tables, again = shared_dir(spark, "facts"), _resumed(spark, "stream_dashboard")
    for i in fx.fx_arrivals(spark, d, "orders", "o_orderkey", tables):
        orders = runner.read_stream_table(spark, tables, "orders")
        lines = fx.table(spark, d, "lineitem").where(fx.arrival("l_orderkey") == i)
        stream = normalize_sales(fx.fx_sales(spark, d, with_items=True, orders=orders, lineitem=lines))
        out = partials.run_mergeable(spark, stream, "stream_dashboard", stream_q.FACTS, **again)
    kept = stage(partials.read_mergeable(spark, out, stream, stream_q.FACTS), "facts")
    return facts.stacked(facts.frames(kept, purchases(spark, d), fx.as_of_col(), fx.WEEKLY_SPEND))


@query("stream_late_stock")
def q_stream_late_stock(spark, d):
    """Stock out of movements that arrive in four deliveries, each with movements of all
    dates; equals the ledger (W3) in event order."""
    tables, again = shared_dir(spark, "late_stock"), _resumed(spark, "stream_late_stock")
    for _ in fx.fx_arrivals(spark, d, "lineitem", "l_orderkey", tables):
        moves = stream_q.movement_stream(spark, d, lineitem=runner.read_stream_table(spark, tables, "lineitem"))
        out = stream_q.run_stock(spark, moves, "stream_late_stock", **again)
    return stream_q.read_stock(spark, out, moves)


@query("stream_upsert")
def q_stream_upsert(spark, d):
    snap = upsert.run_upsert(spark, vault(spark, d), stream_q.sold_lines_stream(spark, d))
    return snap.select("row_pos", "sku", F.col("stock_text").alias("new_stock_text"))
