"""Streaming queries over the fixture streams.

``TREND``, ``CLIENTS`` and ``SESSIONS`` are mergeable aggregates and
``run_stock`` rebuilds touched chunks (``streaming.partials``): the result is the
same for any order and any cut of the input into batches, late rows included
(T7), and ``plans.registry`` runs these.

The builders ``daily_trend``, ``weekly_clients`` and ``sessions`` are the
watermark forms, for sinks that need finished rows only; they return
``(streaming DataFrame, output mode, key columns)``, let go of windows and
sessions that the watermark has passed, and do not count rows that come later.
Event time is cast to TIMESTAMP there (``withWatermark`` rejects TIMESTAMP_NTZ).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.operators.cleaning import is_paid, normalize_sales
from shopfloor.operators.clients import client_sketches, merge_sketches, sketched_clients
from shopfloor.operators.facts import merge_facts, sale_facts
from shopfloor.operators.inventory import chunk_summary, closing_stock
from shopfloor.operators.sessions import GAP_SECONDS, merge_stretches, stitch, stretches
from shopfloor.plans import fixtures as fx
from shopfloor.sources.tables import empty
from shopfloor.streaming.partials import Mergeable, read_rebuilt, run_rebuilt
from shopfloor.streaming.runner import read_stream_table


def sales_stream(spark: SparkSession, sf_dir: str, with_items: bool = False, max_files: int | None = None) -> DataFrame:
    """Normalised sales arriving as new order files."""
    orders = read_stream_table(spark, sf_dir, "orders", max_files=max_files)
    return normalize_sales(fx.fx_sales(spark, sf_dir, with_items=with_items, orders=orders))


def ingest(spark: SparkSession, sf_dir: str):
    """Append normalised sales, laid out by sale month (``sale_month``)
    so date-bounded reads prune partitions."""
    s = sales_stream(spark, sf_dir)
    return s.withColumn("sale_month", F.trunc(F.col("sale_date").cast("date"), "month")), "append", None


def daily_trend(spark: SparkSession, sf_dir: str, watermark: str = "3 days", mode: str = "update"):
    """Tumbling one-day event-time windows of paid revenue and profit.

    ``update`` upserts the days that a batch changed; ``append`` writes a day
    once the watermark has passed its end; ``complete`` keeps every day as
    state and rewrites them all (a parity form for tests)."""
    s = sales_stream(spark, sf_dir).where(is_paid() & F.col("sale_date").isNotNull())
    s = s.withColumn("event_time", F.col("sale_date").cast("timestamp")).withWatermark("event_time", watermark)
    agg = (s.groupBy(F.window("event_time", "1 day").alias("w"))
           .agg(F.sum("paid").alias("gross_revenue"),
                F.sum(F.col("paid") - F.col("cost") - F.col("courier")).alias("true_profit")))
    return agg.select(F.col("w.start").cast("date").alias("sale_day"),
                      F.col("gross_revenue").cast("double").alias("gross_revenue"),
                      F.col("true_profit").cast("double").alias("true_profit")), mode, ["sale_day"]


def weekly_clients(spark: SparkSession, sf_dir: str, watermark: str = "7 days", approximate: bool = False,
                   mode: str = "update"):
    """Distinct paid clients per sliding 7-day window (1-day step).

    Exact distinct aggregates are not allowed on streams, so the stream keeps
    the distinct (day, handle) pairs until the watermark passes the day, and
    ``distinct_per_window`` spreads them over their windows when the sink is
    read.  With ``approximate`` the stream keeps one HyperLogLog sketch per
    window instead (much less state, small error)."""
    s = sales_stream(spark, sf_dir).where(is_paid() & F.col("sale_date").isNotNull() & F.col("handle").isNotNull())
    s = s.withColumn("event_time", F.col("sale_date").cast("timestamp")).withWatermark("event_time", watermark)
    if approximate:
        agg = s.groupBy(F.window("event_time", "7 days", "1 day").alias("w")).agg(
            F.approx_count_distinct("handle").alias("clients"))
        return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                          F.col("w.end").cast("timestamp_ntz").alias("window_end"), "clients"), mode, [
            "window_start", "window_end"]
    agg = s.groupBy(F.window("event_time", "1 day").alias("w"), "handle").agg(F.count(F.lit(1)).alias("sales"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "handle", "sales"), mode, ["day", "handle"]


def distinct_per_window(pairs: DataFrame, days: int = 7) -> DataFrame:
    """Exact distinct clients per window of ``days`` from (day, handle) pairs."""
    step = lambda k: F.make_interval(F.lit(0), F.lit(0), F.lit(0), k.cast("int"))
    return (pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
            .select((F.col("day") - step(F.col("k"))).alias("window_start"), "handle").distinct()
            .groupBy("window_start").agg(F.count(F.lit(1)).alias("clients"))
            .select("window_start", (F.col("window_start") + step(F.lit(days))).alias("window_end"), "clients"))


def sessions(spark: SparkSession, sf_dir: str, watermark: str = "1 hour", mode: str = "append"):
    """T5: per-user sessions closed by 900 s of inactivity.

    ``append`` writes a session once the watermark (newest event minus the
    delay) has passed its end; sessions that are still open are not in the
    sink yet.  ``complete`` keeps every session as state (a parity form)."""
    ev = read_stream_table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    agg = (ev.withWatermark("ts", watermark)
           .groupBy("user_id", F.session_window("ts", f"{GAP_SECONDS} seconds").alias("s"))
           .agg(F.count(F.lit(1)).alias("events")))
    return agg.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                      F.col("s.end").cast("timestamp_ntz").alias("session_end"), "events"), mode, None


# ------------------------------------------------------------------ T2, T3, T5, whenever rows arrive
def _trend_rows(sales: DataFrame) -> DataFrame:
    paid = sales.where(is_paid() & F.col("sale_date").isNotNull())
    return paid.groupBy(F.col("sale_date").cast("date").alias("sale_day")).agg(
        F.sum("paid").alias("gross"), F.sum(F.col("paid") - F.col("cost") - F.col("courier")).alias("profit"))


TREND = Mergeable(
    _trend_rows,
    lambda p: p.groupBy("sale_day").agg(*[F.sum(c).cast(p.schema[c].dataType).alias(c) for c in ("gross", "profit")]),
    lambda p: p.select("sale_day", F.col("gross").cast("double").alias("gross_revenue"), F.col("profit").cast("double").alias("true_profit")))


def _client_days(sales: DataFrame) -> DataFrame:
    paid = sales.where(is_paid() & F.col("sale_date").isNotNull() & F.col("handle").isNotNull())
    return paid.select(F.date_trunc("day", "sale_date").cast("timestamp_ntz").alias("day"), "handle").distinct()


CLIENTS = Mergeable(_client_days, lambda p: p.distinct(), distinct_per_window)

#: T3 estimated: a sketch per day and batch instead of (day, handle) pairs.
CLIENT_SKETCHES = Mergeable(client_sketches, merge_sketches, sketched_clients)

#: The facts that every dashboard figure reads.
FACTS = Mergeable(sale_facts, merge_facts, lambda f: f)

SESSIONS = Mergeable(lambda e: stretches(e, "user_id", "ts"), merge_stretches, lambda p: stitch(p, "user_id"))


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    return read_stream_table(spark, sf_dir, "events", max_files=max_files).select("user_id", "ts")


# ------------------------------------------------------------------ T4
STOCK_KEYS = ["sku", "_bucket"]


def movement_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None, lineitem: DataFrame | None = None) -> DataFrame:
    """Stock movements as new lineitem files arrive, with their chunk (day and block of
    order keys) and its month.  ``lineitem``: another stream of that table."""
    li = lineitem if lineitem is not None else read_stream_table(spark, sf_dir, "lineitem", max_files=max_files)
    return chunked(fx.fx_movements(spark, sf_dir, lineitem=li), fx.order_block())


def chunked(moves: DataFrame, block: Column) -> DataFrame:
    """``block``: a coarsening of the movement order within a day, so that a SKU-day with
    many movements is several chunks."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return moves.withColumns({"day": day, "block": block, "month": F.trunc(F.col("ts").cast("date"), "month")})


def _chunks(moves: DataFrame) -> DataFrame:
    rows = moves.withColumn("_bucket", F.struct("day", "block"))
    return chunk_summary(rows, STOCK_KEYS, fx.MOVEMENT_ORDER)


def run_stock(spark: SparkSession, moves: DataFrame, name: str = "stock", **options) -> str:
    """T4: stock per SKU, never below 0, movements in event order whenever they arrive;
    equals the last ledger row (W3).  The sink holds one row per chunk (SKU, day,
    block), rebuilt from the log whenever a batch has movements of it."""
    return run_rebuilt(spark, moves, name, "month", ["sku", "day", "block"], STOCK_KEYS, _chunks, **options)


def read_stock(spark: SparkSession, out: str, moves: DataFrame) -> DataFrame:
    """Closing stock and number of movements of every SKU so far (``moves``: the stream)."""
    schema = _chunks(empty(spark, moves.schema)).schema
    return stock_now(read_rebuilt(spark, out, schema, STOCK_KEYS, {"_coarse": F.date_trunc("month", F.col("_bucket.day"))}, ["sku"]))


def stock_now(chunks: DataFrame) -> DataFrame:
    """Closing stock and number of movements of every SKU out of chunks and their months."""
    return closing_stock(chunks, "sku")


# ------------------------------------------------------------------ T6
def sold_lines_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart lines of sales with readable items, as new lineitem files arrive."""
    return fx.fx_sold_lines(spark, sf_dir, read_stream_table(spark, sf_dir, "lineitem"))
