"""Client lifetime value, tiers and repeat buyers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.pii import unprotect_with
from shopfloor.operators.cleaning import is_paid

# Fixed values that must equal the reference: tier labels (with their
# emoji) and the strict ">" thresholds on lifetime spend and order count.
TIER_DIAMOND = "💎 Diamond VIP"
TIER_GOLD = "🥇 Gold Tier"
TIER_REPEAT = "⭐ Repeat Buyer"
TIER_NEW = "🆕 New Client"
DIAMOND_SPEND = 15000
GOLD_SPEND = 5000


def client_tier(spend="lifetime_spend", orders="total_orders", diamond=DIAMOND_SPEND, gold=GOLD_SPEND):
    s, o = F.col(spend), F.col(orders)
    return (F.when(s > diamond, F.lit(TIER_DIAMOND)).when(s > gold, F.lit(TIER_GOLD))
            .when(o > 1, F.lit(TIER_REPEAT)).otherwise(F.lit(TIER_NEW)))


def client_value(sales: DataFrame, sort: bool = True) -> DataFrame:
    """A10: per handle over paid sales -- order count (non-null timestamps),
    lifetime spend, profit without courier (Q5) and tier.

    Null handles are dropped (as a pandas group key); a blank handle is a
    client (Q4) and may be a hot key -- the partial (map-side) aggregate
    collapses it before the shuffle."""
    return _client_value(sales, "handle", lambda h: h, sort)


def protected_client_value(sales: DataFrame, ring: Column, index: str = "handle_index", sort: bool = True) -> DataFrame:
    """A10 over sales whose handle is protected and has a blind index: rows are grouped
    by the index, and one handle per client is decrypted, after the aggregate."""
    return _client_value(sales, index, lambda h: unprotect_with(h, ring), sort)


def _client_value(sales: DataFrame, key: str, shown: Callable[[Column], Column], sort: bool) -> DataFrame:
    some = [] if key == "handle" else [F.min("handle").alias("handle")]
    agg = (sales.where(is_paid() & F.col(key).isNotNull())
           .groupBy(key)
           .agg(F.count("sale_ts_text").alias("total_orders"),
                F.sum("paid").alias("spend_dec"),
                F.sum(F.col("paid") - F.col("cost")).alias("profit_dec"), *some))
    out = valued(agg, shown)
    return out.orderBy(F.col("lifetime_spend").desc(), F.col("handle")) if sort else out


def valued(per_client: DataFrame, shown: Callable[[Column], Column] = lambda h: h) -> DataFrame:
    """The columns of A10 out of one row per client with exact sums."""
    return per_client.select(shown(F.col("handle")).alias("handle"), "total_orders",
                             F.col("spend_dec").cast("double").alias("lifetime_spend"),
                             F.col("profit_dec").cast("double").alias("total_profit"),
                             client_tier(spend="spend_dec").alias("client_status"))


#: log2 of the registers of a client sketch, and its standard error.
SKETCH_LG = 12
SKETCH_ERROR = 0.83 / 2 ** (SKETCH_LG / 2)


def client_sketches(sales: DataFrame) -> DataFrame:
    """A HyperLogLog sketch of the paid handles of every sale day.  Sketches of days are
    stored and merge to any window, so no window reads sales again."""
    dated = sales.where(is_paid() & F.col("sale_date").isNotNull() & F.col("handle").isNotNull())
    return (dated.groupBy(F.date_trunc("day", "sale_date").cast("timestamp_ntz").alias("day"))
            .agg(F.hll_sketch_agg("handle", SKETCH_LG).alias("sketch")))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per day out of several."""
    return sketches.groupBy("day").agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_clients(sketches: DataFrame, days: int = 7) -> DataFrame:
    """Estimated distinct clients of every window of ``days``, from one sketch per day."""
    step = lambda k: F.make_interval(F.lit(0), F.lit(0), F.lit(0), k.cast("int"))
    return (sketches.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
            .groupBy((F.col("day") - step(F.col("k"))).alias("window_start"))
            .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
            .select("window_start", (F.col("window_start") + step(F.lit(days))).alias("window_end"), "estimate"))


def top_clients(values: DataFrame, n: int = 5) -> DataFrame:
    """H2: the ``n`` biggest spenders (ties by handle); planned as
    TakeOrderedAndProject, i.e. a per-partition top-n then a merge."""
    return values.orderBy(F.col("lifetime_spend").desc(), F.col("handle")).limit(n)


def repeat_rate(values: DataFrame) -> DataFrame:
    """Clients with more than one order and their share in percent."""
    agg = values.agg(F.count_if(F.col("total_orders") > 1).alias("repeat_buyers"),
                     F.count(F.lit(1)).alias("total_clients"))
    rate = F.when(F.col("total_clients") > 0,
                  F.col("repeat_buyers").cast("double") / F.col("total_clients").cast("double") * 100.0
                  ).otherwise(F.lit(0.0))
    return agg.select("repeat_buyers", "total_clients", rate.alias("repeat_rate_pct"))
