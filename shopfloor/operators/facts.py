"""One pass over sales from which every dashboard figure reads.

A paid sale becomes three kinds of rows: its date, its client, and one per line item.
They are aggregated together by what they are about, so sales are scanned, and their JSON
is parsed, once for the whole dashboard, and what is left is small: a row per sale date,
per handle and per category.  The rows merge in any order (sums, counts, greatest, or),
so they can also be kept up to date batch by batch (``FACTS`` in ``streaming.queries``).

A client is recent if their newest paid sale is: that needs the greatest date per handle
only, whatever the window.  Only paid sales count anywhere, and the legacy status that
switches the CAC engine on is itself a paid one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.text import MONEY
from shopfloor.operators import clients, finance
from shopfloor.operators.cleaning import is_paid
from shopfloor.operators.items import FIELDS, display_category, parse_items, quantity

DATE, CLIENT, LINE = "date", "client", "line"
KEYS = ["kind", "sale_date", "handle", "category", "display_category"]
FACT = ("kind string, sale_date timestamp, handle string, category string, details string, "
        f"paid {MONEY}, profit_with_courier {MONEY}, profit {MONEY}, sales bigint, orders bigint, legacy boolean, "
        "newest timestamp, quantity double")


def sale_facts(sales: DataFrame) -> DataFrame:
    """The merged fact rows of normalised sales with their line items."""
    spread = sales.where(is_paid()).select(F.inline_outer(_facts_of_a_sale()))
    shown = F.when(F.col("kind") == LINE, display_category())
    return merge_facts(spread.withColumn("display_category", shown))


def _facts_of_a_sale() -> Column:
    """Array of the rows that one paid sale gives."""
    names = [f.split()[0] for f in FACT.split(", ")]

    def row(kind: str, **values) -> Column:
        return F.struct(*[values.get(n, F.lit(kind) if n == "kind" else F.lit(None)).alias(n) for n in names])

    with_courier = F.col("paid") - F.col("cost") - F.col("courier")
    legacy = F.col("payment_status") == finance.LEGACY_PAID_STATUS
    date = row(DATE, sale_date=F.col("sale_date"), paid=F.col("paid"), profit_with_courier=with_courier,
               sales=F.lit(1), legacy=legacy)
    client = row(CLIENT, handle=F.col("handle"), paid=F.col("paid"), profit=F.col("paid") - F.col("cost"),
                 sales=F.lit(1), orders=F.col("sale_ts_text").isNotNull().cast("bigint"), newest=F.col("sale_date"))
    items = F.coalesce(parse_items(columns=["category", "details", "quantity"]), F.array())
    as_array = f"array<struct<{FACT.replace(' ', ':').replace(',:', ',')}>>"
    lines = F.transform(items, lambda x: row(LINE, category=x[FIELDS["category"]], details=x[FIELDS["details"]],
                                             quantity=x[FIELDS["quantity"]]))
    return F.concat(F.array(date, client).cast(as_array), lines.cast(as_array))


def merge_facts(facts: DataFrame) -> DataFrame:
    """One row per key out of several.  Hot clients and categories collapse before the shuffle."""
    return facts.groupBy(*KEYS).agg(
        *[F.sum(c).cast(MONEY).alias(c) for c in ("paid", "profit_with_courier", "profit")],
        F.sum("sales").alias("sales"), F.sum("orders").alias("orders"), F.bool_or("legacy").alias("legacy"),
        F.max("newest").alias("newest"), F.sum(quantity()).alias("quantity"))


def _of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def client_value(facts: DataFrame) -> DataFrame:
    """A10/F19 out of facts."""
    known = _of(facts, CLIENT).where(F.col("handle").isNotNull())
    return clients.valued(known.groupBy("handle").agg(F.sum("orders").alias("total_orders"), F.sum("paid").alias("spend_dec"),
                                                      F.sum("profit").alias("profit_dec")))


def daily_trend(facts: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """A8 out of facts."""
    recent = _of(facts, DATE).where(F.col("sale_date") >= finance.days_before(as_of, days))
    return (recent.groupBy(F.col("sale_date").cast("date").alias("sale_day"))
            .agg(F.sum("paid").cast("double").alias("gross_revenue"),
                 F.sum("profit_with_courier").cast("double").alias("true_profit")))


def category_mix(facts: DataFrame) -> DataFrame:
    """A9/W4 out of facts."""
    return finance.category_shares(_of(facts, LINE).groupBy("display_category").agg(F.sum("quantity").alias("quantity")))


def recent_clients(facts: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """A5 out of facts: one row, clients whose newest paid sale is in the window."""
    recent = F.col("newest") >= finance.days_before(as_of, days)
    return _of(facts, CLIENT).where(F.col("handle").isNotNull() & recent).agg(F.count_distinct("handle").alias("new_clients"))


def months(facts: DataFrame) -> DataFrame:
    """Input of ``finance.month_rollup`` out of facts."""
    dated = F.col("sale_date").isNotNull()
    return _of(facts, DATE).select(
        F.trunc(F.col("sale_date").cast("date"), "month").alias("month"), F.when(dated, F.col("paid")).alias("revenue"),
        F.when(dated, F.col("sales")).otherwise(0).alias("sales"), F.col("paid").alias("all_rev"),
        F.col("profit_with_courier").alias("all_profit"), "legacy")


def weekly_summary(facts: DataFrame, purchases: DataFrame, as_of: Column, weekly_spend: float) -> DataFrame:
    """F10/A14 out of facts and the purchases."""
    return finance.summary_row(finance.month_rollup(months(facts)), recent_clients(facts, as_of),
                               finance.top_category(_of(facts, LINE)), finance.dead_stock(purchases, as_of), weekly_spend)


def frames(facts: DataFrame, purchases: DataFrame, as_of: Column, weekly_spend: float) -> dict[str, DataFrame]:
    """Every dataset of the profitability and client views."""
    values = client_value(facts)
    return {
        "summary": weekly_summary(facts, purchases, as_of, weekly_spend),
        "daily_trend": daily_trend(facts, as_of),
        "category_mix": category_mix(facts),
        "client_value": values.orderBy(F.col("lifetime_spend").desc(), F.col("handle")),
        "top_clients": clients.top_clients(values),
        "repeat_rate": clients.repeat_rate(values),
    }


def stacked(frames: dict[str, DataFrame]) -> DataFrame:
    """The frames under each other: frame, item, three numbers and a label."""
    shape = {
        "summary": (F.lit(""), "realised_revenue", "true_profit", "dead_stock_capital", F.col("summary")),
        "daily_trend": (F.col("sale_day").cast("string"), "gross_revenue", "true_profit", None, F.lit(None)),
        "category_mix": (F.col("display_category"), "quantity", "share", None, F.lit(None)),
        "client_value": (F.col("handle"), "total_orders", "lifetime_spend", "total_profit", F.col("client_status")),
        "top_clients": (F.col("handle"), "total_orders", "lifetime_spend", "total_profit", F.col("client_status")),
        "repeat_rate": (F.lit(""), "repeat_buyers", "total_clients", "repeat_rate_pct", F.lit(None)),
    }
    out = None
    for name, df in frames.items():
        item, *values, label = shape[name]
        numbers = [(F.lit(None) if v is None else F.col(v)).cast("double").alias(f"v{i}") for i, v in enumerate(values, 1)]
        part = df.select(F.lit(name).alias("frame"), item.alias("item"), *numbers, label.cast("string").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out
