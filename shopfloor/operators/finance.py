"""Financial KPIs and chart datasets (A1-A9, A14, W1, W4, P2f-P3f, F1, F9, F10).

All inputs are normalised sales (``operators.cleaning.normalize_sales``).
Money is aggregated in decimal and cast to double at the edge; every ratio
divides doubles, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions.text import format_money
from shopfloor.operators.cleaning import is_paid
from shopfloor.operators.items import display_category, quantity

# Fixed value that must equal the reference: the legacy status whose
# presence enables the CAC / month-over-month engine (quirk Q1).
LEGACY_PAID_STATUS = "Paid (UPI/Bank)"
# Spend above this raises the "exceptionally high" warning (one lakh).
HIGH_SPEND = 100000.0


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days))


def sale_profit(sales: DataFrame) -> DataFrame:
    """profit with courier (KPIs, trend) and without (client value)."""
    return sales.select(
        "row_pos",
        (F.col("paid") - F.col("cost") - F.col("courier")).cast("double").alias("profit_with_courier"),
        (F.col("paid") - F.col("cost")).cast("double").alias("profit_without_courier"),
    )


def kpi_financial(sales: DataFrame) -> DataFrame:
    """A1/A2: realised revenue and true net profit over paid sales."""
    return (sales.where(is_paid())
            .agg(F.coalesce(F.sum("paid"), F.lit(0)).cast("double").alias("realised_revenue"),
                 F.coalesce(F.sum(F.col("paid") - F.col("cost") - F.col("courier")), F.lit(0)).cast("double")
                 .alias("true_profit"),
                 F.count(F.lit(1)).alias("paid_sales")))


def top_category(paid_lines: DataFrame) -> DataFrame:
    """A3: raw category with the largest total quantity; ties go to the
    alphabetically first; null categories are dropped; none -> ``N/A``."""
    per_cat = (paid_lines.where(F.col("category").isNotNull())
               .groupBy("category").agg(F.sum(quantity()).alias("qty")))
    best = per_cat.agg(F.min_by("category", F.struct(-F.col("qty"), F.col("category"))).alias("top"))
    return best.select(F.coalesce("top", F.lit("N/A")).alias("top_category"))


def dead_stock(purchases: DataFrame, as_of: Column, days: int = 45) -> DataFrame:
    """A4: capital in purchases older than ``days`` (null dates excluded)."""
    old = purchases.where(F.col("purchase_date") < days_before(as_of, days))
    return old.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("dead_stock_capital"),
                   F.count(F.lit(1)).alias("old_purchases"))


def recent_sales(sales: DataFrame, as_of: Column, days: int) -> DataFrame:
    """P3f: paid sales dated within ``days`` before ``as_of`` (no upper bound)."""
    return sales.where(is_paid() & (F.col("sale_date") >= days_before(as_of, days)))


def recent_clients(sales: DataFrame, as_of: Column, approximate: bool = False, days: int = 7) -> DataFrame:
    """A5: one row, distinct handles of paid sales in the last ``days``.

    Exact: a grouped distinct of the *filtered* rows, counted (a
    ``count_distinct`` next to other sums would expand every sales row);
    ``approximate`` uses a HyperLogLog sketch."""
    recent = sales.where(is_paid() & (F.col("sale_date") >= days_before(as_of, days)) & F.col("handle").isNotNull())
    if approximate:
        return recent.agg(F.approx_count_distinct("handle").alias("new_clients"))
    return recent.select("handle").distinct().agg(F.count(F.lit(1)).alias("new_clients"))


def sales_kpis(sales: DataFrame, as_of: Column, weekly_spend: float, guard: bool = True,
               approximate: bool = False) -> DataFrame:
    """A1/A2/A5/A6/P2f: realised revenue, true profit, distinct recent
    clients, CAC and the legacy-status guard -- one aggregate pass plus the
    filtered distinct of ``recent_clients`` as a scalar subquery.

    Blank handles count as a client, null handles do not (Q4).  With
    ``guard`` (parity, Q1) clients and CAC are 0 unless the legacy status
    occurs somewhere."""
    paid = is_paid()
    n_clients = recent_clients(sales, as_of, approximate).scalar()
    agg = sales.agg(
        F.sum(F.when(paid, F.col("paid"))).alias("_rev"),
        F.sum(F.when(paid, F.col("paid") - F.col("cost") - F.col("courier"))).alias("_profit"),
        F.coalesce(F.bool_or(F.col("payment_status") == LEGACY_PAID_STATUS), F.lit(False)).alias("enabled"),
    ).withColumn("_n", n_clients)
    spend = F.lit(float(weekly_spend))
    on = F.col("enabled") if guard else F.lit(True)
    n = F.when(on, F.col("_n")).otherwise(F.lit(0).cast("bigint"))
    cac_v = F.when(~on, F.lit(0.0)).when(F.col("_n") > 0, spend / F.col("_n")).otherwise(spend)
    return agg.select(F.coalesce(F.col("_rev"), F.lit(0)).cast("double").alias("realised_revenue"),
                      F.coalesce(F.col("_profit"), F.lit(0)).cast("double").alias("true_profit"),
                      n.alias("new_clients"), cac_v.alias("cac"), "enabled")


def cac(sales: DataFrame, as_of: Column, weekly_spend: float, guard: bool = True,
        approximate: bool = False) -> DataFrame:
    """Distinct paid clients in the last 7 days and spend per client."""
    k = sales_kpis(sales, as_of, weekly_spend, guard, approximate)
    return k.select("new_clients", "cac", F.lit(float(weekly_spend)).alias("weekly_spend"))


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Paid revenue per calendar month of the sale date."""
    return (sales.where(is_paid() & F.col("sale_date").isNotNull())
            .groupBy(F.trunc(F.col("sale_date").cast("date"), "month").alias("month"))
            .agg(F.sum("paid").cast("double").alias("revenue"), F.count(F.lit(1)).alias("sales")))


def sales_rollup(sales: DataFrame, as_of: Column | None = None, days: int = 7) -> DataFrame:
    """One aggregate pass over sales, by month and -- with ``as_of`` -- by the
    handle of paid sales of the last ``days`` (null for all other rows, so
    the result has few rows): sums for the KPIs, the months and the clients."""
    paid = is_paid()
    dated = paid & F.col("sale_date").isNotNull()
    recent = F.lit(None).cast("string") if as_of is None else F.when(
        paid & (F.col("sale_date") >= days_before(as_of, days)), F.col("handle"))
    return (sales.groupBy(F.trunc(F.col("sale_date").cast("date"), "month").alias("month"), recent.alias("recent_handle"))
            .agg(F.sum(F.when(dated, F.col("paid"))).alias("revenue"),
                 F.count(F.when(dated, F.lit(1))).alias("sales"),
                 F.sum(F.when(paid, F.col("paid"))).alias("all_rev"),
                 F.sum(F.when(paid, F.col("paid") - F.col("cost") - F.col("courier"))).alias("all_profit"),
                 F.bool_or(F.col("payment_status") == LEGACY_PAID_STATUS).alias("legacy")))


def month_rollup(rollup: DataFrame) -> DataFrame:
    """One row from ``sales_rollup``: month-over-month growth (unguarded),
    number of present months, the legacy-status guard, and the realised
    revenue and true profit over all paid sales.

    Months are aggregated over *all* rows (the guard needs every status); a
    month is present when it has a dated paid sale; undated paid sales land
    in the null-month group, so the totals still include them.  The window
    runs over the monthly table (one row per calendar month, bounded by the
    date range), never over sales rows."""
    months = rollup.groupBy("month").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("sales").alias("sales"), F.sum("all_rev").alias("all_rev"),
        F.sum("all_profit").alias("all_profit"), F.bool_or("legacy").alias("legacy"))
    w = Window.partitionBy(F.lit(1)).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    present = F.col("sales") > 0
    prev = F.last(F.when(present, F.col("revenue")), ignorenulls=True).over(w)
    with_prev = months.select("*", present.alias("present"), prev.alias("prev"))
    last = with_prev.agg(
        F.max_by(F.struct("revenue", "prev"), F.when(F.col("present"), F.col("month"))).alias("m"),
        F.count(F.when(F.col("present"), F.lit(1))).alias("n"),
        F.coalesce(F.bool_or("legacy"), F.lit(False)).alias("enabled"),
        F.coalesce(F.sum("all_rev"), F.lit(0)).cast("double").alias("realised_revenue"),
        F.coalesce(F.sum("all_profit"), F.lit(0)).cast("double").alias("true_profit"))
    pct = F.try_divide(F.col("m.revenue"), F.col("m.prev"))
    growth = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(
        F.when(F.col("m.prev") == 0, F.lit(None).cast("double")).otherwise((pct - 1.0) * 100.0))
    return last.select(growth.alias("mom_growth_pct"), F.col("n").alias("months"), "enabled",
                       "realised_revenue", "true_profit")


def mom_growth(sales: DataFrame, guard: bool = True) -> DataFrame:
    """Growth of the last present month over the previous present month,
    in percent.  Fewer than two months -> 0; previous month 0 -> null (Q3);
    with ``guard`` 0 unless the legacy status occurs (Q1).  One pass."""
    r = month_rollup(sales_rollup(sales))
    growth = F.col("mom_growth_pct")
    if guard:
        growth = F.when(F.col("enabled"), growth).otherwise(F.lit(0.0))
    return r.select(growth.alias("mom_growth_pct"), "months")


def daily_trend(sales: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Gross revenue and true profit per sale date over the last ``days``."""
    recent = recent_sales(sales, as_of, days)
    return (recent.groupBy(F.col("sale_date").cast("date").alias("sale_day"))
            .agg(F.sum("paid").cast("double").alias("gross_revenue"),
                 F.sum(F.col("paid") - F.col("cost") - F.col("courier")).cast("double").alias("true_profit")))


def category_mix(paid_lines: DataFrame) -> DataFrame:
    """Quantity per display category (all time) and its share.

    The grand total is a scalar subquery over the per-category aggregate;
    at run time AQE reuses the aggregate's shuffle for it (``ReusedExchange``
    in the final plan), so the line-item pipeline runs once and no single
    task has to hold every category (a global window would)."""
    per = (paid_lines.select(display_category().alias("display_category"), "quantity")
           .groupBy("display_category").agg(F.sum(quantity()).alias("quantity")))
    return category_shares(per)


def category_shares(per: DataFrame) -> DataFrame:
    """The share of each category in the quantity of all."""
    total = per.agg(F.sum("quantity")).scalar()
    return per.select("display_category", "quantity", (F.col("quantity") / total).alias("share"))


def weekly_summary(sales: DataFrame, paid_lines: DataFrame, purchases: DataFrame, as_of: Column,
                   weekly_spend: float) -> DataFrame:
    """Every KPI in one row plus the rendered summary text.

    The four one-row aggregates -- the monthly rollup (revenue, profit,
    guard, MoM) and the distinct recent clients, both out of one pass over
    sales, the top category over line items and the dead stock over purchases
    -- are stacked as a union of one-row frames and collapsed by one final
    aggregate, so they run as concurrent stages of a single job."""
    rollup = sales_rollup(sales, as_of)
    recent = rollup.where(F.col("recent_handle").isNotNull()).select("recent_handle").distinct()
    return summary_row(month_rollup(rollup), recent.agg(F.count(F.lit(1)).alias("new_clients")),
                       top_category(paid_lines), dead_stock(purchases, as_of), weekly_spend)


def summary_row(months: DataFrame, new_clients: DataFrame, top: DataFrame, dead: DataFrame,
                weekly_spend: float) -> DataFrame:
    """The summary out of its four one-row parts: ``month_rollup``, recent clients, top
    category and dead stock."""
    parts = [
        (months, ("realised_revenue", "true_profit", "mom_growth_pct", "enabled")),
        (new_clients, ("new_clients",)),
        (top, ("top_category",)),
        (dead, ("dead_stock_capital",)),
    ]
    types = {c: t for df, have in parts for c, t in df.dtypes if c in have}
    stacked = None
    for df, have in parts:
        row = df.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in types.items()])
        stacked = row if stacked is None else stacked.unionByName(row)
    base = stacked.agg(*[F.max(c).alias(c) for c in types])  # one non-null value per column
    spend = F.lit(float(weekly_spend))
    on = F.col("enabled")
    n_clients = F.col("new_clients")
    one = base.select(
        "realised_revenue", "true_profit",
        F.when(on, n_clients).otherwise(F.lit(0).cast("bigint")).alias("new_clients"),
        F.when(~on, F.lit(0.0)).when(n_clients > 0, spend / n_clients).otherwise(spend).alias("cac"),
        F.when(on, F.col("mom_growth_pct")).otherwise(F.lit(0.0)).alias("mom_growth_pct"),
        "top_category", "dead_stock_capital")
    spend = F.lit(float(weekly_spend))
    cac_label = (F.when(spend > 0, F.concat(F.lit("₹"), format_money(F.col("cac"), 2)))
                 .otherwise(F.lit("₹0 ")))
    mom_txt = F.coalesce(format_money(F.col("mom_growth_pct"), 1), F.lit("nan"))
    # Fixed value that must equal the reference: the summary's wording.
    text = F.concat(
        F.lit("📊 *Weekly Operations Update*\n"),
        F.lit("Total Sales: ₹"), format_money(F.col("realised_revenue"), 0), F.lit("\n"),
        F.lit("True Profit: ₹"), format_money(F.col("true_profit"), 0), F.lit("\n"),
        F.lit("🚀 MoM Growth: "), mom_txt, F.lit("%\n"),
        F.lit("🎯 CAC: "), cac_label, F.lit("/client (₹"), format_money(spend, 2), F.lit(" total spend)\n"),
        F.lit("🔥 Top Performer: "), F.col("top_category"), F.lit("\n"),
        F.lit("⚠️ Note: You have ₹"), format_money(F.col("dead_stock_capital"), 0),
        F.lit(" tied up in stock older than 45 days. Consider discounting older pieces on the next live!"),
    )
    return one.select("realised_revenue", "true_profit", "top_category", "dead_stock_capital",
                      "new_clients", "cac", "mom_growth_pct",
                      (spend > HIGH_SPEND).alias("spend_warning"), text.alias("summary"))
