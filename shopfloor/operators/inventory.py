"""Stock movements against the catalogue (K1-K3, K6, N9, P7f, W3).

The reference deducts cell by cell through remote calls; here every change
is a set-based join of the catalogue with a pre-aggregated request table,
producing the next catalogue snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions.text import clean_text
from shopfloor.operators.cleaning import stock_value
from shopfloor.sources.tables import stage_parts


def sellable_lines(lines: DataFrame) -> DataFrame:
    """P7f: SKU non-blank and not ``N/A`` (any case); ``int(qty) > 0``."""
    sku = clean_text(F.col("sku"))
    qty = F.col("quantity").try_cast("bigint")
    return (lines.select("*", sku.alias("sku_key"), qty.alias("qty"))
            .where((F.col("sku_key") != "") & (F.upper("sku_key") != "N/A") & (F.col("qty") > 0)))


def _new_text(changed: Column, new_value: Column, old_text: Column) -> Column:
    return F.when(changed, new_value.cast("string")).otherwise(old_text)


def sold_per_sku(lines: DataFrame) -> DataFrame:
    """Sold quantity per SKU (fixes Q7/Q8: one deduction of the total equals
    successive floored deductions): one row per SKU whatever the skew."""
    return sellable_lines(lines).groupBy("sku_key").agg(F.sum("qty").alias("sold_qty"))


def _deducted(vault: DataFrame, sold: DataFrame, how: str = "left") -> tuple[DataFrame, Column]:
    """The catalogue joined to the sold quantities, and the new stock text.  A key that is
    stored with the catalogue is used as it is, so that its buckets are."""
    keyed = vault if "sku_key" in vault.columns else vault.withColumn("sku_key", clean_text(F.col("sku")))
    j = keyed.join(sold, "sku_key", how)
    cur = stock_value("stock_text", bad_as_zero=False)
    changed = F.col("sold_qty").isNotNull() & cur.isNotNull()
    new = F.greatest(F.lit(0).cast("bigint"), cur - F.col("sold_qty"))
    return j, _new_text(changed, new, F.col("stock_text"))


def stock_deduct(vault: DataFrame, lines: DataFrame) -> DataFrame:
    """K1: ``new = max(0, stock - sold)`` per SKU.

    Every catalogue row with a sold SKU is updated; junk stock text is left
    alone; unknown SKUs are ignored."""
    return deduct_sold(vault, sold_per_sku(lines))


def deduct_sold(vault: DataFrame, sold: DataFrame) -> DataFrame:
    """K1 with the sold quantity per SKU given (``sold_per_sku``)."""
    key = [c for c in vault.columns if c == "sku_key"]
    j, new_text = _deducted(vault.select("row_pos", "sku", "stock_text", *key), sold)
    return j.select("row_pos", "sku", F.col("stock_text").alias("old_stock_text"),
                    F.coalesce("sold_qty", F.lit(0).cast("bigint")).alias("sold_qty"),
                    new_text.alias("new_stock_text"))


def next_catalogue(vault: DataFrame, sold: DataFrame, how: str = "left") -> DataFrame:
    """K1 as the next catalogue: all columns, stock text replaced, one join.
    ``sold``: ``sold_per_sku``."""
    j, new_text = _deducted(vault, sold, how)
    return j.select(*[new_text.alias(c) if c == "stock_text" else F.col(c) for c in vault.columns])


def changed_by_sales(vault: DataFrame, sold: DataFrame) -> DataFrame:
    """K1 as a change: all rows of the sold SKUs with their new stock, and no others.
    ``sold`` has one row per SKU, so one join both picks the rows and gives their quantities,
    and the lines behind ``sold`` are summed once."""
    return next_catalogue(vault, sold, "inner")


def sku_key() -> Column:
    """The key by which the catalogue changes; null for rows without a SKU."""
    return clean_text(F.col("sku"))


def restock(vault: DataFrame, requests: DataFrame) -> DataFrame:
    """K2: add positive quantities per SKU (qty <= 0 is a no-op); blank or
    junk stock counts as 0 when restocking."""
    add = (requests.where(F.col("qty") > 0)
           .groupBy(clean_text(F.col("sku")).alias("sku_key")).agg(F.sum("qty").alias("added_qty")))
    v = vault.select("row_pos", "sku", "stock_text", clean_text(F.col("sku")).alias("sku_key"))
    j = v.join(add, "sku_key", "left")
    new = stock_value("stock_text", bad_as_zero=True) + F.col("added_qty")
    return j.select("row_pos", "sku", F.col("stock_text").alias("old_stock_text"),
                    F.coalesce("added_qty", F.lit(0).cast("bigint")).alias("added_qty"),
                    _new_text(F.col("added_qty").isNotNull(), new, F.col("stock_text")).alias("new_stock_text"))


def changed_by_restock(vault: DataFrame, requests: DataFrame) -> DataFrame:
    """K2 as a change: the rows of the restocked SKUs with their new stock, and no others."""
    add = (requests.where(F.col("qty") > 0)
           .groupBy(clean_text(F.col("sku")).alias("sku_key")).agg(F.sum("qty").alias("added_qty")))
    j = vault.withColumn("sku_key", clean_text(F.col("sku"))).join(add, "sku_key")
    new = (stock_value("stock_text", bad_as_zero=True) + F.col("added_qty")).cast("string")
    return j.select(*[new.alias(c) if c == "stock_text" else F.col(c) for c in vault.columns])


def restock_rejects(vault: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (qty > 0) whose SKU is not in the catalogue: reported failures."""
    keys = vault.select(clean_text(F.col("sku")).alias("sku_key")).distinct()
    req = requests.where(F.col("qty") > 0).withColumn("sku_key", clean_text(F.col("sku")))
    return req.join(keys, "sku_key", "left_anti").select("sku", "qty")


def delete_items(vault: DataFrame, deletes: DataFrame) -> DataFrame:
    """Catalogue without the listed SKUs (an absent SKU is a no-op)."""
    keys = deletes.select(clean_text(F.col("sku")).alias("sku_key")).distinct()
    return (vault.withColumn("sku_key", clean_text(F.col("sku")))
            .join(keys, "sku_key", "left_anti").drop("sku_key"))


def deleted_items(vault: DataFrame, deletes: DataFrame) -> DataFrame:
    """K3/S6 as a change: the rows of the listed SKUs, marked as deleted."""
    keys = deletes.select(clean_text(F.col("sku")).alias("sku_key"))
    return (vault.join(keys, clean_text(F.col("sku")) == F.col("sku_key"), "left_semi").withColumn("_deleted", F.lit(True)))


def unmatched_lines(vault: DataFrame, lines: DataFrame) -> DataFrame:
    """K6: sellable lines whose SKU has no catalogue row (skipped by deduct)."""
    keys = vault.select(clean_text(F.col("sku")).alias("sku_key")).distinct()
    return (sellable_lines(lines).join(keys, "sku_key", "left_anti")
            .select("row_pos", "line_no", "sku", "quantity"))


def floor_ledger(moves: DataFrame, key: str, order: list[str], buckets: list[Column], coarse: Column,
                 delta: str = "delta", opening: str = "s0") -> DataFrame:
    """Stock after every movement, never below 0.

    ``s_n = max(0, s_{n-1} + d_n)`` equals ``x_n - min(0, min_{j<=n} x_j)``
    with ``x`` the unfloored running total from a non-negative opening stock
    (Q19 clamps it).  Running sums and minima compose across chunks, so no
    single key has to sit in one task:

    1. rows are dealt by ranges of (key, ``buckets``) -- which must be a
       coarsening of a prefix of ``order`` (e.g. the day, a block of order keys)
       -- and written once in these parts.  A hot key spans several parts, and
       a bucket lies in one;
    2. each (key, part) is scanned in ``order``, without moving its rows again;
    3. one summary row per (key, part) (total, minimum) is scanned per key.  What
       is carried into a part is joined back for keys in several parts only:
       at most two rows a part, whatever the size of the input.

    Rows whose ``coarse`` (e.g. the month) is null, those without a time, count
    before all others and get no row themselves.  A movement without ``delta`` has
    no stock until its bucket has seen one.
    """
    parts = moves.withColumn("_kept", coarse.isNotNull()).repartitionByRange(F.col(key), *buckets)
    rows = stage_parts(parts.withColumn("_part", F.spark_partition_id()), "ledger", "_part", [key, *order])
    bucket = F.struct(*buckets)
    whole = Window.partitionBy(key, "_part")
    w = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("bigint")
    loc = rows.withColumn("_loc", F.sum(delta).over(w)).withColumn("_locmin", F.min("_loc").over(w))
    summary = loc.groupBy(key, "_part").agg(F.sum(delta).alias("_tot"), F.min("_loc").alias("_low"), F.max(opening).alias("_s0"))
    several = (chunk_carry(summary, key, "_part").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
               .where(F.col("_n") > 1).select(F.col(key).alias("_key"), F.col("_part").alias("_in"), "_off", "_carry"))
    seen = F.max(F.when(F.col(delta).isNotNull(), bucket)).over(w).eqNullSafe(bucket)
    j = (loc.withColumns({"_seen": seen, "_start": F.greatest(F.max(opening).over(whole), zero)})
         .where(F.col("_kept") & F.col(key).isNotNull())
         .join(F.broadcast(several), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_in")), "left"))
    off = F.coalesce("_off", "_start")
    stock = off + F.col("_loc") - F.least(zero, "_carry", off + F.col("_locmin"))
    return j.select(*[c for c in moves.columns], F.when(F.col("_seen"), stock).alias("stock"))


def chunk_summary(moves: DataFrame, keys: list[str], order: list[str], delta: str = "delta", opening: str = "s0") -> DataFrame:
    """One row per chunk (``keys``): total, least running total, opening stock and number
    of its movements in ``order``; a window and an aggregate over one shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (moves.withColumn("_loc", F.sum(delta).over(w)).groupBy(*keys)
            .agg(F.sum(delta).alias("_tot"), F.min("_loc").alias("_low"), F.count(F.lit(1)).alias("_n"), F.max(opening).alias("_s0")))


def chunk_carry(summary: DataFrame, key: str, chunk: str) -> DataFrame:
    """Running total (``_off``, from the opening stock) and running minimum
    (``_carry``, null at first) before every chunk.

    ``summary``: one row per (key, chunk) with ``_tot`` (total of the chunk),
    ``_low`` (its least running total) and ``_s0`` (opening stock), in the order of
    ``chunk``, of which a key must have few (parts, months)."""
    zero = F.lit(0).cast("bigint")
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(F.max("_s0").over(Window.partitionBy(key)), zero)
    return (summary.withColumn("_off", start + F.coalesce(F.sum("_tot").over(before), zero))
            .withColumn("_carry", F.min(F.col("_off") + F.col("_low")).over(before)))


def closing_stock(summary: DataFrame, key: str) -> DataFrame:
    """Last stock and number of movements of every key from its chunks (``chunk_summary``
    with ``_bucket`` and ``_coarse``, a coarsening of the buckets, e.g. the month).

    Chunks are merged to one row per (key, ``_coarse``) and those to one per key; only
    the last stock is asked for, so nothing is joined back to the chunks.  Chunks without
    ``_coarse`` count before all others but aren't a key's last and aren't counted."""
    zero = F.lit(0).cast("bigint")
    before = Window.partitionBy(key, "_coarse").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inner = summary.withColumn("_in", F.coalesce(F.sum("_tot").over(before), zero))
    outer = inner.groupBy(key, "_coarse").agg(
        F.sum("_tot").alias("_tot"), F.min(F.col("_in") + F.col("_low")).alias("_low"), F.max("_s0").alias("_s0"),
        F.sum("_n").alias("_n"), F.max_by(F.col("_tot").isNotNull(), "_bucket").alias("_known"))
    c = chunk_carry(outer, key, "_coarse").where(F.col(key).isNotNull() & F.col("_coarse").isNotNull())
    end = F.when(F.col("_known"), F.col("_off") + F.col("_tot"))
    return (c.groupBy(key)
            .agg(F.max_by(end, "_coarse").alias("_end"), F.min(F.least("_carry", F.col("_off") + F.col("_low"))).alias("_min"),
                 F.sum("_n").alias("movements"))
            .select(key, (F.col("_end") - F.least(zero, "_min")).alias("closing_stock"), "movements"))
