"""The reference's two user-level flows, composed from the operators.

* ``dashboard`` (E1): one pass over the sales feeding every KPI and chart
  dataset of the profitability and client views.
* ``checkout`` (E2): a batch of carts becomes sale rows and a change of the
  catalogue with the sold quantities deducted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from shopfloor.operators import facts, inventory
from shopfloor.operators.cleaning import normalize_purchases, normalize_sales
from shopfloor.operators.sales_log import build_sales
from shopfloor.sources.changelog import ChangeLog
from shopfloor.sources.tables import file_system, read_table, stage


def dashboard(raw_sales: DataFrame, raw_purchases: DataFrame, as_of: Column,
              weekly_spend: float) -> dict[str, DataFrame]:
    """Every dataset of the profitability and client views.

    Sales are read once: their facts (``operators.facts``) are written, and every
    dataset reads that small table."""
    kept = stage(facts.sale_facts(normalize_sales(raw_sales)), "facts")
    return facts.frames(kept, normalize_purchases(raw_purchases), as_of, weekly_spend)


def checkout(spark: SparkSession, cart_lines: DataFrame, headers: DataFrame, sales_path: str,
             vault_base: str, batch_id: int, pii_key: Column) -> tuple[DataFrame, DataFrame]:
    """Write the carts as sale rows and deduct them from the catalogue (a
    ``ChangeLog`` under ``vault_base``), under the caller's ``batch_id``; name and
    handle are protected with ``pii_key``.

    Sale rows go to the folder of their batch and the deduction is one transaction
    of the catalogue, so a retry of a batch changes nothing, batches come in any
    order, and two at once both count.  The deduction uses the summed quantity per
    SKU (one floored deduction equals the reference's successive ones).  Returns
    (sale rows, catalogue)."""
    log = ChangeLog(spark, vault_base, key=inventory.sku_key)
    if log.version() < 0:
        raise ValueError(f"no catalogue under {vault_base}")
    folder = f"{sales_path.rstrip('/')}/batch_id={batch_id}"
    rows = build_sales(cart_lines, headers, pii_key=pii_key)
    fs, done = file_system(spark, f"{folder}/_SUCCESS")
    if not fs.exists(done):
        rows.write.mode("overwrite").parquet(folder)
    sold = inventory.sold_per_sku(cart_lines)
    log.commit(f"checkout-{batch_id}", lambda current: inventory.changed_by_sales(current, sold))
    return read_table(spark, folder, rows.schema), log.read()
