"""Apply each micro-batch's sold lines to the catalogue.

The catalogue is a base and a log of changes (``sources.changelog``): a batch
writes the rows of the SKUs it sold, as a transaction named by its batch id, so a
retried batch is applied once, and checkouts that change the catalogue meanwhile
are neither lost nor overwritten.  Successive floored deductions equal one floored
deduction of the summed quantity, so the final catalogue equals the batch
``stock_deduct`` over all lines.

Given its catalogue and checkpoint folders the stream resumes from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopfloor.operators.inventory import changed_by_sales, sku_key, sold_per_sku
from shopfloor.session import shared_dir
from shopfloor.sources.changelog import ChangeLog
from shopfloor.streaming.runner import REFRESH_TRIGGERS

VAULT_COLS = ["row_pos", "sku", "sourcing_price_text", "tags", "image_url", "standard_price_text",
              "vip_price_text", "clearance_price_text", "stock_text"]


def catalogue(spark: SparkSession, base: str) -> ChangeLog:
    return ChangeLog(spark, base, key=sku_key)


def apply_batch(log: ChangeLog, lines: DataFrame, batch_id: int, name: str) -> None:
    """The batch is read once: its sold quantities per SKU are kept for the
    test for rows and for the join."""
    sold = sold_per_sku(lines).persist()
    try:
        if not sold.isEmpty():
            log.commit(f"{name}-{batch_id}", lambda current: changed_by_sales(current, sold))
    finally:
        sold.unpersist()


def run_upsert(spark: SparkSession, vault: DataFrame, lines_stream: DataFrame, name: str = "stock_upsert",
               trigger: dict | str | None = None, base: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run to the end of the input (or until stopped) and return the newest
    catalogue.  ``vault`` is the catalogue to start from; a ``base`` that
    already has one goes on from it.  ``name`` tells several streams on one
    catalogue apart."""
    if (base is None) != (checkpoint is None):
        raise ValueError("base and checkpoint must be given together")
    base = base or shared_dir(spark, "vault", name)
    log = catalogue(spark, base)
    log.create(vault.select(*VAULT_COLS))
    if isinstance(trigger, str):
        trigger = REFRESH_TRIGGERS[trigger]
    q = (lines_stream.select("sku", "quantity").writeStream.queryName(f"{name}_{base.rstrip('/').rsplit('/', 1)[-1]}")
         .option("checkpointLocation", checkpoint or shared_dir(spark, "ckpt", name))
         .trigger(**(trigger or {"availableNow": True}))
         .foreachBatch(lambda b, bid: apply_batch(log, b, bid, name)).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return log.read()
