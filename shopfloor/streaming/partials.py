"""Streams whose results do not depend on when rows arrive.

The reference recounts every sale at each refresh, so a back-dated row is never
lost.  Here every micro-batch is reduced to partial aggregates that can be merged
in any order (sums, counts, least, greatest), which are written under its batch
id; the result is the merge of all batches.  Rows of any age count, no state
store grows and no watermark drops anything: a late row is a partial row of an
old key.  A batch costs its own rows only.

``COMPACT_EVERY`` batches are merged into one snapshot, so a reader takes one
snapshot and a few batches.  A batch that is tried again overwrites its own
folder, so each row counts once.

Results that need all rows of a group in order (stock, T4) are not mergeable:
those streams keep the rows in a log laid out by month, and rebuild the chunks
that a batch touches from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.sources.tables import empty, read_table, write_snapshot
from shopfloor.streaming.runner import COMPACT_EVERY, merge_update, run_batches, since_snapshot


@dataclass(frozen=True)
class Mergeable:
    """An aggregate of rows that can be merged: ``reduce`` takes rows of the stream to
    partial rows, ``merge`` partial rows to one row a key, ``finish`` merged rows to the result."""

    reduce: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def _merged(spark: SparkSession, out: str, agg: Mergeable, upto: int | None = None) -> DataFrame | None:
    folders = since_snapshot(spark, out, upto)
    if not folders:
        return None
    return agg.merge(spark.read.schema(read_table(spark, folders[0]).schema).parquet(*folders))


def run_mergeable(spark: SparkSession, stream: DataFrame, name: str, agg: Mergeable, keys: list[str] | None = None,
                  trigger: dict | str | None = None, checkpoint: str | None = None, output: str | None = None) -> str:
    """Run ``stream`` and return its output folder.  With ``keys`` each batch also
    notes the keys whose results it corrects (``read_corrections``)."""
    def write(b: DataFrame, bid: int, out: str) -> None:
        write_snapshot(agg.reduce(b), f"{out}/batches", bid)
        if keys:
            _note_corrections(spark, out, agg, keys, bid)
        if bid % COMPACT_EVERY == COMPACT_EVERY - 1:
            write_snapshot(_merged(spark, out, agg, bid), f"{out}/merged", bid)

    return run_batches(spark, stream, name, write, trigger, checkpoint, output)


def read_mergeable(spark: SparkSession, out: str, stream: DataFrame, agg: Mergeable) -> DataFrame:
    """The result over all batches so far; an empty frame before the first."""
    merged = _merged(spark, out, agg)
    if merged is None:
        merged = agg.merge(agg.reduce(empty(spark, stream.schema)))
    return agg.finish(merged)


def _note_corrections(spark: SparkSession, out: str, agg: Mergeable, keys: list[str], bid: int) -> None:
    before = _merged(spark, out, agg, bid - 1) if bid else None
    if before is None:
        return
    touched = read_table(spark, f"{out}/batches/v={bid:012d}").select(*keys).distinct()
    old = agg.finish(before.join(touched, keys, "left_semi"))
    new = agg.finish(_merged(spark, out, agg, bid).join(touched, keys, "left_semi"))
    values = [c for c in new.columns if c not in keys]
    noted = (new.join(old.withColumnsRenamed({c: f"old_{c}" for c in values}), keys)
             .withColumn("batch", F.lit(bid).cast("bigint")))
    write_snapshot(noted, f"{out}/corrections", bid)


def read_corrections(spark: SparkSession, out: str) -> DataFrame | None:
    """Every result that a later batch changed: keys, new and old values, and the batch."""
    from shopfloor.sources.tables import versions
    folders = [f"{out}/corrections/v={v:012d}" for v in versions(spark, f"{out}/corrections")]
    return spark.read.parquet(*folders) if folders else None


def run_rebuilt(spark: SparkSession, stream: DataFrame, name: str, month: str, touched: list[str], keys: list[str],
                rebuild: Callable[[DataFrame], DataFrame], trigger: dict | str | None = None,
                checkpoint: str | None = None, output: str | None = None) -> str:
    """Run ``stream``, keep its rows in a log by ``month`` (a date column of it), and
    rebuild every group that a batch touches.

    ``touched``: the columns of the groups, each within one month; ``rebuild`` takes
    all rows of the touched groups to one row for each of ``keys``.  The log is
    read for the touched months only."""
    schema = T.StructType([f for f in stream.schema.fields])

    def write(b: DataFrame, bid: int, out: str) -> None:
        log = f"{out}/log"
        # rebalanced: a file a month, more for a month with many rows
        b.hint("rebalance", month).write.mode("overwrite").partitionBy(month).parquet(f"{log}/v={bid:012d}")
        own = read_table(spark, f"{log}/v={bid:012d}", schema)
        for c in (month, *touched):  # rows without a group belong to none
            own = own.where(F.col(c).isNotNull())
        rows = own  # every group of the batch is touched, so only older rows are picked by a join
        if bid:
            months = [r[0] for r in own.select(month).distinct().collect()]  # calendar months, not rows
            # only batches up to this one: a batch that is tried again sees the same log
            older = spark.read.schema(schema).option("basePath", log).parquet(*[f"{log}/v={v:012d}" for v in range(bid)]).drop("v")
            groups = own.select(month, *touched).distinct()
            rows = own.unionByName(older.where(F.col(month).isin(months)).join(groups, [month, *touched], "left_semi"))
        merge_update(spark, rebuild(rows), bid, out, keys)

    return run_batches(spark, stream, name, write, trigger, checkpoint, output)


def read_rebuilt(spark: SparkSession, out: str, schema: T.StructType, keys: list[str], coarse: dict[str, Column],
                 by: list[str]) -> DataFrame:
    """Newest row of each of ``keys`` that ``run_rebuilt`` has written so far, with the columns
    ``coarse`` (functions of the keys), dealt by those and ``by`` (some of the keys), so that what
    groups by them next moves no rows.  Each batch has one row a key: one batch is read as it is."""
    full = T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())])
    folders = since_snapshot(spark, out)
    if not folders:
        return empty(spark, schema).withColumns(coarse)
    rows = spark.read.schema(full).parquet(*folders).withColumns(coarse)
    if len(folders) == 1:
        return rows.drop("_batch")
    values = [f.name for f in schema.fields if f.name not in keys]
    newest = (rows.repartition(*by, *coarse).groupBy(*by, *coarse, *[k for k in keys if k not in by])
              .agg(F.max_by(F.struct(*values), "_batch").alias("_v")))
    return newest.select(*keys, *coarse, *[F.col("_v")[c].alias(c) for c in values])
