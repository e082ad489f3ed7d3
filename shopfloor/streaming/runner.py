"""Running a streaming query into files, and reading its sink.

* ``append`` results go to a Parquet file sink (exactly-once via the sink
  log);
* ``complete`` results are written by ``foreachBatch`` as a snapshot per
  batch id (a retried batch rewrites its own version only);
* ``update`` results are written per batch; every ``COMPACT_EVERY`` batches
  the newest row of each key goes into a snapshot, so a reader takes one
  snapshot and the few batches after it.

A stream that is given its checkpoint and output folders resumes from them:
started again it goes on where it stopped, without lost or doubled rows.
Without them it gets fresh folders (tests and the registered keys, which run
once with ``availableNow``).  ``trigger`` takes Spark's trigger arguments or
the name of a refresh policy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.session import shared_dir
from shopfloor.sources.tables import empty, file_system, latest_snapshot, versions, write_snapshot

# Refresh policy of the reference's caches, as production triggers (S7):
# dashboard tables every 600 s, the sales list every 60 s.
REFRESH_TRIGGERS = {
    "dashboard": {"processingTime": "600 seconds"},
    "sales": {"processingTime": "60 seconds"},
}
COMPACT_EVERY = 16


def read_stream_table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | None = None,
                      max_files: int | None = None) -> DataFrame:
    """Stream one table of a directory of Parquet tables, a folder of part
    files or a single file (declared schema: streaming sources never infer)."""
    base = sf_dir.rstrip("/")
    path = f"{base}/{name}.parquet"
    r = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    fs, p = file_system(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(base)  # a file source lists folders


def run_stream(spark: SparkSession, df: DataFrame, name: str, mode: str = "append",
               keys: list[str] | None = None, trigger: dict | str | None = None,
               wait: bool = True, partition_by: list[str] | None = None,
               checkpoint: str | None = None, output: str | None = None) -> str:
    """Start ``df`` with output ``mode`` and return the output folder.

    ``checkpoint`` and ``output`` belong together: give both to resume.
    ``partition_by`` (append mode) lays the file sink out by those columns,
    so later date filters prune whole folders."""
    w, out = _writer(spark, df, name, trigger, checkpoint, output)
    if mode == "append":
        w = w.outputMode("append").format("parquet").option("path", out)
        if partition_by:
            w = w.partitionBy(*partition_by)
        q = w.start()
    elif mode == "complete":
        q = w.outputMode("complete").foreachBatch(lambda b, bid: write_snapshot(b, out, bid)).start()
    elif mode == "update":
        q = w.outputMode("update").foreachBatch(lambda b, bid: merge_update(spark, b, bid, out, keys)).start()
    else:
        raise ValueError(mode)
    return _finish(q, out) if wait else out


def _writer(spark: SparkSession, df: DataFrame, name: str, trigger: dict | str | None, checkpoint: str | None, output: str | None):
    if (checkpoint is None) != (output is None):
        raise ValueError("checkpoint and output must be given together")
    ckpt = checkpoint or shared_dir(spark, "ckpt", name)
    out = output or shared_dir(spark, "out", name)
    if isinstance(trigger, str):
        trigger = REFRESH_TRIGGERS[trigger]
    w = df.writeStream.queryName(f"{name}_{out.rstrip('/').rsplit('/', 1)[-1]}").option("checkpointLocation", ckpt)
    return w.trigger(**(trigger or {"availableNow": True})), out


def _finish(q, out: str) -> str:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return out


def run_batches(spark: SparkSession, df: DataFrame, name: str, write: Callable[[DataFrame, int, str], None],
                trigger: dict | str | None = None, checkpoint: str | None = None, output: str | None = None) -> str:
    """Run ``df`` with ``write(batch, batch id, output folder)`` for every micro-batch."""
    w, out = _writer(spark, df, name, trigger, checkpoint, output)
    return _finish(w.foreachBatch(lambda b, bid: write(b, bid, out)).start(), out)


def merge_update(spark: SparkSession, b: DataFrame, bid: int, out: str, keys: list[str]) -> None:
    """Write the rows of batch ``bid`` as the newest of their keys."""
    write_snapshot(b.withColumn("_batch", F.lit(bid)), f"{out}/batches", bid)
    if bid % COMPACT_EVERY == COMPACT_EVERY - 1:
        write_snapshot(_newest(spark, out, keys, b.schema, bid), f"{out}/merged", bid)


def since_snapshot(spark: SparkSession, out: str, upto: int | None = None) -> list[str]:
    """Folders of the last merged snapshot and the batches after it, up to batch ``upto``."""
    merged = [v for v in versions(spark, f"{out}/merged") if upto is None or v < upto]
    since = merged[-1] if merged else -1
    folders = [f"{out}/batches/v={v:012d}" for v in versions(spark, f"{out}/batches")
               if v > since and (upto is None or v <= upto)]
    return folders + [f"{out}/merged/v={since:012d}"] if merged else folders


def _newest(spark: SparkSession, out: str, keys: list[str], schema: T.StructType, upto: int | None = None) -> DataFrame:
    """Newest row of each key: the last snapshot and the batches after it."""
    folders = since_snapshot(spark, out, upto)
    full = T.StructType([f for f in schema.fields if f.name != "_batch"] + [T.StructField("_batch", T.IntegerType())])
    if not folders:
        return empty(spark, full)
    df = spark.read.schema(full).parquet(*folders)
    others = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_v"))
    return latest.select(*[F.col(c) if c in keys else F.col("_v")[c].alias(c) for c in df.columns])


def read_output(spark: SparkSession, out: str, mode: str, schema: T.StructType,
                keys: list[str] | None = None) -> DataFrame:
    """What a stream has written so far; a stream without rows gives an empty
    frame of ``schema`` (the streaming frame's own)."""
    if mode == "append":
        return spark.read.schema(schema).parquet(out)
    if mode == "complete":
        df = latest_snapshot(spark, out, schema)
        return empty(spark, schema) if df is None else df
    return _newest(spark, out, keys, schema).drop("_batch")
