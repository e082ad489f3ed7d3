"""Reading and writing the sales, purchases and catalogue tables.

Reads always pass a schema (no inference pass over 100 TB).  Updates on
plain Parquet are snapshot writes: every change writes a new directory named
by a monotonically increasing version, readers take the newest complete one.
A path that is being read is never overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shopfloor.session import shared_dir

def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet", missing_ok: bool = False, **options) -> DataFrame:
    """Scan a table.  With ``missing_ok`` and a schema a path that doesn't
    exist reads as empty, like the reference's catalogue; any other failure
    and a missing path by default are errors."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv" and "header" not in options:
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    if missing_ok and schema is not None:
        fs, p = file_system(spark, path)
        if not fs.exists(p):
            return empty(spark, schema)
    return reader.load(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back: what several branches of
    a plan use is computed once, and a lost executor costs a re-read."""
    path = shared_dir(df.sparkSession, name) + "/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_parts(df: DataFrame, name: str, part: str, order: list[str]) -> DataFrame:
    """As ``stage``, in buckets of ``part``, an integer that each task of ``df`` has one value
    of: a task writes one file, sorted by ``order``, and readers that group by ``part`` and
    other columns move no rows."""
    spark = df.sparkSession
    path, table = shared_dir(spark, name) + "/data", f"{name}_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, part).sortBy(*order).option("path", path).saveAsTable(table)
    return spark.table(table)


def append(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Append rows (S4/S5).  Partitioning by month keeps date filters pruned."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def versions(spark: SparkSession, base: str) -> list[int]:
    """Complete snapshot versions under ``base``, ascending."""
    jvm = spark.sparkContext._jvm
    fs, p = file_system(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            try:
                out.append(int(name[2:]))
            except ValueError:
                pass
    return sorted(out)


def write_snapshot(df: DataFrame, base: str, version: int, fmt: str = "parquet") -> str:
    """Write ``df`` as snapshot ``version`` under ``base``.  Re-running the same
    version (a retried micro-batch) overwrites only that version's folder,
    which no reader uses until its ``_SUCCESS`` marker exists."""
    path = f"{base.rstrip('/')}/v={version:012d}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def latest_snapshot(spark: SparkSession, base: str, schema: T.StructType | None = None,
                    fmt: str = "parquet") -> DataFrame | None:
    vs = versions(spark, base)
    if not vs:
        return None
    return read_table(spark, f"{base.rstrip('/')}/v={vs[-1]:012d}", schema, fmt)
