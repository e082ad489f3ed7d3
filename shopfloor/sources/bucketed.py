"""Tables stored in buckets of a key, so that joins and aggregates on it move no rows.

What is joined again and again, the catalogue and the quantities sold, is written once in
the same number of buckets; a task then reads bucket i of both.  A bucket can't be split,
so tables with hot keys are stored aggregated: ``sold_by_month`` has a row per SKU and month,
however many lines a SKU has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.functions.text import clean_text
from shopfloor.operators.inventory import sellable_lines
from shopfloor.session import shared_dir


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` as ``table``, bucketed and sorted by ``key``, and read it back.

    Rows are dealt by bucket before they are written, so each bucket is one file.  The
    files lie under ``path`` (a fresh shared folder by default); the name is registered in the
    session's catalogue, which is what tells readers about the buckets."""
    where = path or shared_dir(df.sparkSession, "bucketed") + f"/{table}"
    (df.repartition(buckets, F.col(key)).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", where).saveAsTable(table))
    return df.sparkSession.table(table)


def drop_bucketed(spark: SparkSession, *tables: str) -> None:
    """Forget the tables' names; the files stay until their folder goes."""
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS `{t}`")


def catalogue_rows(vault: DataFrame) -> DataFrame:
    """The catalogue with its join key as a column, as buckets need it."""
    return vault.withColumn("sku_key", clean_text(F.col("sku")))


def sold_by_month(lines: DataFrame, month: str) -> DataFrame:
    """Sold quantity per SKU and month (a column of ``lines``): few rows a SKU, whatever the skew."""
    return (sellable_lines(lines).groupBy("sku_key", month).agg(F.sum("qty").alias("sold_qty")))
