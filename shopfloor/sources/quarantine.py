"""Reading text sheets (CSV, JSON lines) without losing or guessing at bad rows.

A line that can't be read under the declared schema, or that lacks a required cell, is set
aside with its text, its file and the reason; every line is either kept or rejected.
The parsed lines are written once, laid out by outcome, so either side is read without
the other and the files are parsed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.functions.text import is_blank
from shopfloor.session import shared_dir
from shopfloor.sources.tables import read_table

MALFORMED, MISSING = "malformed", "missing "
REJECTS = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "record", "reason")])


def _free(name: str, schema: T.StructType) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in schema.names}
    while name in taken:
        name = "_" + name
    return name


def read_checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
                 required: list[str] | None = None, output: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejects) of the sheet at ``path``.

    ``malformed``: not a JSON object, or another number of cells than the sheet has (a CSV
    header that differs from ``schema`` is an error, not a reject).  ``missing <column>``: the first of
    ``required`` that is null or blank; ``record`` is then the parsed row as JSON.  Blank lines
    are no rows.  An empty sheet gives two empty frames.  Kept rows have the
    columns of ``schema``, which may have any names; ``output`` is where the outcome is
    written (a fresh shared folder by default)."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"{fmt}: only text formats have malformed rows")
    corrupt, file, record, reason = (_free(n, schema) for n in ("_corrupt", "_file", "_record", "_reason"))
    # all columns are parsed: with column pruning a line's cells would not be counted
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "columnPruning": "false",
                "enforceSchema": "false", **options}
    read = read_table(spark, path, T.StructType(schema.fields + [T.StructField(corrupt, T.StringType())]), fmt, **settings)
    why = F.when(F.col(corrupt).isNotNull(), F.lit(MALFORMED))
    for c in required or []:
        why = why.when(is_blank(F.col(f"`{c}`").cast("string")), F.lit(MISSING + c))
    columns = [F.col(f"`{c}`") for c in schema.names]
    checked = read.select(*columns, F.col("_metadata.file_path").alias(file), why.alias(reason),
                          F.coalesce(F.col(corrupt), F.when(why.isNotNull(), F.to_json(F.struct(*columns)))).alias(record))
    out = output or shared_dir(spark, "checked") + "/data"
    outcome = _free("outcome", schema)
    checked.withColumn(outcome, F.when(F.col(reason).isNull(), F.lit("kept")).otherwise(F.lit("rejected"))) \
        .write.partitionBy(outcome).parquet(out)
    laid_out = T.StructType([f for f in checked.schema.fields] + [T.StructField(outcome, T.StringType())])
    written = read_table(spark, out, laid_out)
    kept = written.where(F.col(outcome) == "kept").select(*columns)
    rejects = written.where(F.col(outcome) == "rejected").select(
        F.col(file).alias("file"), F.col(record).alias("record"), F.col(reason).alias("reason"))
    return kept, rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected rows by file and reason."""
    return rejects.groupBy("file", "reason").agg(F.count(F.lit(1)).alias("rows"))
