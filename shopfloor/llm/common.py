"""Helpers of the corpus operators: text rules, table reads, written intermediate tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.session import shared_dir, ship_package

#: A word: a run of characters other than space and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: monotonically_increasing_id() keeps the partition above this bit and the row below it.
ROW_BITS = 33


#: Rows of an Arrow batch; a batch of whole texts is held several times over (JVM, Arrow, pandas).
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Make the package known to Python workers and keep their batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    """``df.toDF(*names)``, but columns that keep their name stay the same attributes: ``toDF``
    gives them an alias, which Spark takes away on one side of a self-join only, and then
    it shuffles both sides instead of reusing the one exchange."""
    if len({c.lower() for c in df.columns}) < len(df.columns):
        return df.toDF(*names)  # can't be told apart by name
    was = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.select(*[c if a == b else c.alias(b) for c, a, b in zip(was, df.columns, names, strict=True)])


def own_columns(*used: str, new: tuple[str, ...] = ()):
    """For operators that return the columns of their first argument: while they run, all
    columns but ``used`` go by numbers, so that no name (another case, a dot, a name that the
    operator uses inside, one that occurs twice) can clash with theirs.  Columns
    named like one of the results, ``new``, are replaced."""
    def wrap(operator):
        @wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            names = docs.columns
            hidden = {f"_{i}_": c for i, c in enumerate(names) if c not in used}
            inside = _renamed(docs, [c if c in used else f"_{i}_" for i, c in enumerate(names)])
            out = operator(inside.drop(*[h for h, c in hidden.items() if c in new]), *args, **options)
            return out.toDF(*[hidden.get(c, c) for c in out.columns])
        return run
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts lineage: a lost executor costs a re-read, and row
    numbers or partition numbers in it can't change between two uses.
    """
    path = shared_dir(df.sparkSession, name) + "/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partition_of(mid: Column) -> Column:
    return F.shiftright(mid, ROW_BITS)


def row_of(mid: Column) -> Column:
    return mid.bitwiseAND(F.lit((1 << ROW_BITS) - 1).cast("long"))
