"""Which date format a column is written in, found from the whole column.

``3/4/2001`` alone may be either order; its column tells.  One aggregate counts, for
every column asked for, the values that only day-first or only month-first can read, and the
other shapes.  The counts are sums, so they are pre-aggregated in the map tasks and one row
goes on, whatever the table's size.

``vote`` (default): the order with more evidence, day-first without any (D2); every value
is then read by its shape, slashes in that order.  ``first``: the rule of a parser that fixes one
format by the column's first value and reads nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.text import DATE_FORMATS, clean_text

SLASHES = r"^(\d{1,2})/(\d{1,2})/(\d{4})( .*)?$"
#: Shapes of dates and their formats; slashes in both orders.
MONTH_FIRST = {"d/M/yyyy": "M/d/yyyy", "d/M/yyyy H:m:s": "M/d/yyyy H:m:s"}
FORMATS = [*DATE_FORMATS, *[(MONTH_FIRST[f], shape) for f, shape in DATE_FORMATS if f in MONTH_FIRST]]


def _parsed(s: Column, formats: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("timestamp")
    for fmt, shape in reversed(formats):
        out = F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))).otherwise(out)
    return out


def _formats(month_first: bool) -> list[tuple[str, str]]:
    return [(MONTH_FIRST.get(f, f) if month_first else f, shape) for f, shape in DATE_FORMATS]


def format_votes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: values, of them blank, slash dates that only day-first, only month-first,
    both or neither order can read, values of another known shape that parse, values that
    parse in no way, and the order the column is taken to be in."""
    def counts(c: str) -> Column:
        s = clean_text(F.col(f"`{c}`").cast("string"))
        slash = s.rlike(SLASHES)
        some = s != ""
        a, b = (F.regexp_extract(s, SLASHES, i).try_cast("int") for i in (1, 2))
        day, month = a.between(1, 31) & b.between(1, 12), a.between(1, 12) & b.between(1, 31)
        other = _parsed(s, [f for f in DATE_FORMATS if f[0] not in MONTH_FIRST]).isNotNull()
        n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_values"), n(~F.coalesce(some, F.lit(False))).alias("blank"),
            n(slash & day & ~month).alias("day_first"), n(slash & month & ~day).alias("month_first"),
            n(slash & day & month).alias("either"), n(~slash & other).alias("other_formats"),
            n(some & ~(slash & (day | month)) & ~(~slash & other)).alias("no_date"))

    votes = df.agg(F.array(*[counts(c) for c in columns]).alias("votes")).select(F.inline("votes"))
    order = F.when(F.col("month_first") > F.col("day_first"), F.lit("month first")).otherwise(F.lit("day first"))
    return votes.withColumn("slash_order", order)


def parse_dates(df: DataFrame, columns: dict[str, str], rule: str = "vote", order_by: str | None = None) -> DataFrame:
    """``df`` with a timestamp column for each text column (``columns``: text column -> new name).

    ``vote``: by the order that the column's votes give.  ``first``: by the format of the first
    value that has one, in the order of ``order_by``.  Text that doesn't parse so is null.  The decision is a
    scalar subquery, so rows are read in the same job."""
    if rule not in ("vote", "first"):
        raise ValueError(rule)
    if rule == "first" and not order_by:
        raise ValueError("the first value needs order_by")
    votes = None if rule == "first" else format_votes(df, list(columns))
    new = {}
    for c, name in columns.items():
        s = clean_text(F.col(f"`{c}`").cast("string"))
        if rule == "vote":
            chosen = votes.where(F.col("column_name") == c).select(F.col("slash_order") == "month first").scalar()
            new[name] = F.when(chosen, _parsed(s, _formats(True))).otherwise(_parsed(s, _formats(False)))
        else:
            first = df.select(_first_format(s).alias("f"), F.col(f"`{order_by}`").alias("o")).where(F.col("f").isNotNull())
            chosen = first.agg(F.min_by("f", F.struct("o", "f"))).scalar()
            out = F.lit(None).cast("timestamp")
            for fmt, shape in FORMATS:
                out = F.when((chosen == fmt) & s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))).otherwise(out)
            new[name] = out
    return df.withColumns(new)


def _first_format(s: Column) -> Column:
    """The format one value is in; slashes are day-first unless only month-first reads them."""
    return F.coalesce(*[F.when(s.rlike(shape) & F.try_to_timestamp(s, F.lit(fmt)).isNotNull(), F.lit(fmt))
                        for fmt, shape in FORMATS])
