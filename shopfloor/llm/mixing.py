"""Mixing sources to target weights by systematic sampling (operator 1).

Every source gets a target size.  A document's expected number of copies is
target / size of its source, at most ``max_repeat``.  Within a source the
documents are laid on a line in order of size, each as long as its expected
copies; one random offset per source places a comb of unit steps on the line,
and a document is emitted once for every tooth that falls on it.  A document is
therefore taken floor or ceil of its expected copies, and because the order is
by size, the words taken come within about one large document of the target.
A small source of a few long documents can still miss it, so of ``draws``
equally spaced offsets, the first of them random, the one is used whose words
come nearest to the target.  That is a bias towards documents whose sizes fit: a
document's chance of an extra copy is its expected one on average over the
sizes of its source, not for each document.  ``draws=1`` is the single random offset
without it.

The prefix sum is distributed: rows are range partitioned by (source, size,
doc_id), numbered inside their partition, and the numbering is written once;
only one count per (partition, source) is summed across partitions.  A source
that holds a third of all rows spans as many partitions as it needs.  Rows that repeat
doc_id, source and size are one group, as long as all its rows together, however many
they are; the copies that the group gets are handed out evenly over its rows.

Defined results: a null source is a source of its own, ordered last; null or
wordless texts have size 0 and are sampled like others; rows that repeat
doc_id, source and size take floor or ceil of their expected copies like any rows; a
source of size 0 is never emitted; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, partition_of, pin, row_of, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)


def source_order(names: list[str | None]) -> list[str | None]:
    """Code point order, null last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def cyclic_weights(names: list[str | None], weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    return {s: weights[i % len(weights)] for i, s in enumerate(source_order(names))}


def share_targets(sizes: dict[str | None, int], weights: dict[str | None, float],
                  max_repeat: float = 3.0) -> dict[str | None, float]:
    """Split the total size by weight; what exceeds ``max_repeat`` times a
    source's size goes to the others by weight, until none is above."""
    targets: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), source_order(list(sizes))
    while open_:
        unit = left / sum(weights[s] for s in open_)
        above = [s for s in open_ if unit * weights[s] > max_repeat * sizes[s]]
        if not above:
            targets |= {s: unit * weights[s] for s in open_}
            break
        for s in above:
            targets[s] = max_repeat * sizes[s]
            left -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return targets


def offset_of(source: str | None, seed: int) -> float:
    """The random offset in [0, 1) of a source."""
    label = f"{seed}:null" if source is None else f"{seed}:s:{source}"
    return int.from_bytes(hashlib.sha256(label.encode()).digest()[:6], "big") / 2.0**48


@own_columns("doc_id", "text", "source")
def mixing_plan(docs: DataFrame, weights=cyclic_weights, max_repeat: float = 3.0, seed: int = 20,
                draws: int = 32, max_sources: int = 100_000) -> DataFrame:
    """One row per distinct (doc_id, source, size): ``rows`` (how often it
    occurs), source_size, target and ``copies`` of all these rows together.

    ``weights`` maps the list of sources to their weights.  The driver holds
    one number per source; more than ``max_sources`` of them is an error.
    """
    spark = docs.sparkSession
    units = (docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
             .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    line = pin(units.repartitionByRange("source", "size", "doc_id")
               .sortWithinPartitions("source", "size", "doc_id")
               .withColumn("mid", F.monotonically_increasing_id()), "mix-line")
    line = line.withColumns({"part": partition_of(F.col("mid")), "row": row_of(F.col("mid"))}).drop("mid")
    upto = Window.partitionBy("part", "source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("inside", F.coalesce(F.sum("rows").over(upto), F.lit(0)))

    stats = line.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("n")).limit(max_sources + 1).collect()
    if len(stats) > max_sources:
        raise ValueError(f"more than {max_sources} sources to mix")
    sizes = {r.source: r.n for r in stats}
    targets = share_targets(sizes, weights(list(sizes)), max_repeat)
    fields = [(s, sizes[s], targets[s], targets[s] / sizes[s] if sizes[s] else 0.0, offset_of(s, seed)) for s in sizes]
    schema = "s_source string, source_size long, target double, expected double, offset double"

    in_order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (line.groupBy("part", "source").agg(F.sum("rows").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
              .select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "before"))
    rank = F.col("before") + F.col("inside")

    def laid(rows: list[tuple]) -> DataFrame:
        return (line.join(starts, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source")))
                .join(F.broadcast(spark.createDataFrame(rows, schema)), F.col("source").eqNullSafe(F.col("s_source"))))

    def copies(shift: float):
        teeth = lambda n: F.floor(n * F.col("expected") + F.pmod(F.col("offset") + F.lit(shift), F.lit(1.0)))
        return teeth(rank + F.col("rows")) - teeth(rank)

    shifts = [k / draws for k in range(draws)]
    words = laid(fields).groupBy("source").agg(*[
        F.sum(copies(x) * F.col("size")).alias(f"w{k}") for k, x in enumerate(shifts)]).collect()
    best = {r[0]: min(range(draws), key=lambda k: abs(r[k + 1] - targets[r[0]])) for r in words}
    chosen = [(s, n, t, e, (u + shifts[best[s]]) % 1.0) for s, n, t, e, u in fields]
    return laid(chosen).select("doc_id", "source", "size", "rows", "source_size", "target",
                               copies(0.0).cast("long").alias("copies"))


def copies_of_row(at: Column) -> Column:
    """Copies of the row with number ``at`` (from 0) of a group of ``rows`` rows."""
    return (F.floor(F.col("copies") / F.col("rows")) + (at < F.col("copies") % F.col("rows")).cast("int")).cast("int")


def _rows_in_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with ``at``, each row's number within its group of equal doc_id, source and
    size; 0 in groups of one.  Rows of repeated groups are numbered in their partitions, and
    the partitions' counts are added up, so that no group meets in one task."""
    sized = docs.withColumn("n", word_count(F.col("text")))
    if groups.filter("rows > 1").isEmpty():
        return sized.withColumn("at", F.lit(0).cast("long"))
    key = ["doc_id", "source", "n"]
    sized = pin(sized.withColumn("part", F.spark_partition_id()), "mix-rows").withColumn("mid", F.monotonically_increasing_id())
    inside = Window.partitionBy("part", *key).orderBy("mid")
    counts = sized.groupBy("part", *key).agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("s_part"), *[F.col(c).alias(f"s_{c}") for c in key],
                           F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    numbered = sized.withColumn("in", F.row_number().over(inside) - 1)
    same = (F.col("part") == F.col("s_part")) & F.col("doc_id").eqNullSafe(F.col("s_doc_id"))
    same = same & F.col("source").eqNullSafe(F.col("s_source")) & (F.col("n") == F.col("s_n"))
    return numbered.join(starts, same).withColumn("at", F.col("start") + F.col("in"))


@own_columns("doc_id", "text", "source")
def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document row repeated as often as it is taken, the
    columns of ``docs`` unchanged.  Options as for :func:`mixing_plan`."""
    groups = mixing_plan(docs, **options)
    plan = (groups.filter("copies > 0")
            .select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), "rows", "copies"))
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (F.col("n") == F.col("p_size"))
    return (_rows_in_groups(docs, groups).join(plan, same).withColumn("times", copies_of_row(F.col("at"))).filter("times > 0")
            .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("k")).drop("k"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: one per documents row with what the mix takes of it."""
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    each = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("at"))
    return (each.withColumn("copies", copies_of_row(F.col("at")))
            .select("doc_id", "size", "source_size", "target", (F.col("copies").cast("long") * F.col("size")).alias("taken"),
                    "source", "copies"))
