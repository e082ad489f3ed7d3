"""Uniform shuffle into shards of exact sizes (operator 9, law ``rows``).

A hypergeometric communication matrix says how many rows of each input
partition go to each shard: its row sums are the partitions' counts, its column
sums the shards' sizes (at most one apart), and it is drawn with the
probabilities that a uniform permutation of all rows would give it.  Each
partition is permuted locally (a sort by a random key), hands its first rows to
shard 0, the next to shard 1 and so on, and every shard is permuted again, so
that every assignment of rows to (shard, slot) is equally likely.

The second permutation is itself distributed: a row draws a bucket of its shard
and a place inside the bucket, and buckets are numbered by one prefix sum over
their counts.  No task holds a whole shard, whatever the number of shards.

Only the matrix (one number per partition and shard, checked against
``max_cells``) is on the driver.  Sharding looks at no key, so hot keys and
groups of equal texts spread like any rows.

The draw depends on the seed and on how the input lies in partitions; a rerun on
the same files gives the same shards.

Defined results: null texts are rows like others; repeated rows are placed one
by one, each as likely in any place as any other row; an empty table gives an
empty result; other columns pass through under any name, only ``shard`` and
``slot`` are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, partition_of, pin, row_of, table


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good items among ``draws`` from good + bad without
    replacement, by inversion outwards from the mode (about one step per
    standard deviation, for any size)."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    u = rng.random() - p
    up, down, p_up, p_down = mode, mode, p, p
    while u > 0:
        moved = False
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up, u, moved = up + 1, u - p_up, True
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down, u, moved = down - 1, u - p_down, True
            if u <= 0:
                return down
        if not moved or p_up + p_down == 0.0:  # rounding left a crumb of probability
            return mode
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """A random matrix of how many rows partition i sends to shard j."""
    rng, left, rows = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest, open_ = [], sum(left), n
        for j, room in enumerate(left):
            rest -= room
            x = hypergeometric(rng, room, rest, open_)
            row.append(x)
            open_ -= x
            left[j] -= x
        rows.append(row)
    return rows


def shard_sizes(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (j < total % n_shards) for j in range(n_shards)]


@own_columns(new=("shard", "slot"))
def shuffle_to_shards(docs: DataFrame, n_shards: int = 8, seed: int = 9, bucket_rows: int = 4096,
                      max_cells: int = 8_000_000) -> DataFrame:
    """``docs`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each
    shard).  The random sort keys are hashes of row numbers, so equal rows get
    places of their own."""
    spark = docs.sparkSession
    local = pin(docs.withColumn("__r", F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
                .sortWithinPartitions("__r")
                .withColumn("__mid", F.monotonically_increasing_id()), "shard-local")
    counts = {r.part: r.n for r in local.groupBy(partition_of(F.col("__mid")).alias("part"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) * n_shards > max_cells:
        raise ValueError(f"{len(counts)} partitions x {n_shards} shards exceed {max_cells} cells; coalesce the input")
    parts, total = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shard_sizes(total, n_shards), seed)
    ends = []
    for p, row in zip(parts, matrix, strict=True):
        upto = 0
        ends.append((p, [upto := upto + x for x in row]))
    cuts = spark.createDataFrame(ends, "__part long, __ends array<long>")

    n_buckets = max(1, -(-total // (n_shards * bucket_rows)))
    row = row_of(F.col("__mid"))
    sent = (local.join(F.broadcast(cuts), partition_of(F.col("__mid")) == F.col("__part"))
            .withColumn("shard", F.size(F.filter("__ends", lambda e: e <= row)).cast("int"))
            .withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__r", "__mid"), F.lit(n_buckets)).cast("int"))
            .drop("__part", "__ends"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sent.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    place = Window.partitionBy("shard", "__bucket").orderBy(F.xxhash64(F.lit(seed + 2), "__r", "__mid"), "__mid")
    return (sent.withColumn("__at", F.row_number().over(place) - 1)
            .join(starts, ["shard", "__bucket"])
            .select(*docs.columns, "shard", (F.col("__start") + F.col("__at")).alias("slot")))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: every document's shard and slot under the law ``rows``."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    return shuffle_to_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
