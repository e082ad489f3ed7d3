"""Benchmark decontamination on SimHash windows (operator 7).

Texts are words (runs of letters and digits, lower-cased); shingles are five
words.  For every benchmark item, the windows of a document that have the
item's number of words get a 64-bit SimHash of their shingles, each weighing as
often as it occurs.  A multi-index over ``radius`` + 1 blocks of bits finds all
windows whose SimHash is within ``radius`` bits of an item of that size: at
least one block must then be equal.  Candidates are verified exactly by the
weighted Jaccard similarity of their shingles, at least ``threshold``.

Which windows need a SimHash at all: a window of w shingles that passes the
verification has at least t / (1 + t) * (m + w) shingles in common with an item
of m, where w is m or, in a shorter text, all it has.  So only documents that
hold so many of some item's shingles can have one, and in them only the windows
with so many places whose shingle is one of the item's.  All of those are
hashed.  That test is exact and leaves few documents; the others are read once
and never shuffled for it.

The benchmark's index is broadcast when its counted entries are at most
``broadcast_rows`` and joined by a shuffle otherwise; rows are the same.  A
passage that a third of all documents hold makes rows for each of them, grouped
by document, never by passage.

Defined results: items with fewer than ``min_words`` words are not searched,
since a few words meet by chance; null and empty texts match nothing; a text
shorter than an item is one window; rows that repeat doc_id and text give one
row for each item; equal items are reported each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, pin, table
from .syncmers import bind

SHINGLE = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_at(of: Column, i: Column) -> Column:
    return F.xxhash64(*[of[i + j] for j in range(SHINGLE)])


def shingles(of: Column) -> Column:
    """Hashes of all shingles in order; none if there are fewer words."""
    n = F.size(of) - SHINGLE
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: shingle_at(of, i))).otherwise(F.array().cast("array<long>"))


def simhash(of: Column) -> Column:
    """Bit b is set if it is set in more than half of the hashes."""
    def bit(b):
        ones = F.aggregate(of, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
        return F.when(2 * ones > F.size(of), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def block_masks(radius: int) -> list[int]:
    """64 bits in radius + 1 blocks, as signed masks."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger numbers of occurrences."""
    def least(h):
        return F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h)))

    def share(common):
        return common / (F.size(a) + F.size(b) - common)

    return bind(F.aggregate(F.array_distinct(a), F.lit(0), lambda n, h: n + least(h)), share)


def _held_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


@own_columns("doc_id", "text")
def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = 18, min_words: int = 8,
               broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per document and item: doc_id, th (hash of the text), item_id
    and the best window (start_word, n_words, hamming, similarity)."""
    bench = pin(items.select("item_id", words(F.col("text")).alias("w"))
                .withColumn("n", F.size("w")).filter(F.col("n") >= min_words)
                .withColumn("item_shingles", shingles(F.col("w")))
                .withColumn("item_hash", simhash(F.col("item_shingles"))).drop("w"), "bench")
    seeds = bench.select("item_id", "n", F.posexplode("item_shingles").alias("item_at", "shingle"))
    blocks = block_masks(radius)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    doc_words = keyed.select("doc_id", "th", words(F.coalesce("text", F.lit(""))).alias("w"))
    last = F.size("w") - SHINGLE
    places = (doc_words.select("doc_id", "th", "w", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
              .select("doc_id", "th", F.size("w").alias("doc_n"), "at", shingle_at(F.col("w"), F.col("at")).alias("shingle"))
              .filter(F.col("at").isNotNull()))
    # a document qualifies by the item places whose shingles it holds, a window by its own places
    lined_up = (places.join(_held_small(seeds, seeds.count(), broadcast_rows), "shingle")
                .groupBy("doc_id", "th", "item_id", "n")
                .agg(F.collect_set("item_at").alias("held"), F.max("doc_n").alias("doc_n"), F.collect_set("at").alias("places"))
                .withColumn("width", F.least("n", "doc_n") - SHINGLE + 1)
                .withColumn("need", F.ceil((F.col("n") - SHINGLE + 1 + F.col("width")) * (threshold / (1 + threshold)) - 1e-9).cast("int"))
                .filter((F.size("held") >= F.col("need")) & (F.size("places") >= F.col("need")))
                .withColumn("places", F.sort_array("places")))
    room = F.greatest(F.col("doc_n") - F.col("n"), F.lit(0))
    # windows that hold a place and the need - 1 places after it
    low = F.greatest(F.col("places")[F.col("i") + F.col("need") - 1] - F.col("width") + 1, F.lit(0))
    high = F.least(F.col("places")[F.col("i")], room)
    starts = (lined_up.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("places") - F.col("need"))))
              .select("doc_id", "th", "n", low.alias("low"), high.alias("high")).filter("low <= high")
              .select("doc_id", "th", "n", F.explode(F.sequence("low", "high")).alias("start"))
              .groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n")).alias("windows"))
              .select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "windows"))
    windows = (keyed.join(starts, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
               .dropDuplicates(["doc_id", "th"])
               .select("doc_id", "th", bind(words(F.col("text")), shingles).alias("all"), "windows")
               .select("doc_id", "th", "all", F.explode("windows").alias("x"))
               .select("doc_id", "th", F.col("x.start").alias("start_word"), F.col("x.n").alias("n"),
                       F.slice("all", F.col("x.start") + 1, F.col("x.n") - SHINGLE + 1).alias("shingles")))
    hashed = pin(windows.withColumn("hash", simhash(F.col("shingles"))), "windows")

    def index(df: DataFrame, column: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("block"), F.col(column).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(blocks)]
        return df.withColumn("key", F.explode(F.array(*keys))).select("*", "key.block", "key.bits").drop("key")

    by_block = index(bench, "item_hash")
    differ = F.col("hash").bitwiseXOR(F.col("item_hash"))
    # a pair meets in every equal block; it counts in the first
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(blocks)])
    near = (index(hashed, "hash").join(_held_small(by_block, bench.count() * len(blocks), broadcast_rows), ["n", "block", "bits"])
            .withColumn("hamming", F.bit_count(differ))
            .filter((F.col("block") == first) & (F.col("hamming") <= radius)))
    verified = (near.withColumn("similarity", weighted_jaccard(F.col("shingles"), F.col("item_shingles")))
                .filter(F.col("similarity") >= threshold))
    best = F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start_word")).alias("s"))
    return (verified.groupBy("doc_id", "th", "item_id", "n").agg(F.max(best).alias("b"))
            .select("doc_id", "th", "item_id", (-F.col("b.s")).alias("start_word"), F.col("n").alias("n_words"),
                    (-F.col("b.h")).alias("hamming"), F.col("b.similarity").alias("similarity")))


@own_columns("doc_id", "text")
def drop_leaking(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark passage; columns unchanged."""
    leaks = find_leaks(docs, items, **options).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    return (keyed.join(leaks, keyed["doc_id"].eqNullSafe(leaks["__id"]) & (F.col("__h") == F.col("__th")), "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the window."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")
