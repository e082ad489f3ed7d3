"""Document fingerprints of closed syncmers (operator 8).

A k-mer is ``K`` consecutive words.  It is an anchor if, of the ``S``-word
windows inside it, a smallest one (by hash) is the first or the last: a closed
syncmer.  The choice looks at nothing but the k-mer itself, so a stretch that
two texts share has the same anchors in both, wherever it stands.  Positional
matching: a mark is two neighbouring anchors with their distance in words, so
marks agree only where the anchors keep their order and places relative to each
other.  A fingerprint is the sequence of a text's distinct marks, eight hex
digits each, and the likeness of two fingerprints is the Dice share of their
marks.

All of it is array expressions inside the JVM; hash-based set operations keep
it linear in the length of a text.  The next document is found without a global
window: ids are range partitioned, each partition looks up its own neighbours
and the first id of the next partition.  Texts are shuffled once, by doc_id; of
the next document only the part that the edit needs travels, with its marks.

Defined results: a null text is empty; a text without words has the empty
fingerprint, which is like another empty one (1.0) and unlike all others (0.0);
fewer than ``K`` words, or only one anchor, make one mark of what there is; rows
that repeat a doc_id each get a row, and as the next document count as the one
with the smallest hash of its text; a null doc_id has no next document, so its
text isn't edited and near_next is 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, pin, table

K = 8
S = 3

_BLANKS = r"[\x20\x09-\x0D]+"


def bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row."""
    return F.transform(F.array(value), use)[0]


def word_hashes(text: Column) -> Column:
    return F.array_remove(F.transform(F.split(text, _BLANKS), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def _indexes(n: Column) -> Column:
    """0 to n - 1, no index if n isn't positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def anchors(windows: Column, k: int, s: int) -> Column:
    """Places of the closed syncmers, given the hashes of all s-word windows."""
    span = k - s  # between the first and the last window of a k-mer

    def closed(i):
        edge = F.least(windows[i], windows[i + span])
        return edge <= F.least(*[windows[i + j] for j in range(1, span)]) if span > 2 else (
            edge <= windows[i + 1] if span == 2 else F.lit(True))

    return F.filter(_indexes(F.size(windows) - span), closed)


def kmer_hash(windows: Column, i: Column, k: int, s: int) -> Column:
    """Hash of a whole k-mer from windows that cover it."""
    return F.xxhash64(*[windows[i + j] for j in [*range(0, k - s, s), k - s]])


def marks(text: Column, k: int = K, s: int = S) -> Column:
    """Distinct positional marks of a text, in order, as array<int>."""
    def short(h):
        return h.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")

    def of_anchors(windows, at):
        def mark(i):
            return short(F.xxhash64(kmer_hash(windows, at[i], k, s), kmer_hash(windows, at[i + 1], k, s), at[i + 1] - at[i]))
        return F.when(F.size(at) > 1, F.transform(_indexes(F.size(at) - 1), mark)).when(
            F.size(at) == 1, F.array(short(kmer_hash(windows, at[0], k, s))))

    def of_words(words):
        windows = F.transform(_indexes(F.size(words) - (s - 1)), lambda i: F.xxhash64(*[words[i + j] for j in range(s)]))
        found = bind(windows, lambda w: bind(anchors(w, k, s), lambda at: of_anchors(w, at)))
        whole = F.when(F.size(words) > 0, F.array(short(F.xxhash64(words)))).otherwise(F.array().cast("array<int>"))
        return F.coalesce(found, whole)

    return F.array_distinct(bind(word_hashes(text), of_words))


def fingerprint(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda m: F.lpad(F.lower(F.hex(m)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, pred_id: every id that follows some id (the first one follows
    the last), and need: the code points that the edit of pred_id takes."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    line = pin(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "doc-order")
    by_part = line.groupBy("part").agg(F.min("doc_id").alias("first"))
    wrap = by_part.agg(F.min("first").alias("first"))
    starts = by_part.select(F.col("part").alias("p"), F.lead("first").over(Window.orderBy("part")).alias("next_first"))
    within = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    found = line.withColumn("in_part", within).join(starts, F.col("part") == F.col("p"))
    return found.select(F.coalesce("in_part", "next_first", wrap.scalar()).alias("doc_id"), F.col("doc_id").alias("pred_id"),
                        F.floor(F.col("n") / 4).cast("int").alias("need"))


@own_columns("doc_id", "text")
def fingerprint_documents(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = next_documents(docs).withColumnRenamed("doc_id", "next_id")
    heads = (texts.join(order, F.col("doc_id") == F.col("next_id"))
             .select("pred_id", F.xxhash64("text").alias("h"),
                     F.struct(F.substring("text", F.lit(1), F.col("need")).alias("head"), marks(F.col("text"), k, s).alias("marks")).alias("x"))
             .groupBy("pred_id").agg(F.min_by("x", "h").alias("next")))
    text, n = F.col("text"), F.col("n")
    cut = F.floor(n / 4).cast("int")
    edited = F.when(F.col("next").isNull(), text).otherwise(
        F.concat(F.substring(text, F.lit(1), n - cut), F.substring(F.col("next.head"), F.lit(1), cut)))
    # every id has a next document; texts are shuffled by id once, for both joins
    known = texts.join(heads, F.col("doc_id") == F.col("pred_id")).drop("pred_id")
    unknown = texts.filter(F.col("doc_id").isNull()).withColumn("next", F.lit(None).cast(heads.schema["next"].dataType))
    return (known.unionByName(unknown)
            .withColumn("n", F.length("text"))
            .withColumn("edited", edited)
            .withColumns({"own": marks(text, k, s), "other": marks(F.col("edited"), k, s)})
            .select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("other")).alias("near_edited"),
                    F.coalesce(likeness(F.col("own"), F.col("next.marks")), F.lit(0.0)).alias("near_next")))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract rows: fingerprints of every whole text and its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
