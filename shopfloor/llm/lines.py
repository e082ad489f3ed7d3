"""Line dedup on a log-template tree (operator 5).

Lines are parsed like log messages, by a tree of fixed depth.  Tokens with a
digit are variable fields from the start.  The first level of the tree is a
line's number of tokens, the next ``DEPTH`` levels are its leading tokens; the
path is the line's leaf.  In a leaf, a token that stands at its place in the
lines of at least ``min_texts`` different texts is constant, any other is a
variable field.  A line's template is its leaf with its constant tokens.  A
template recurs if at least half of its tokens are constant (tokens with a digit
never are) and lines of at least
``min_texts`` different texts have it, and all lines of recurring templates are
dropped.  Inside a leaf a line that recurs word for word, digits included, needs no
template: with at least ``exact_tokens`` tokens it stays only in its first text (that of
the smallest doc_id) as soon as a second different text has it.

Counting different texts (by hash) rather than documents keeps the lines of a
text that was copied many times: exact copies are other operators' business.
Counts are distinct pairs, reduced before each shuffle, so a line that a third
of all documents hold is spread over its documents; the joins that bring counts
back are ones that Spark splits.

Defined results: blank lines are never dropped; null and empty texts stay as
they are; a text whose lines are all dropped becomes empty; rows that repeat
doc_id and text share the result; other columns pass through, only n_lines and
dropped_lines are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, pin, table
from .syncmers import bind

DEPTH = 3
FIELD = "<*>"

_BLANKS = r"[\x20\x09-\x0D]+"


def raw_tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, _BLANKS), "")


def masked(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def _leaf(tokens: Column, depth: int) -> Column:
    return F.when(F.size(tokens) > 0, F.xxhash64(F.size(tokens), masked(F.slice(tokens, 1, depth))))


def leaf_of(line: Column, depth: int = DEPTH) -> Column:
    """The path of a line in the tree, as a hash; null without tokens."""
    return bind(raw_tokens(line), lambda t: _leaf(t, depth))


def path_of(line: Column, depth: int, exact_tokens: int) -> Column:
    """The leaf of a line, and the hash of all its tokens if there are enough."""
    return bind(raw_tokens(line), lambda t: F.struct(
        _leaf(t, depth).alias("leaf"), F.when(F.size(t) >= exact_tokens, F.xxhash64(t)).alias("exact")))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _texts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Different texts for each key."""
    return df.select(*keys, "th").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"))


def repeated_lines(paths: DataFrame) -> DataFrame:
    """doc_id, th and line of every exact line that an earlier, different text has; a line
    of a third of all documents is reduced before the shuffle, and the join is one that Spark splits."""
    repeated = pin(paths.filter("exact is not null").groupBy("exact")
                   .agg(F.min("th").alias("low"), F.max("th").alias("high"), F.min_by("th", F.struct("doc_id", "th")).alias("first"))
                   .filter("low <> high").select("exact", "first"), "repeated")
    return paths.join(repeated, "exact").filter("th <> first").select("doc_id", "th", "line")


def recurring_lines(docs: DataFrame, min_texts: int = 10, depth: int = DEPTH, constant: float = 0.5,
                    exact_tokens: int = 5) -> DataFrame:
    """doc_id, th (hash of the text) and line of every line to drop."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    paths = pin(keyed.select("doc_id", "th", F.posexplode_outer(text_lines(F.col("text"))).alias("line", "s"))
                .select("doc_id", "th", "line", path_of(F.col("s"), depth, exact_tokens).alias("p"))
                .select("doc_id", "th", "line", "p.leaf", "p.exact"), "paths").filter("leaf is not null")
    return templated_lines(keyed, paths.drop("exact"), min_texts, depth, constant).unionByName(repeated_lines(paths))


def templated_lines(keyed: DataFrame, paths: DataFrame, min_texts: int, depth: int, constant: float) -> DataFrame:
    """doc_id, th and line of every line whose template recurs."""
    leaves = pin(_texts(paths, ["leaf"]).filter(F.col("texts") >= min_texts).select("leaf"), "leaves")
    wanted = (paths.join(leaves, "leaf").groupBy("doc_id", "th").agg(F.collect_set("line").alias("wanted"))
              .select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "wanted"))
    # tokens only of lines in leaves that can recur
    lines = pin(keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))
                .dropDuplicates(["doc_id", "th"])
                .withColumn("all", text_lines(F.col("text")))
                .select("doc_id", "th", "all", F.explode("wanted").alias("line"))
                .select("doc_id", "th", "line", F.col("all")[F.col("line")].alias("s"))
                .select("doc_id", "th", "line", leaf_of(F.col("s"), depth).alias("leaf"),
                        masked(raw_tokens(F.col("s"))).alias("tokens")), "lines")
    parts = lines.select("doc_id", "th", "line", "leaf", F.posexplode("tokens").alias("place", "token")).select(
        "doc_id", "th", "line", "leaf", F.xxhash64("leaf", "place", "token").alias("part"), (F.col("token") != FIELD).alias("plain"))
    fixed = pin(_texts(parts, ["part"]).filter(F.col("texts") >= min_texts).select("part", F.lit(1).alias("fixed")), "fixed")
    templates = pin(parts.join(fixed, "part", "left")
                    .groupBy("doc_id", "th", "line", "leaf")
                    .agg(F.bit_xor(F.when(F.col("fixed") == 1, F.col("part")).otherwise(F.lit(0))).alias("parts"),
                         (F.count(F.when(F.col("plain"), F.col("fixed"))) / F.count(F.lit(1))).alias("share"))
                    .filter(F.col("share") >= constant)
                    .select("doc_id", "th", "line", F.xxhash64("leaf", "parts").alias("template")), "templates")
    recurring = pin(_texts(templates, ["template"]).filter(F.col("texts") >= min_texts).select("template"), "recurring")
    return templates.join(recurring, "template").select("doc_id", "th", "line")


@own_columns("doc_id", "text", new=("n_lines", "dropped_lines"))
def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without lines of recurring templates, plus n_lines and dropped_lines."""
    drops = (recurring_lines(docs, **options).groupBy("doc_id", "th").agg(F.collect_set("line").alias("__drop"))
             .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__drop"))
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    joined = (keyed.join(drops, keyed["doc_id"].eqNullSafe(drops["__id"]) & (F.col("__h") == F.col("__th")), "left")
              .withColumn("__lines", text_lines(F.col("text"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
                         F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).alias("n_lines"),
                         F.coalesce(F.size("__drop"), F.lit(0)).alias("dropped_lines"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without recurring lines, and how many were dropped."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
