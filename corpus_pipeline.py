"""A training corpus out of raw documents, in five stages.

Each stage is one corpus operator.  It takes (spark, docs, sf_dir), works on
everything its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next stage's documents; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopfloor.llm.common import pin, prepare, table
from shopfloor.llm.decontaminate import drop_leaking
from shopfloor.llm.jaccard import keep_one_of_each
from shopfloor.llm.langid import keep_known
from shopfloor.llm.mixing import mix
from shopfloor.llm.sharding import shuffle_to_shards


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is like some language; texts without a letter and
    texts that are like none (a cosine below chance for the profiles) go."""
    prepare(spark)
    return keep_known(docs, min_score=0.05)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each class of documents
    linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    prepare(spark)
    return keep_one_of_each(docs, percent=80, n=5, bands=45)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item at a similarity of 0.8 or more."""
    prepare(spark)
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights; a document may be repeated up to three times."""
    prepare(spark)
    return mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in the shard, uniformly shuffled."""
    prepare(spark)
    return shuffle_to_shards(docs, n_shards=8)


STAGES = [
    ("language id", known_language),
    ("near duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the language profiles nor the random draws; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = pin(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
