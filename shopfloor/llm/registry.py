"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP13_SQL, op13_collocations
from .common import prepare
from .decontaminate import op7_decontaminate
from .jaccard import op4_jaccard
from .langid import op10_langid
from .lines import op5_lines
from .mixing import op1_mix
from .packing import op11_packing
from .search import OP12_SQL, op12_search
from .sharding import op9_shards
from .substring import op2_substring
from .syncmers import op8_syncmers
from .urls import OP3_SQL, op3_urls
from .warc import OP6_SQL, op6_warc



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def prepared(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)
    return run


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: prepared(q) for k, q in {
    "op1_mix": op1_mix,
    "op2_substring": op2_substring,
    "op3_urls": op3_urls,
    "op4_jaccard": op4_jaccard,
    "op5_lines": op5_lines,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_syncmers": op8_syncmers,
    "op9_shards": op9_shards,
    "op10_langid": op10_langid,
    "op11_packing": op11_packing,
    "op12_search": op12_search,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}.items()}

LLM_SQL: dict[str, str] = {"op3_urls": OP3_SQL, "op6_warc": OP6_SQL, "op12_search": OP12_SQL, "op13_collocations": OP13_SQL}
