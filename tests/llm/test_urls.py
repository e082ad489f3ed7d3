import numpy as np
from common_data import sf  # noqa: F401
from pyspark.sql import functions as F

from oracle_compare import compare, duck_connect
from shopfloor.llm.registry import LLM_SQL
from shopfloor.llm.urls import build_cascade, judge_urls, key_hashes, op3_urls


def test_matches_sql(spark, sf):
    ok, msg = compare(op3_urls(spark, sf), duck_connect(sf), LLM_SQL["op3_urls"])
    assert ok, msg


def test_cascade_is_exact_over_its_universe(spark):
    k1, k2 = key_hashes(F.col("id").cast("string"))
    for rule, rate in (("id % 50 = 0", 0.5), ("id % 2 = 0", 0.3), ("id < 0", 0.1), ("id >= 0", 0.1)):
        keys = spark.range(4000).select(k1.alias("k1"), k2.alias("k2"), F.expr(rule).alias("listed")).persist()
        cascade = build_cascade(keys, rate=rate, deep_rate=rate)
        rows = keys.collect()
        got = cascade.listed(np.array([r.k1 for r in rows]), np.array([r.k2 for r in rows]))
        assert got.tolist() == [r.listed for r in rows]
        assert len(cascade.levels) >= (3 if rate > 0.2 else 0)


def test_longest_rule_and_host_list(spark):
    urls = [(1, "http://a.example.org/es/1", "example.org/es/", "block"), (2, "http://a.example.org/en/12", "example.org/en/1", "block"),
            (3, "http://a.example.org/en/22", "org/", "allow"), (4, "http://badexample.org/es/1", "org/", "allow"),
            (5, "http://EXAMPLE.ORG/es/", "example.org/es/", "block"), (6, "http://x.com/de/1", "com/de/", "block"),
            (7, "http://x.com/en/1", None, "block"), (8, "http://y.com/en/1", None, "allow"), (9, "http://y.com/fr/", "com/fr/", "allow"),
            (10, "http://y.com/FR/", None, "allow"), (11, "a://b://c.org/x", None, "allow"), (12, "x://com/de/?", "com/de/", "block"),
            (13, "http://com", None, "block"), (14, "http://.org/", "org/", "allow")]
    pages = spark.createDataFrame([u[:2] for u in urls], "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in judge_urls(pages).collect())
    assert got == [(i, rule, verdict) for i, _, rule, verdict in urls]
