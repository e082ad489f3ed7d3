"""Ranked search against a full evaluation of every document and query."""

import math
import random
import re
from collections import Counter

import numpy as np

from common_data import CLASHES, DOCS, EDGES, edge_docs, sf, sf_docs  # noqa: F401
from pyspark.sql import functions as F
from shopfloor.llm import search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """docs: (doc_id, text) pairs; items: (item_id, text) pairs."""
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, None, None, None) for d, t in docs], DOCS),
            spark.createDataFrame(items, "item_id long, text string"))


def test_random_tables(spark):
    """Few words, so that scores tie and common words stop making accumulators."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(30)]
    for k, block in ((3, 16), (7, 1000)):
        docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 25)))) for i in range(400)]
        items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 8)))) for i in range(12)]
        d, q = frames(spark, docs, items)
        assert rows(search.ranked_search(d.repartition(5), q, k=k, block_docs=block)) == brute(docs, items, k)


def test_blocks_of_queries(spark, sf_docs, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:40]
    docs = [(d, t) for d, t, *_ in sf_docs]
    d, q = frames(spark, docs, items)
    assert rows(search.ranked_search(d, q, k=5, max_terms=300)) == brute(docs, items, 5)


def test_edges(spark):
    bench = [(1, "The CAT, the dog"), (2, None), (3, ""), (4, "!!!"), (5, "nowhere-to-be-found"), (1, "The CAT, the dog"), (6, "word1 and1 no ID 漢字 one")]
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("terms", F.lit("x"))
    docs = edge_docs(spark)
    assert set(CLASHES) <= set(docs.columns)
    got = rows(search.ranked_search(docs, items, k=4))
    assert got == brute([(e[0], e[1]) for e in EDGES], bench, 4)
    assert {r[0] for r in got} == {1, 6}
    assert search.ranked_search(docs.limit(0), items).collect() == []
    assert search.ranked_search(docs, items.limit(0)).collect() == []


def test_terms_match_the_contract_pattern():
    text = "".join(map(chr, range(0x0, 0x250))) + "A漢z0😀"
    assert search.terms_of(text) == terms(text)


def test_accumulators_stop_and_scores_stay_exact():
    """A common word gives no accumulators once rarer ones have settled the best."""
    rng = np.random.default_rng(3)
    n = np.full(1000, 50)
    row = np.concatenate([np.arange(1000), rng.choice(1000, 20, replace=False)])
    term = np.concatenate([np.zeros(1000, int), np.ones(20, int)])
    block = search.Block(np.arange(1000), n, row, term, np.ones(1020, int), 1000, 50_000)
    top = int(block.impact.max())
    query = [(1, 5000, 5000 * top), (0, 10, 10 * top)]
    at, scores = search.evaluate(block, query, 5, 1)
    assert len(at) == 20 and set(scores) == {5010 * top}
    at, scores = search.evaluate(block, query, 30, 1)
    assert len(at) == 1000
