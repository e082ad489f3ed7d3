import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from common_data import docs_of, sf, sf_docs  # noqa: F401
from shopfloor.llm.sharding import communication_matrix, hypergeometric, op9_shards, shard_sizes, shuffle_to_shards


def test_hypergeometric_follows_the_distribution():
    rng = random.Random(1)
    for good, bad, draws in ((30, 50, 20), (3, 400, 100), (1000, 1000, 500), (5, 0, 3)):
        got = np.array([hypergeometric(rng, good, bad, draws) for _ in range(4000)])
        want = np.random.default_rng(2).hypergeometric(good, bad, draws, 4000)
        assert abs(got.mean() - want.mean()) < 0.1 * (want.std() + 0.01) + 1e-9
        assert abs(got.std() - want.std()) <= 0.1 * want.std()
        assert got.min() >= max(0, draws - bad) and got.max() <= min(good, draws)
    assert 10**9 < hypergeometric(rng, 10**10, 10**10, 3 * 10**9) < 2 * 10**9


def test_matrix_has_exact_margins():
    counts, sizes = [5, 0, 17, 300, 1], shard_sizes(323, 8)
    m = communication_matrix(counts, sizes, 3)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
    assert max(sizes) - min(sizes) <= 1


def test_contract_on_the_table(spark, sf, sf_docs):
    rows = op9_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d for d, *_ in sf_docs)
    texts = {d: (t or "").encode() for d, t, *_ in sf_docs}
    for r in rows:
        assert r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert r.law == "rows" and r.grown_shard is None
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_every_place_is_equally_likely(spark):
    docs = docs_of(spark, [str(i) for i in range(12)]).repartition(3).persist()
    places = Counter()
    for seed in range(60):
        for r in shuffle_to_shards(docs, n_shards=3, seed=seed, bucket_rows=2).collect():
            places[(r.doc_id, r.shard)] += 1
    # 60 draws, each document in each shard 20 times on average
    chi = sum((places[(d, s)] - 20) ** 2 / 20 for d in range(12) for s in range(3))
    assert chi < 60  # 24 degrees of freedom; beyond this once in 15,000 times


def test_more_shards_than_rows(spark):
    rows = shuffle_to_shards(docs_of(spark, ["a", "b", "b"]), n_shards=5).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (1, 0), (2, 0)]


def test_equal_rows_spread_over_all_shards(spark):
    """800 equal rows among 8,000: about 100 in each of 8 shards."""
    docs = docs_of(spark, ["same" if i < 800 else f"own {i}" for i in range(8000)]).withColumn(
        "doc_id", F.when(F.col("text") == "same", 0).otherwise(F.col("doc_id"))).coalesce(4)
    got = Counter(r.shard for r in shuffle_to_shards(docs).filter("text = 'same'").collect())
    assert sum(got.values()) == 800 and len(got) == 8
    assert sum((n - 100) ** 2 / 100 for n in got.values()) < 30  # 7 degrees of freedom


def test_copies_of_the_mix_part(spark, sf):
    """Two copies of a document are in one shard about once in eight."""
    from shopfloor.llm.mixing import mix
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shuffle_to_shards(mix(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)))).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.doc_id, []).append(r.shard)
    twice = [s for s in shards.values() if len(s) == 2]
    assert len(twice) > 40 and sum(a == b for a, b in twice) < 0.35 * len(twice)


def test_against_a_second_drawing(spark):
    """The whole assignment, drawn again from the same numbers in plain Python."""
    docs = docs_of(spark, [str(i) for i in range(50)]).repartition(3).persist()
    rows = shuffle_to_shards(docs, n_shards=4, seed=5, bucket_rows=10**6).collect()
    part = {}
    for r in docs.withColumn("m", F.monotonically_increasing_id()).select("doc_id", "m", F.xxhash64(F.lit(5), "m").alias("h")).collect():
        part.setdefault(r.m >> 33, []).append((r.h, r.doc_id))
    counts = [len(part[p]) for p in sorted(part)]
    matrix = communication_matrix(counts, shard_sizes(50, 4), 5)
    want = {}
    for p, to in zip(sorted(part), matrix, strict=True):
        order = [d for _, d in sorted(part[p])]
        for shard, n in enumerate(to):
            for d in order[:n]:
                want[d] = shard
            order = order[n:]
    assert {r.doc_id: r.shard for r in rows} == want
