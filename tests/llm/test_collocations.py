"""Collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from common_data import DOCS, EDGES, edge_docs, sf, sf_docs  # noqa: F401
from pyspark.sql import functions as F
from shopfloor.llm import collocations as co


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(docs, min_count=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for p in split(text):
            n[lang] += len(p)
            for k in (1, 2, 3):
                f[lang].update(tuple(p[i:i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < min_count:
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in c.items() if len(q) > len(p) and b >= min_count and p in (q[:2], q[1:])]
            if not any(100 * b >= 50 * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, None, None) for i, (t, lang) in enumerate(docs)], DOCS)


def test_random_texts_in_small_shards(spark):
    rng = random.Random(13)
    words = ["a", "B", "c", "de", "é", "f-g", "漢", "'"]
    weights = [9, 7, 5, 3, 2, 1, 1, 1]
    docs = [("".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\r"]) for _ in range(rng.randint(0, 60))),
             rng.choice(["en", "de", None])) for _ in range(300)]
    expected = brute(docs)
    assert len(expected) > 50
    df = frame(spark, docs).repartition(4)
    for shard_words in (50, 100_000):
        assert got(co.top_collocations(df, shard_words=shard_words)) == expected
    assert got(co.top_collocations(df, top=3)) == brute(docs, top=3)
    assert got(co.top_collocations(df, min_count=2)) == brute(docs, min_count=2)


def test_given_table(spark, sf, sf_docs):
    assert got(co.op13_collocations(spark, sf)) == brute([(t, lang) for _, t, lang, *_ in sf_docs])


def test_intervals_equal_counting():
    rng = np.random.default_rng(6)
    for n_ids in (3, 40, 2**22):
        text = rng.integers(0, min(n_ids, 40), 500).astype(np.int32)
        text[-1] = 0
        pieces = [[]]
        for x in text.tolist():
            if x:
                pieces[-1].append(x)
            else:
                pieces.append([])
        want = Counter(tuple(p[i:i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        index = co.Index(text, n_ids)
        known = np.ones(len(index.pairs), bool)
        levels = [index.words(), index.extended_right(), index.extended_left(known)]
        have = {tuple(row): c for ids, counts in levels for row, c in zip(ids.tolist(), counts.tolist())}
        assert have == want
        known = rng.random(len(index.pairs)) < 0.5
        pair = {(a, b) for a, b, k in zip(index.first[index.pairs].tolist(), index.second[index.pairs].tolist(), known) if k}
        ids, counts = index.extended_left(known)
        assert dict(zip(map(tuple, ids.tolist()), counts.tolist())) == {p: c for p, c in want.items() if len(p) == 3 and p[:2] in pair and p[1:] in pair}


def test_filter_of_pairs(spark):
    """No pair is missed, few others are taken, and a filter that is too small costs no result."""
    pairs = [("en" if i % 2 else "de", f"w{i % 50} v{i // 50}") for i in range(2000)]
    df = spark.createDataFrame(pairs, "lang string, phrase string")
    bitmap = np.frombuffer(co.pair_filter(df), np.uint8)

    def known(lang, phrases):
        words = [w for p in phrases for w in p.split()]
        even = np.arange(0, len(words), 2)
        return co._known(bitmap, co.pair_hashes(lang, words, even, even + 1))
    for lang in ("en", "de"):
        assert known(lang, [p for x, p in pairs if x == lang]).all()
    assert known("en", [p for x, p in pairs if x == "de"]).mean() < 0.02
    docs = [("a b c d a b c", "en")] * 12
    full = co.shard_counts(frame(spark, docs), 50, b"\xff" * co._PAGE)
    assert got(full.groupBy("phrase").agg(F.sum("a"))) == [("a b c", 24), ("b c d", 12), ("c d a", 12), ("d a b", 12)]


def test_products_past_64_bits(spark):
    """Counts whose products need more than 64 bits, put in as counts."""
    a, l, r, n = 4 * 10**9, 5 * 10**9, 6 * 10**9, 10**11
    rows = [("en", 0, "", n), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 2, "x y", a)]
    counts = spark.createDataFrame(rows, co.COUNTS)
    old = co.phrase_counts
    co.phrase_counts = lambda *_: counts
    try:
        out = got(co.top_collocations(None))
    finally:
        co.phrase_counts = old
    assert out == [("en", 1, "x y", a, l, r, n, 10**6 * a * a // (l * r))]


def test_edges(spark):
    docs = edge_docs(spark).withColumns({c: F.lit("extra") for c in ("a", "phrase", "k", "l", "r", "rank")})
    assert got(co.top_collocations(docs)) == brute([(e[1], e[2]) for e in EDGES])
    assert co.top_collocations(docs.limit(0)).collect() == []
