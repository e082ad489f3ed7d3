import itertools
import random

import numpy as np

from common_data import docs_of, sf, sf_docs  # noqa: F401
from shopfloor.llm import jaccard
from shopfloor.llm.components import components
from shopfloor.llm.jaccard import SignatureTree, bitmap, jaccard_classes, keep_one_of_each, op4_jaccard, traverse

_TR = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_TR))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent=85, n=4):
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(n, seed=1):
    """Groups around a text, chains of copies of copies, and strangers."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    while len(texts) < n:
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 20, 60, 150]))]
        texts.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 8])):
            copy = list(base if rnd.random() < 0.5 else texts[-1].split())
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy) if rnd.random() < 0.8 else " ".join(copy).upper())
    return texts[:n]


def test_contract_on_the_table(spark, sf, sf_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op4_jaccard(spark, sf).collect()}
    assert got == brute([(d, t) for d, t, *_ in sf_docs])


def test_groups_chains_and_split_blocks(spark):
    texts = near_copies(700)
    want = brute(list(enumerate(texts)))
    assert len({c for _, c in want.values()}) < 650
    for options in ({}, {"block": 3}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs_of(spark, texts), **options).collect()}
        assert got == want


def test_five_words_and_eighty_percent(spark):
    texts = near_copies(300, seed=2)
    want = brute(list(enumerate(texts)), percent=80, n=5)
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.component_id for r in jaccard_classes(docs, percent=80, n=5, bands=45).collect()}
    assert got == {d: c for d, (_, c) in want.items()}
    kept = keep_one_of_each(docs, percent=80, n=5, bands=45)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_traversal_loses_no_link_between_classes():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    sets = []
    for _ in range(300):
        s = base if rng.random() < 0.5 else rng.integers(0, 2**63, rng.integers(5, 200), dtype=np.uint64)
        s = s.copy()
        edit = rng.random(len(s)) < rng.choice([0, 0.03, 0.1, 0.3])
        s[edit] = rng.integers(0, 2**63, edit.sum(), dtype=np.uint64)
        sets.append(np.unique(s))
    size = np.array([len(s) for s in sets])
    words = np.stack([np.frombuffer(bitmap(s).tobytes(), np.uint64) for s in sets])
    root = rng.integers(0, 40, len(sets))
    tree = SignatureTree(size, words, root)
    found = {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, traverse(tree, tree, True, 85)), strict=True)}
    halves = [np.arange(0, 150), np.arange(150, 300)]
    trees = [SignatureTree(size[h], words[h], root[h]) for h in halves]
    i, j = traverse(*trees, False, 85)
    across = set(zip(halves[0][i].tolist(), halves[1][j].tolist(), strict=True))
    links = 0
    for a, b in itertools.combinations(range(300), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if root[a] != root[b] and 100 * common >= 85 * (size[a] + size[b] - common):
            links += 1
            assert (a, b) in found
            assert a >= 150 or b < 150 or (a, b) in across
        if root[a] == root[b]:
            assert (a, b) not in found
    assert links > 500 and len(found) < 2.5 * links


def test_a_large_group_of_near_copies(spark):
    """Copies of one text, each with its own edits: no pair per two copies."""
    rnd = random.Random(4)
    base = [f"w{rnd.randint(0, 500)}" for _ in range(120)]
    texts = []
    for i in range(400):
        copy = list(base)
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(120)] = f"x{i}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in jaccard_classes(docs_of(spark, texts)).collect()}
    assert got == {d: c for d, (_, c) in brute(list(enumerate(texts))).items()}


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, 1000 + i) for i in range(1, 200)] + [
        (rnd.randint(2000, 2300), rnd.randint(2000, 2300)) for _ in range(250)] + [(5, 4), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_chance_of_missing_a_link_is_negligible():
    for percent, bands in ((85, jaccard.BANDS), (80, 45)):
        assert (1 - (percent / 100) ** jaccard.ROWS) ** bands < 1e-10
