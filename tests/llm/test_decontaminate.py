import random
import re
from collections import Counter

from pyspark.sql import functions as F

from common_data import docs_of, sf, sf_docs  # noqa: F401
from shopfloor.llm.decontaminate import block_masks, drop_leaking, find_leaks, op7_decontaminate, simhash, weighted_jaccard


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bag(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items, threshold=0.8, min_words=8):
    """Best similarity over every item-sized window of every document."""
    out = {}
    for i, text in items:
        w = words(text)
        if len(w) < min_words:
            continue
        want, n = bag(w), len(w)
        for d, doc in docs:
            dw = words(doc)
            if not set(zip(*(dw[k:] for k in range(5)), strict=False)) & set(want):
                continue
            best = max((similarity(bag(dw[s:s + n]), want) for s in range(max(1, len(dw) - n + 1))), default=0)
            if best >= threshold - 1e-12:
                out[(d, i)] = best
    return out


def planted(seed, edits):
    rnd = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(800)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(prose(rnd.randint(8, 60)))) for i in range(25)]
    docs = []
    for d in range(150):
        body = prose(rnd.randint(0, 200))
        if d % 3 == 0:
            passage = rnd.choice(items)[1].split()
            for _ in range(rnd.randint(0, edits)):
                k = rnd.randrange(len(passage))
                passage[k:k + 1] = rnd.choice([[], [rnd.choice(vocab)], [passage[k].upper() + "!?", "-"]])
            at = rnd.randint(0, len(body))
            body[at:at] = passage
        docs.append((d, " ".join(body)))
    return docs, items


def run(spark, docs, items, **options):
    rows = find_leaks(docs_of(spark, [t for _, t in docs]), spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r for r in rows}


def test_whole_passages_equal_brute_force(spark):
    docs, items = planted(1, 0)
    got, want = run(spark, docs, items), brute(docs, items)
    assert got.keys() == want.keys() and len(want) >= 50
    for k, r in got.items():
        assert abs(r.similarity - want[k]) < 1e-9 and r.hamming == 0
        assert words(docs[k[0]][1])[r.start_word:r.start_word + r.n_words] == words(dict(items)[k[1]])


def test_edited_passages_equal_brute_force(spark):
    docs, items = planted(2, 2)
    want = brute(docs, items)
    assert 25 <= len(want) and any(v < 1 for v in want.values())
    for options in ({}, {"broadcast_rows": 0}):
        got = run(spark, docs, items, **options)
        assert got.keys() == want.keys()
        assert all(got[k].similarity <= want[k] + 1e-9 for k in want)


def test_table_finds_every_whole_item(spark, sf, sf_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op7_decontaminate(spark, sf).collect()}
    assert got == set(brute([(d, t) for d, t, *_ in sf_docs], items))


def test_drop_leaking_keeps_clean_documents(spark):
    docs, items = planted(3, 0)
    kept = drop_leaking(docs_of(spark, [t for _, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _ in docs if d not in {d for d, _ in brute(docs, items)}]


def test_a_passage_in_a_third_of_the_documents(spark):
    item = "ten words stand in this item of the small benchmark table"
    docs = [(i, f"own{i} {item} more{i}" if i % 3 == 0 else f"nothing{i} to see here{i} at all in this text {i}") for i in range(600)]
    assert len(run(spark, docs, [(1, item), (2, item)])) == 400


def test_simhash_and_similarity(spark):
    rnd = random.Random(5)
    rows = [([rnd.getrandbits(63) - 2**62 for _ in range(rnd.randint(1, 9))] * 1, ) for _ in range(20)]
    rows = [(a, [rnd.choice(a) for _ in a] + a[:2]) for (a,) in rows]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    for a, b, h, s in df.select("a", "b", simhash(F.col("a")), weighted_jaccard(F.col("a"), F.col("b"))).collect():
        bits = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in a) > len(a))
        assert h % 2**64 == bits and abs(s - similarity(Counter(a), Counter(b))) < 1e-12


def test_blocks_cover_every_bit_once():
    masks = [m % 2**64 for m in block_masks(18)]
    assert len(masks) == 19 and sum(masks) == 2**64 - 1 and all(masks)


def test_shorter_texts_and_swapped_halves_equal_brute_force(spark):
    rnd = random.Random(7)
    prose = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    items, docs = [], []
    for i in range(12):
        item = prose(60)
        items.append((i, " ".join(item)))
        docs += [item[:50], item[10:], item[:46],  # similarities 0.82, 0.82 and 0.75
                 prose(30) + item[30:] + item[:30] + prose(30), prose(9) + item[20:] + item[:20],
                 prose(20) + item[:25] + prose(1) + item[25:] + prose(20), prose(100)]
    docs = [(d, " ".join(w)) for d, w in enumerate(docs)]
    want = brute(docs, items)
    for options in ({}, {"broadcast_rows": 0}):
        got = run(spark, docs, items, **options)
        assert got.keys() == want.keys() and {d % 7 for d, _ in got} == {0, 1, 3, 4, 5}
        assert all(abs(got[k].similarity - want[k]) < 1e-9 for k in want)
