"""Best-fit packing: cuts and ids against the tokenizers library, packings against the bounds."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from common_data import DOCS, EDGES, edge_docs, sf, sf_docs  # noqa: F401
from shopfloor.llm import packing
from shopfloor.llm.registry import LLM_QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_library(tokenizer):
    texts = ["", " ", "a", "  two  blanks \n\n and\tlines\r\n", "it's we'll THEY'RE", "<|endoftext|> as text", "x" * 3000, "12,345.67 %", "É Ünï çødé ñ ß",
             "漢字。かな、😀", "\x1c\x1d \x85  ", "a b ­", "퟿ end", " \n" * 50]
    rng = random.Random(4)
    texts += ["".join(rng.choice("ab .,'\n\t\r é9　") for _ in range(200)) for _ in range(100)]
    encode = packing.Encoder(packing.default_tokenizer())
    assert encode.fast is not None
    for t in texts:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_packing_of_the_table(spark, sf, sf_docs, tokenizer):
    rows = LLM_QUERIES["op11_packing"](spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == len(sf_docs)
    for doc_id, text, *_ in sf_docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) == list(range(-(-len(ids) // 1024)))
        assert mine[0].start == 0 and all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert mine[-1].start + mine[-1].length == len(ids)
    used = check_sequences(rows, 1024)
    needed = packing.bins_needed(np.bincount([r.length for r in rows], minlength=1025), 1024)
    assert needed <= used <= 1.01 * needed + 1


def fewest_bins(lengths, capacity):
    """Exact, by branching over the bin of each length."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for f in sorted(set(fills)):
            if f + lengths[i] <= capacity:
                rest = list(fills)
                rest.remove(f)
                place(i + 1, rest + [f + lengths[i]])
        place(i + 1, fills + [lengths[i]])

    place(0, [])
    return best


def test_bounds_never_pass_the_fewest_bins():
    rng = random.Random(11)
    met = 0
    for _ in range(200):
        capacity = rng.choice([7, 10, 16])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        fewest, bound = fewest_bins(lengths, capacity), packing.bins_needed(counts, capacity)
        bins, offsets, fills = packing.best_fit_decreasing(np.array(lengths), capacity)
        assert bound <= fewest <= len(fills)
        assert fills.max() <= capacity and all(sum(x for x, y in zip(lengths, bins) if y == b) == f for b, f in enumerate(fills))
        met += bound == fewest
    assert met > 180


def test_best_fit_decreasing_is_what_it_says():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 100, 400)
    fills = []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = [i for i, f in enumerate(fills) if f + n <= 100]
        if fit:
            fills[max(fit, key=lambda i: fills[i])] += n
        else:
            fills.append(n)
    assert sorted(packing.best_fit_decreasing(lengths, 100)[2].tolist()) == sorted(fills)


@pytest.mark.parametrize("kind", ["mixed", "one length", "halves"])
def test_exchange_saves_sequences(spark, kind):
    """Many small partitions come near what one partition needs, or are certified."""
    length = {"mixed": F.pmod(F.xxhash64("id"), F.lit(97)) + 3, "one length": F.lit(37), "halves": F.when(F.col("id") % 2 == 0, 60).otherwise(40)}[kind]
    sizes = spark.range(5000).select(F.col("id").alias("uid"), length.cast("long").alias("length"))
    rows = packing.pack(sizes, 100, part_rows=100).join(sizes, "uid").collect()
    assert len(rows) == 5000 == len({r.uid for r in rows})
    used = check_sequences(rows, 100)
    needed, f, whole = packing.best_bound(np.bincount([r.length for r in rows], minlength=101), 100)
    apart = packing.pin(packing._packed(sizes, 50, 100, 0, f, whole), "apart")
    assert used <= packing._bins(apart) and (kind != "halves" or used < packing._bins(apart) - 50)
    assert needed <= used <= 1.03 * needed + 2


def test_edges(spark):
    rows = packing.pack_documents(edge_docs(spark)).collect()
    assert check_sequences(rows, 1024) > 0
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert len(r.ids) == r.length
    assert whole[1] == whole[2] == 1 and len(whole) == len({e[0] for e in EDGES})
    assert sum(r.doc_id == 8 for r in rows) == 2 and None in whole
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).collect() == []
    out = packing.sequences(packing.pack_documents(edge_docs(spark))).collect()
    assert sum(len(r.ids) for r in out) == sum(whole.values())
    assert all(len(r.ids) <= 1024 and r.ids[-1] is not None for r in out)


def test_other_capacities_and_vocabularies(spark):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(edge_docs(spark), tokenizer=path, capacity=64, end_id=0).collect()
    check_sequences(rows, 64)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for doc_id, text, *_ in EDGES:
        if doc_id in (8, None):
            continue
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 0]
