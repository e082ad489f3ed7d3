import hashlib
import random
import re

import xxhash

from common_data import docs_of, sf, sf_docs  # noqa: F401
from shopfloor.llm.syncmers import K, S, fingerprint_documents, op8_syncmers


def h64(word):
    """Spark's xxhash64 of a string."""
    seed = xxhash.xxh64_intdigest(word.encode(), 42)
    return seed - 2**64 if seed >= 2**63 else seed


def hl(*longs):
    """Spark's xxhash64 of longs."""
    seed = 42
    for v in longs:
        seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_marks(text, k=K, s=S):
    words = [h64(w) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [hl(*words[i:i + s]) for i in range(len(words) - s + 1)]
    span = k - s
    at = [i for i in range(len(windows) - span) if min(windows[i], windows[i + span]) <= min(windows[i:i + span + 1])]
    kmer = lambda i: hl(*[windows[i + j] for j in [*range(0, span, s), span]])
    if len(at) > 1:
        out = []
        for a, b in zip(at, at[1:], strict=False):
            seed = xxhash.xxh64_intdigest((b - a).to_bytes(4, "little"), hl(kmer(a), kmer(b)) % 2**64)
            out.append(seed)
    else:
        out = [kmer(at[0])] if at else [hl(*words)] if words else []
    return list(dict.fromkeys((m % 2**64) & 0x7FFFFFFF for m in out))


def likeness(a, b):
    return 2 * len(set(a) & set(b)) / (len(a) + len(b)) if a or b else 1.0


def test_contract_on_the_table(spark, sf, sf_docs):
    rows = {r.doc_id: r for r in op8_syncmers(spark, sf).collect()}
    order = sorted(d for d, *_ in sf_docs)
    texts = {d: t or "" for d, t, *_ in sf_docs}
    assert sorted(rows) == order
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        r, n = rows[d], len(texts[d])
        edited = texts[d][:n - n // 4] + texts[after][:n // 4]
        own, other, nxt = brute_marks(texts[d]), brute_marks(edited), brute_marks(texts[after])
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{m:08x}" for m in own) and r.edited_fingerprint == "".join(f"{m:08x}" for m in other)
        assert abs(r.near_edited - likeness(own, other)) < 1e-12 and abs(r.near_next - likeness(own, nxt)) < 1e-12


def test_anchors_do_not_depend_on_context(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    shared = prose(400)
    a, b = brute_marks(" ".join(prose(150) + shared + prose(90))), brute_marks(" ".join(prose(33) + shared + prose(300)))
    inner = brute_marks(" ".join(shared))
    assert set(inner) <= set(a) and set(inner) <= set(b) and len(inner) > 80


def test_equal_texts_and_one_document(spark):
    rows = {r.doc_id: r for r in fingerprint_documents(docs_of(spark, ["a b c", "a b c", None, "x " * 500])).collect()}
    assert rows[0].fingerprint == rows[1].fingerprint and rows[0].near_next == 1.0
    alone = fingerprint_documents(docs_of(spark, ["one two three four"])).collect()
    assert alone[0].near_next == 1.0


def test_texts_are_shuffled_once(spark, tmp_path):
    """Both joins by doc_id use the one exchange of the texts, also when there are other columns."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"some words of text {i} " * 9, "x") for i in range(40)], "doc_id long, text string, lang string").write.parquet(path)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fingerprint_documents(spark.read.parquet(path))
        assert len(df.collect()) == 40
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "ReusedExchange [doc_id" in plan
