import zlib

import numpy as np
from pyspark.sql import functions as F

from shopfloor.llm.langid import Encoder, fit_prototypes, identify, keep_known, op10_langid, unit

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op10_langid(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "fr", "de", "es", "und"} for r in rows)
    tested = [r for r in rows if r.held_out and truth[r.doc_id]]
    right = sum(r.lang_pred == truth[r.doc_id] for r in tested)
    assert len(tested) > 250 and right >= 0.98 * len(tested)


def test_prediction_uses_the_text_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).persist()
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = docs.withColumns({"lang": F.when(held, F.lit("xx")).otherwise(F.col("lang")), "source": F.lit("same"), "n_chars": F.lit(0)})
    rows = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in identify(df).collect())
    assert rows(docs) == rows(other) == rows(docs.repartition(5))


def test_sample_is_bounded_and_every_language_is_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert list(fit_prototypes(docs, sample_per_lang=20)) == ["de", "en", "es", "fr"]


def test_pieces_add_up_to_the_text(monkeypatch):
    import shopfloor.llm.langid as m
    e = Encoder(dim=64)
    texts = ["The quick brown fox jumps over 13 lazy dogs. " * 40, "", "a", "é漢字 😀 ok", None]
    whole = e.encode(texts)
    monkeypatch.setattr(m, "PIECE", 7)
    monkeypatch.setattr(m, "BATCH", 50)
    assert np.array_equal(whole, Encoder(dim=64).encode(texts))
    assert whole[1].any() == whole[4].any() == False  # noqa: E712


def test_binding_follows_the_order_of_letters():
    e = Encoder()
    v = unit(e.encode(["abcabcabc", "cbacbacba", "ABC abc abc!", "abc"]))
    assert v[0] @ v[1] < 0.35 and v[2] @ v[3] > 0.9
    a, b, c, z = (e.vector(ord(x)) if x else e.vector(0) for x in ("a", "b", "c", ""))
    want = sum(np.roll(x, 2) * np.roll(y, 1) * w for x, y, w in ((z, a, b), (a, b, c), (b, c, z)))
    assert np.array_equal(e.encode(["abc"])[0], want)


def test_unknown_texts_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "123 !!!", "en"), (-3, "漢字仮名交文" * 50, "en")], docs.schema)
    kept = keep_known(docs.unionByName(odd), min_score=0.05, sample_per_lang=100)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.unionByName(odd).join(kept, "doc_id", "left_anti").collect()}
    assert {-1, -2} <= gone and len(gone) <= 4
