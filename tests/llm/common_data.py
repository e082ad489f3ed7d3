"""Small tables and fixtures for the tests of the corpus operators."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the input.
CLASHES = ["size", "copies", "target", "rows", "shard", "slot", "th", "n", "c", "root", "key", "keys", "bits", "line", "lines",
           "h1", "spans", "w", "words", "windows", "start", "hash", "marks", "head", "next", "own", "item_id", "n_lines", "part",
           "part_a", "uid", "th2", "removed_words", "score", "lang_pred",
           "__h", "__r", "__th", "__id", "__langid", "__lines", "__part", "__mid", "__mix_n", "__w", "__spans", "__drop", "__ends",
           "at", "k", "times", "in", "mid", "Doc_ID", "TEXT", "a.b", "a`b", "_0_", "_7_"]

LONG = " ".join(f"word{i % 977} and{i % 13}," if i % 11 else f"stop{i}." for i in range(30_000))

EDGES = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\r\n ", "en", None, 5),
    (4, "one", None, "b", 3),
    (5, "12345 !!! 67", "en", "b", 12),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG, "en", "a", len(LONG)),
    (8, "the cat sat on the mat, and the dog did not. it was late.", "en", "b", None),
    (8, "the cat sat on the mat, and the dog did not. it was late.", "en", "b", None),
    (9, "Ünï çødé 漢字。かな、😀 text   sep", "xx", "", 1),
    (10, "a\nb\n\nc\n", "en", "c", 7),
    (None, "no id here at all, none whatsoever", "en", "c", 1),
    (12, "x" * 5000, "de", "c", 5000),
]


def edge_docs(spark, rows=EDGES):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS)
    plain = df.select("*", *[F.lit(f"extra {c}").alias(f"extra{i}") for i, c in enumerate(CLASHES)])
    return plain.toDF(*df.columns, *CLASHES)


def docs_of(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs(spark, sf):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
