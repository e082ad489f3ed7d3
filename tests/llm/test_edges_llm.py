"""Every operator and stage on nulls, blanks, long texts, repeats, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from common_data import CLASHES, DOCS, EDGES, edge_docs
from shopfloor.llm import decontaminate, jaccard, langid, lines, mixing, sharding, substring, syncmers, urls, warc

BENCH = [(1, "the cat sat on the mat, and the dog did not"), (2, None), (3, "short one"), (4, "")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string").withColumn("w", F.lit(1))


OPERATORS = {
    "mix plan": lambda s, d: mixing.mixing_plan(d),
    "mix": lambda s, d: mixing.mix(d),
    "substring": lambda s, d: substring.dedup_substrings(d),
    "jaccard": lambda s, d: jaccard.jaccard_classes(d),
    "one of each": lambda s, d: jaccard.keep_one_of_each(d),
    "lines": lambda s, d: lines.dedup_lines(d, min_texts=2),
    "leaks": lambda s, d: decontaminate.find_leaks(d, bench(s)),
    "drop leaking": lambda s, d: decontaminate.drop_leaking(d, bench(s)),
    "syncmers": lambda s, d: syncmers.fingerprint_documents(d),
    "shards": lambda s, d: sharding.shuffle_to_shards(d),
    "langid": lambda s, d: langid.identify(d),
    "keep known": lambda s, d: langid.keep_known(d),
}
KEEP_COLUMNS = {"mix", "one of each", "drop leaking", "keep known"}


@pytest.fixture(scope="module")
def results(spark):
    done = {}

    def run(name):
        if name not in done:
            df = OPERATORS[name](spark, edge_docs(spark))
            done[name] = (df.columns, df.collect())
        return done[name]
    return run


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(results, name):
    columns, rows = results(name)
    assert len(columns) == len(set(columns))
    if name in KEEP_COLUMNS:
        assert columns == [x.split()[0] for x in DOCS.split(", ")] + CLASHES
        assert all(r[f"{c}"] == f"extra {c}" for r in rows for c in CLASHES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    df = OPERATORS[name](spark, edge_docs(spark, []))
    assert df.collect() == [] and "doc_id" in df.columns


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x or 0))


ALL_IDS = sorted((r[0] for r in EDGES), key=lambda x: (x is None, x or 0))


@pytest.mark.parametrize("name", ["substring", "jaccard", "lines", "syncmers", "shards", "langid"])
def test_a_row_for_every_document(results, name):
    assert ids(results(name)[1]) == ALL_IDS


def test_defined_results(results):
    classes = {r.doc_id: (r.n_shingles, r.component_id) for r in results("jaccard")[1]}
    assert classes[1] == (0, 1) and classes[2] == (0, 2) and classes[3] == (0, 3)
    assert classes[4] == (1, 4) and classes[7][1] == 6 and classes[8][1] == 8
    assert ids(results("one of each")[1]) == [i for i in ALL_IDS if i != 7]
    assert {r.doc_id for r in results("leaks")[1]} == {8} and len(results("leaks")[1]) == 1
    assert ids(results("drop leaking")[1]) == [i for i in ALL_IDS if i != 8]
    und = {r.doc_id for r in results("langid")[1] if r.lang_pred == "und"}
    assert und == {1, 2, 3, 5} and all(r.score == 0 for r in results("langid")[1] if r.lang_pred == "und")
    marks = {r.doc_id: r for r in results("syncmers")[1]}
    assert marks[1].fingerprint == marks[2].fingerprint == "" and marks[1].n_chars == 0
    assert marks[6].fingerprint == marks[7].fingerprint and marks[6].near_next == 1.0
    assert marks[None].near_next == 0.0 and marks[None].near_edited == 1.0
    texts = {r.doc_id: r for r in results("substring")[1]}
    assert texts[1].text is None and texts[2].text == "" and texts[8].removed_sentences == 0
    assert texts[7].removed_sentences == texts[7].n_sentences
    kept = {r.doc_id: r for r in results("lines")[1]}
    assert kept[1].text is None and kept[1].n_lines == 0 and kept[10].text == "a\nb\n\nc\n"


def test_pages_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "x"), (4, "http://A.EXAMPLE.ORG?q", None), (4, "http://A.EXAMPLE.ORG?q", None),
            (5, "https://x.com/fr/1#f", "a\r\n\r\nb\r\n"), (None, "ftp://org/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("host", "rule", "keys", "held")})
    got = sorted(urls.judge_urls(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got] == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "a.example.org", "", None, "allow"), (4, "a.example.org", "", None, "allow"),
        (5, "x.com", "/fr/1", "com/fr/", "allow"), (None, "org", "/", "org/", "allow")]
    assert urls.judge_urls(pages.limit(0)).collect() == []
    records = warc.resolve_revisits(warc.page_records(pages))
    by = {}
    for r in records.collect():
        by.setdefault(r.page_id, set()).add((r.record_type, r.refers_to))
    assert by[1] == by[2] == {("revisit", 4)} and by[4] == {("response", None)}
    assert by[None] == {("revisit", 3)} and by[3] == {("response", None)}
