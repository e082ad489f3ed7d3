"""The stages against their brute-force versions, each on its own input."""

import pytest

from common_data import sf  # noqa: F401
import corpus_pipeline
from shopfloor.llm.langid import identify
from shopfloor.llm.mixing import mixing_plan
from test_decontaminate import brute as leaks
from test_jaccard import brute as classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows into and out of each stage, written and read between."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames, d = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        out = str(d / name.replace(" ", "_"))
        stage(spark, frames[-1], sf).write.parquet(out)
        frames.append(spark.read.parquet(out))
    return frames


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "near duplicates", "decontamination", "mixing", "sharding"]
    assert all(f.columns == COLUMNS for f in stages[:5]) and stages[5].columns == [*COLUMNS, "shard", "slot"]


def test_language(stages):
    kept = sorted(r.doc_id for r in identify(stages[0]).collect() if r.lang_pred != "und" and r.score >= 0.05)
    assert ids(stages[1]) == kept and len(kept) >= 0.99 * stages[0].count()


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == sorted({c for _, c in classes(rows, percent=80, n=5).values()})


def test_decontamination(spark, sf, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {d for d, _ in leaks([(r.doc_id, r.text) for r in stages[2].collect()], items)}
    assert gone and ids(stages[3]) == [d for d in ids(stages[2]) if d not in gone]


def test_mixing(stages):
    plan = {r.doc_id: r.copies for r in mixing_plan(stages[3]).collect()}
    assert ids(stages[4]) == sorted(d for d, n in plan.items() for _ in range(n))


def test_sharding(stages):
    assert ids(stages[5]) == ids(stages[4])
    rows = stages[5].collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(slots) == 8 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_equals_the_stages(spark, sf, stages):
    key = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    out = corpus_pipeline.run(spark, sf)
    assert key(out) == key(stages[5]) and out.columns == stages[5].columns
