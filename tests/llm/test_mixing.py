import math

from pyspark.sql import functions as F

from common_data import docs_of, sf, sf_docs  # noqa: F401
from shopfloor.llm.mixing import cyclic_weights, mix, mixing_plan, op1_mix, share_targets, source_order


def brute_targets(sizes):
    """Round by round, as the contract says it."""
    names = source_order(list(sizes))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target = {s: total * weights[s] / sum(weights.values()) for s in names}
    for _ in range(len(names) + 1):
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        excess = sum(target[s] - 3 * sizes[s] for s in over)
        capped = {s for s in names if target[s] >= 3 * sizes[s] - 1e-9}
        free = [s for s in names if s not in capped]
        for s in over:
            target[s] = 3 * sizes[s]
        for s in free:
            target[s] += excess * weights[s] / sum(weights[x] for x in free)
    return target


def test_targets_equal_the_rounds():
    for sizes in ({"a": 100, "b": 5, "c": 50, None: 1}, {"a": 1, "b": 1000, "c": 1000}, {"x": 0, "y": 10}, {"x": 0}, {}):
        got, want = share_targets(sizes, cyclic_weights(list(sizes))), brute_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9)


def test_contract_on_the_table(spark, sf, sf_docs):
    import re
    rows = {r.doc_id: r for r in op1_mix(spark, sf).collect()}
    sizes, by_source = {}, {}
    for d, text, _, source in sf_docs:
        sizes[d] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        by_source[source] = by_source.get(source, 0) + sizes[d]
    targets = brute_targets(by_source)
    assert rows.keys() == sizes.keys()
    taken = {}
    for d, _, _, source in sf_docs:
        r = rows[d]
        assert (r["size"], r.source_size) == (sizes[d], by_source[source]) and math.isclose(r.target, targets[source], rel_tol=1e-9)
        share = r.target / r.source_size if r.source_size else 0
        assert math.floor(share + 1e-9) * r["size"] <= r.taken <= math.ceil(share - 1e-9) * r["size"] <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    for source, words in taken.items():
        largest = max(sizes[d] for d, _, _, s in sf_docs if s == source)
        assert abs(words - targets[source]) <= largest
    again = {r.doc_id: r.taken for r in op1_mix(spark, sf).collect()}
    assert again == {d: r.taken for d, r in rows.items()}


def test_layout_does_not_change_the_draw(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    copies = lambda df: {(r.doc_id, r.source): r.copies for r in mixing_plan(df).collect()}
    assert copies(docs) == copies(docs.repartition(7))


def test_mix_emits_the_planned_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r.doc_id: r.copies for r in mixing_plan(docs).collect() if r.copies}
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == plan
    assert mixed.join(docs, docs.columns, "left_anti").count() == 0


def test_a_source_with_a_third_of_the_rows(spark):
    docs = docs_of(spark, [f"w{i} " * (1 + i % 17) for i in range(3000)]).withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 40)))
    got = mixing_plan(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("w")).collect()
    assert all(abs(r.t - r.w) <= 17 for r in got)


def test_repeated_rows_meet_the_target(spark):
    """1,000 rows without id and of equal size: each is taken floor or ceil times, and the words meet the target."""
    rows = [(None, "five words are in here", "en", "a", 1)] * 1000 + [(i, "one two", "en", "b", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    plan = mixing_plan(docs).collect()
    hot = next(r for r in plan if r.source == "a")
    assert hot.rows == 1000 and abs(hot.copies * 5 - hot.target) <= 5
    mixed = mix(docs).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in mixed} == {s: sum(r.copies for r in plan if r.source == s) for s in "ab"}


def test_rows_of_a_group_share_its_copies(spark):
    rows = [(1, "a b", "en", "s", i) for i in range(100)] + [(i, "c d e f", "en", "t", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    total = next(r.copies for r in mixing_plan(docs).collect() if r.source == "s")
    times = {r.n_chars: r["count"] for r in mix(docs).filter("source = 's'").groupBy("n_chars").count().collect()}
    assert sum(times.values()) == total and {times.get(i, 0) for i in range(100)} <= {total // 100, total // 100 + 1}
