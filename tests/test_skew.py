"""One key holding a third of all rows: the operators that split hot groups
(two-level ledger and sessions, pre-aggregated deductions, class-based
match) must still give exact results, checked against plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shopfloor.operators import catalog, inventory
from shopfloor.operators.sessions import sessionize


def _rows(n, hot_share=1 / 3, seed=11):
    rnd = random.Random(seed)
    keys = ["HOT" if rnd.random() < hot_share else f"K{rnd.randint(1, 40)}" for _ in range(n)]
    return rnd, keys


def test_ledger_with_a_hot_sku(spark):
    rnd, keys = _rows(3000)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20)), i, rnd.choice([-9, -4, -1, 3, 6]), 5)
            for i, k in enumerate(keys)]
    moves = spark.createDataFrame(rows, "sku string, ts timestamp, seq int, delta bigint, s0 bigint")
    got = {(r["sku"], r["seq"]): r["stock"] for r in
           inventory.floor_ledger(moves, "sku", ["ts", "seq"], [F.date_trunc("day", F.col("ts"))],
                                  F.date_trunc("week", F.col("ts"))).collect()}
    for sku in set(keys):
        s = 5
        for r in sorted((r for r in rows if r[0] == sku), key=lambda r: (r[1], r[2])):
            s = max(0, s + r[3])
            assert got[(sku, r[2])] == s


def test_ledger_of_a_hot_sku_over_several_parts(spark):
    """A SKU whose rows lie in several tasks; rows are moved when they are dealt, and not again."""
    rnd, keys = _rows(3000)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20)), i, rnd.choice([-9, -4, -1, 3, 6]), 5)
            for i, k in enumerate(keys)]
    moves = spark.createDataFrame(rows, "sku string, ts timestamp, seq int, delta bigint, s0 bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = inventory.floor_ledger(moves, "sku", ["ts", "seq"], [F.date_trunc("hour", F.col("ts"))], F.date_trunc("week", F.col("ts")))
        got = {(r["sku"], r["seq"]): r["stock"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows)
    for sku in set(keys):
        s = 5
        for r in sorted((r for r in rows if r[0] == sku), key=lambda r: (r[1], r[2])):
            s = max(0, s + r[3])
            assert got[(sku, r[2])] == s
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Relation") == 0 and plan.count("FileScan") == 2  # the written rows: once for the summary, once for the result
    assert all("Bucketed: true" in x for x in plan.splitlines() if "FileScan" in x)
    moved = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("- Exchange hashpartitioning")
    assert moved == 1  # a row a SKU and part


def test_sessions_with_a_hot_user(spark):
    rnd, keys = _rows(3000)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=rnd.randint(0, 86400 * 3))) for k in keys]
    rows += [("HOT", rows[0][1])] * 50  # many events at one instant
    ev = spark.createDataFrame(rows, "user string, ts timestamp")
    got = sorted((r["user"], r["session_start"], r["events"]) for r in sessionize(ev, "user", "ts").collect())
    want = []
    for u in set(k for k, _ in rows):
        ts = sorted(t for k, t in rows if k == u)
        start, n, prev = ts[0], 0, ts[0]
        for t in ts:
            if (t - prev).total_seconds() > 900:
                want.append((u, start, n))
                start, n = t, 0
            n, prev = n + 1, t
        want.append((u, start, n))
    assert got == sorted(want)


def test_deduct_with_a_hot_sku(spark):
    rnd, keys = _rows(2000)
    lines = spark.createDataFrame([(i, 1, k, float(rnd.randint(1, 3))) for i, k in enumerate(keys)],
                                  "row_pos bigint, line_no int, sku string, quantity double")
    vault = spark.createDataFrame([(i, k, "500") for i, k in enumerate(sorted(set(keys)))],
                                  "row_pos bigint, sku string, stock_text string")
    got = {r["sku"]: r["sold_qty"] for r in inventory.stock_deduct(vault, lines).collect()}
    want = {}
    for r in lines.collect():
        want[r["sku"]] = want.get(r["sku"], 0) + int(r["quantity"])
    assert got == want


def test_match_with_a_hot_signature(spark):
    # a third of the catalogue has identical tags: one item class
    items = [(i, "Ring, gold band" if i % 3 == 0 else f"Bangles, item{i} red") for i in range(300)]
    vault = spark.createDataFrame(items, "row_pos bigint, tags string").withColumn("sku", F.col("row_pos").cast("string"))
    queries = spark.createDataFrame([(1, "gold ring"), (2, "red"), (3, "item7 red"), (4, "band band")],
                                    "query_id bigint, query string")
    got = {r["query_id"]: (r["row_pos"], r["score"]) for r in catalog.catalog_match(queries, vault).collect()}
    assert got == {1: (0, 2), 2: (1, 1), 3: (7, 2), 4: (0, 2)}


def _brute_match(queries, tags):
    want = {}
    for i, text in enumerate(queries):
        scores = [sum(t in tag for t in text.split()) for tag in tags]
        if max(scores):
            want[i] = (scores.index(max(scores)), max(scores))
    return want


def _match(spark, queries, tags):
    vault = spark.createDataFrame(list(enumerate(tags)), "row_pos long, tags string").withColumn("sku", F.lit("S"))
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    return {r["query_id"]: (r["row_pos"], r["score"]) for r in catalog.catalog_match(q, vault).collect()}


def test_match_of_wide_and_narrow_sets(spark):
    """Sets on both sides of the limit of pairs, tokens in tokens, repeats and ties."""
    rnd = random.Random(8)
    vocab = [f"{a}{i}" for i in range(70) for a in ("v", "wv", "x")]
    size = lambda: rnd.choice([1, 2, 5, 20, 60, 120])
    tags = [" ".join(rnd.choices(vocab, k=size())) for _ in range(120)] + [" ".join(vocab[:90])] * 2
    queries = [" ".join(rnd.choices(vocab, k=size())) for _ in range(120)] + [" ".join(vocab[:90]), "none such"]
    assert _match(spark, queries, tags) == _brute_match(queries, tags)


def test_match_of_long_runs_and_long_tokens(spark):
    """Tokens across the borders of pieces, tokens longer than a piece, tokens of one and two characters."""
    rnd = random.Random(9)
    run = "".join(rnd.choices("abcdefghij", k=2000))
    near = run[:900] + "z" + run[901:]
    tags = [near, run, "ab " + run[300:700]]
    queries = [run[s:s + n] for n in (1, 2, 3, 40, 64, 65, 127, 128, 129, 800) for s in (0, 61, 500, 890, 1150)]
    queries += [" ".join(queries[k::7]) for k in range(7)]
    assert _match(spark, queries, tags) == _brute_match(queries, tags)


def test_match_of_twenty_thousand_tokens_in_one_text(spark):
    words = [f"t{i:05d}" for i in range(20000)]
    tags = [" ".join(words), " ".join(words[:15000]), "t00001 t00002"]
    queries = [" ".join(words), " ".join(words[:15000]), "t00002 t00001", "t19999 t00001 q"]
    assert _match(spark, queries, tags) == {0: (0, 20000), 1: (0, 15000), 2: (0, 2), 3: (0, 2)}
