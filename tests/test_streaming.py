"""Streaming behaviour beyond the oracle keys: late data (T7) and
incremental batches (T4/T6 state across micro-batches)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shopfloor.streaming import runner


def _late_source(spark, tmp_path):
    src = str(tmp_path / "src")
    os.makedirs(src, exist_ok=True)
    schema = "ts timestamp, amount double"
    day = dt.datetime(2024, 1, 10)
    spark.createDataFrame([(day, 1.0), (day + dt.timedelta(days=5), 2.0)], schema).coalesce(1) \
        .write.mode("append").parquet(src)
    spark.createDataFrame([(day - dt.timedelta(days=5), 4.0), (day + dt.timedelta(days=4), 8.0)], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
         .withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w")).agg(F.sum("amount").alias("a")))
    return s.select(F.col("w.start").alias("day"), "a")


def _late_source_schema():
    from pyspark.sql import types as T
    return T.StructType([T.StructField("day", T.TimestampType()), T.StructField("a", T.DoubleType())])


def test_late_rows_complete_mode_equals_batch_recompute(spark, tmp_path):
    """Complete mode keeps every window -- a back-dated row is included,
    as when the reference recomputes all."""
    out = runner.run_stream(spark, _late_source(spark, tmp_path), "late_complete", "complete")
    got = {r["day"].day: r["a"] for r in runner.read_output(spark, out, "complete", _late_source_schema()).collect()}
    assert got == {10: 1.0, 15: 2.0, 5: 4.0, 14: 8.0}


def test_append_mode_holds_windows_until_watermark(spark, tmp_path):
    """T7, production form: a window is emitted once the watermark (max event
    time - 2 days = Jan 13 after the first file) passes its end; windows
    still open are held back.  Rows older than the watermark are not
    guaranteed to be dropped (Spark only guarantees rows within the delay
    are kept), so nothing is asserted about the back-dated row."""
    out = runner.run_stream(spark, _late_source(spark, tmp_path), "late_append", "append")
    got = {r["day"].day: r["a"] for r in spark.read.parquet(out).collect()}
    assert got.get(10) == 1.0
    assert 14 not in got and 15 not in got


MOVES = ("sku string, event_ts timestamp, l_orderkey bigint, l_linenumber int, l_suppkey bigint, "
         "l_extendedprice double, delta bigint, s0 bigint")


def _stock_stream(spark, tmp_path, batches):
    """One file per micro-batch, in arrival order."""
    from shopfloor.streaming.queries import chunked, read_stock, run_stock
    src = str(tmp_path / "moves")
    for b in batches:
        spark.createDataFrame(b, MOVES).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(MOVES).option("maxFilesPerTrigger", 1).parquet(src)
    moves = chunked(stream.withColumn("ts", F.col("event_ts").cast("timestamp_ntz")).drop("event_ts"), F.floor(F.hour("ts") / 6))
    return {r["sku"]: (r["closing_stock"], r["movements"])
            for r in read_stock(spark, run_stock(spark, moves, "stock_batches"), moves).collect()}


def test_stock_state_across_batches_matches_fold(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    got = _stock_stream(spark, tmp_path, [
        [("A", t, 1, 1, 1, 1.0, -5, 3), ("A", t, 2, 1, 1, 1.0, 4, 3)],
        [("A", t + dt.timedelta(days=1), 3, 1, 1, 1.0, -10, 3), ("B", t, 1, 1, 1, 1.0, 2, 0)],
        [("A", t + dt.timedelta(days=2), 4, 1, 1, 1.0, 7, 3)]])
    # A: 3 -> max(0,-2)=0 -> 4 -> max(0,-6)=0 -> 7 ; B: 0 -> 2
    assert got == {"A": (7, 4), "B": (2, 1)}


def test_stock_state_applies_out_of_order_files_in_event_order(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    got = _stock_stream(spark, tmp_path, [
        [("A", t + dt.timedelta(days=5), 2, 1, 1, 1.0, -10, 3)],   # arrives first
        [("A", t + dt.timedelta(days=1), 1, 1, 1, 1.0, 4, 3)],     # earlier event, within the delay
        [("A", t + dt.timedelta(days=7), 3, 1, 1, 1.0, 7, 3)]])
    # event order: 3 + 4 = 7, 7 - 10 = 0, 0 + 7 = 7 (arrival order would give 3-10->0, +4 = 4, +7 = 11)
    assert got == {"A": (7, 3)}


def test_stock_state_of_a_hot_sku_over_many_batches(spark, tmp_path):
    import random
    rnd = random.Random(3)
    t = dt.datetime(2024, 1, 1)
    rows = [("HOT" if rnd.random() < 0.4 else f"K{rnd.randint(1, 5)}", t + dt.timedelta(hours=rnd.randint(0, 60)), i, 1, 1, 1.0,
             rnd.choice([-9, -4, 3, 6]), 5) for i in range(1200)]
    got = _stock_stream(spark, tmp_path, [rows[i::20] for i in range(20)])  # compacts once on the way
    for sku in {r[0] for r in rows}:
        s, mine = 5, sorted((r for r in rows if r[0] == sku), key=lambda r: (r[1], r[2]))
        for r in mine:
            s = max(0, s + r[6])
        assert got[sku] == (s, len(mine))


STREAMS = ["stream_ingest", "stream_daily_trend", "stream_weekly_clients", "stream_sessions", "stream_stock", "stream_upsert",
           "stream_late", "stream_late_stock"]


@pytest.mark.parametrize("key", ["stream_daily_trend", "stream_weekly_clients", "stream_sessions", "stream_stock"])
def test_results_do_not_depend_on_batches(spark, tmp_path, key):
    """One batch, four files in the table's order, five files of shuffled rows: the same rows."""
    from conftest import SMALL
    from shopfloor.plans.registry import REGISTRY
    from shopfloor.streaming import partials, queries as q
    want = sorted(map(str, REGISTRY[key](spark, SMALL).collect()))
    for name, files, order in (("in order", 4, None), ("shuffled", 5, F.rand(7))):
        d = str(tmp_path / name)
        for t in ("orders", "lineitem", "events"):
            rows = spark.read.parquet(f"{SMALL}/{t}.parquet")
            (rows.coalesce(1) if order is None else rows.orderBy(order)).repartition(files).write.parquet(f"{d}/{t}.parquet")
        for t in ("customer", "part"):
            spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
        if key == "stream_stock":
            moves = q.movement_stream(spark, d, max_files=1)
            got = q.read_stock(spark, q.run_stock(spark, moves, "batches"), moves)
        else:
            agg = {"stream_daily_trend": q.TREND, "stream_weekly_clients": q.CLIENTS, "stream_sessions": q.SESSIONS}[key]
            stream = q.event_stream(spark, d, max_files=1) if key == "stream_sessions" else q.sales_stream(spark, d, max_files=1)
            out = partials.run_mergeable(spark, stream, "batches", agg)
            assert len(partials.since_snapshot(spark, out)) == files
            got = partials.read_mergeable(spark, out, stream, agg)
        assert sorted(map(str, got.collect())) == want != []


def test_corrections_are_noted_and_resumed(spark, tmp_path, monkeypatch):
    """A late sale corrects its day; a restart goes on without counting twice; compaction changes nothing."""
    from shopfloor.streaming import partials
    monkeypatch.setattr(partials, "COMPACT_EVERY", 4)
    src, ckpt, out = (str(tmp_path / x) for x in ("src", "ckpt", "out"))
    agg = partials.Mergeable(lambda b: b.groupBy("day").agg(F.sum("v").alias("v")),
                             lambda p: p.groupBy("day").agg(F.sum("v").alias("v")), lambda p: p)
    rows = [("d1", 1), ("d2", 2), ("d1", 4), ("d3", 8)] + [("d2", 1)] * 2
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "day string, v long").coalesce(1).write.mode("append").parquet(src)
        if i in (1, 3, len(rows) - 1):
            stream = spark.readStream.schema("day string, v long").option("maxFilesPerTrigger", 1).parquet(src)
            partials.run_mergeable(spark, stream, "fix", agg, keys=["day"], checkpoint=ckpt, output=out)
    got = {r.day: r.v for r in partials.read_mergeable(spark, out, stream, agg).collect()}
    assert got == {"d1": 5, "d2": 4, "d3": 8}
    noted = [(r.batch, r.day, r.old_v, r.v) for r in partials.read_corrections(spark, out).orderBy("batch").collect()]
    assert noted[0] == (2, "d1", 1, 5) and noted[1:] == [(4, "d2", 2, 3), (5, "d2", 3, 4)]
    assert len(partials.since_snapshot(spark, out)) == 3  # one snapshot and two batches


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    """The tables as folders of part files."""
    from conftest import SMALL
    d = str(tmp_path_factory.mktemp("tables"))
    for t in ("orders", "customer", "lineitem", "part", "events"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").repartition(3).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("key", STREAMS)
def test_streams_read_folders_like_files(spark, folder_tables, key):
    from conftest import SMALL
    from shopfloor.plans.registry import REGISTRY
    rows = lambda d: sorted(map(str, REGISTRY[key](spark, d).collect()))
    assert rows(folder_tables) == rows(SMALL) != []


def test_stream_resumes_without_lost_or_doubled_rows(spark, tmp_path):
    src, ckpt, out = (str(tmp_path / x) for x in ("src", "ckpt", "out"))
    schema = "k long, v long"

    def add(a, b):
        spark.range(a, b).selectExpr("id as k", "id % 3 as v").coalesce(1).write.mode("append").parquet(src)

    def run(mode, name, df, keys=None):
        runner.run_stream(spark, df, name, mode, keys, checkpoint=f"{ckpt}/{name}", output=f"{out}/{name}")
        return runner.read_output(spark, f"{out}/{name}", mode, df.schema, keys)

    for upto in (10, 25, 25, 40):  # the third start finds nothing new
        if upto != 25 or not os.path.exists(f"{src}/second"):
            add({10: 0, 25: 10, 40: 25}[upto], upto)
        if upto == 25:
            os.makedirs(f"{src}/second", exist_ok=True)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        assert sorted(r["k"] for r in run("append", "rows", stream).collect()) == list(range(upto))
        counts = run("update", "counts", stream.groupBy("v").agg(F.count(F.lit(1)).alias("n")), ["v"])
        assert sum(r["n"] for r in counts.collect()) == upto and counts.count() == 3


def test_upsert_resumes(spark, tmp_path):
    from shopfloor.streaming.upsert import VAULT_COLS, run_upsert
    vault = spark.createDataFrame([(1, "A", "9"), (1, "B", "3")], "row_pos bigint, sku string, stock_text string")
    for c in VAULT_COLS:
        if c not in vault.columns:
            vault = vault.withColumn(c, F.lit(None).cast("string"))
    src, ckpt, base = (str(tmp_path / x) for x in ("lines", "ckpt", "vault"))
    for left in ("7", "5", "3"):
        spark.createDataFrame([("A", 2.0)], "sku string, quantity double").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("sku string, quantity double").parquet(src)
        got = {r["sku"]: r["stock_text"] for r in run_upsert(spark, vault, stream, "up", base=base, checkpoint=ckpt).collect()}
        assert got == {"A": left, "B": "3"}  # equal row_pos doesn't multiply rows


def test_empty_stream_gives_an_empty_frame(spark, tmp_path):
    src = str(tmp_path / "none")
    os.makedirs(src)
    df = spark.readStream.schema("k long").parquet(src)
    for mode, keys in (("append", None), ("update", ["k"])):
        got = df if mode == "append" else df.groupBy("k").count()
        back = runner.read_output(spark, runner.run_stream(spark, got, f"empty_{mode}", mode, keys), mode, got.schema, keys)
        assert back.columns == got.columns and back.count() == 0


def test_parity_form_of_the_trend_equals_the_key(spark):
    from conftest import SMALL
    from shopfloor.plans.registry import REGISTRY
    from shopfloor.streaming import queries as stream_q
    df, mode, keys = stream_q.daily_trend(spark, SMALL, mode="complete")
    got = runner.read_output(spark, runner.run_stream(spark, df, "trend_complete", mode, keys), mode, df.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, REGISTRY["stream_daily_trend"](spark, SMALL).collect()))


def test_refresh_policy_triggers_a_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(5).write.parquet(src)
    df = spark.readStream.schema("id long").parquet(src)
    out = runner.run_stream(spark, df, "policy", trigger="sales", wait=False)
    q = next(x for x in spark.streams.active if x.name.startswith("policy_"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert runner.read_output(spark, out, "append", df.schema).count() == 5


def test_upsert_over_several_batches_equals_one_deduction(spark, tmp_path):
    from shopfloor.operators.inventory import stock_deduct
    from shopfloor.streaming.upsert import VAULT_COLS, run_upsert
    vault = spark.createDataFrame([(1, "A", "5"), (2, "B", "3"), (3, "C", "")], "row_pos bigint, sku string, stock_text string")
    for c in VAULT_COLS:
        if c not in vault.columns:
            vault = vault.withColumn(c, F.lit(None).cast("string"))
    src = str(tmp_path / "lines")
    schema = "row_pos bigint, line_no int, sku string, quantity double"
    for b in [[(1, 1, "A", 2.0)], [(2, 1, "A", 2.0), (2, 2, "B", 5.0)], [(3, 1, "A", 4.0), (3, 2, "C", 1.0)]]:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    final = {r["sku"]: r["stock_text"] for r in run_upsert(spark, vault, stream, "upsert_test").collect()}
    all_lines = spark.read.parquet(src)
    once = {r["sku"]: r["new_stock_text"] for r in stock_deduct(vault, all_lines).collect()}
    assert final == once == {"A": "0", "B": "0", "C": "0"}


def test_ingest_sink_is_partitioned_by_month(spark):
    from conftest import SMALL
    from shopfloor.streaming import queries as stream_q
    df, mode, _ = stream_q.ingest(spark, SMALL)
    out = runner.run_stream(spark, df, "ingest_part", mode, partition_by=["sale_month"])
    q = spark.read.parquet(out).where(F.col("sale_month") >= F.lit("2001-01-01").cast("date"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_month" in plan
    assert q.count() == spark.read.parquet(out).where("sale_date >= '2001-01-01'").count() > 0


def test_a_delivery_is_written_by_as_many_tasks_as_read_the_table(spark, tmp_path):
    """Four deliveries of all rows, none of them through one task; each has rows of all parts of the table."""
    from shopfloor.plans import fixtures as fx
    d, to = str(tmp_path / "tables"), str(tmp_path / "arrived")
    spark.range(4000).selectExpr("id as l_orderkey", "id % 7 as v").repartition(3).write.parquet(f"{d}/lineitem.parquet")
    files, rows = [0], [0]
    for i in fx.fx_arrivals(spark, d, "lineitem", "l_orderkey", to):
        assert i == len(files) - 1
        files.append(sum(f.endswith(".parquet") for f in os.listdir(f"{to}/lineitem.parquet")))
        rows.append(spark.read.parquet(f"{to}/lineitem.parquet").count())
    assert [b - a for a, b in zip(files, files[1:])] == [3] * 4
    assert all(b - a > 500 for a, b in zip(rows, rows[1:])) and rows[-1] == 4000


def test_stock_of_one_batch_is_read_with_two_exchanges(spark, tmp_path):
    """A row a chunk goes to its SKU and month, a row a month to its SKU; nothing is joined back."""
    from conftest import SMALL
    from shopfloor.streaming import queries as q
    moves = q.movement_stream(spark, SMALL)
    out = q.run_stock(spark, moves, "two_exchanges")
    df = q.read_stock(spark, out, moves)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("- Exchange hashpartitioning") == 2 and "Join" not in plan


def test_stock_of_rows_without_a_time_or_quantity(spark, tmp_path):
    """A movement without a time is in no chunk; a SKU whose last movement has no quantity has no stock to tell."""
    t = dt.datetime(2024, 1, 1)
    rows = [("A", None, 1, 1, 1, 1.0, 50, 3), ("A", t, 2, 1, 1, 1.0, -5, 3), ("A", t + dt.timedelta(days=40), 3, 1, 1, 1.0, 4, 3),
            ("B", t, 4, 1, 1, 1.0, 9, 0), ("B", t + dt.timedelta(days=1), 5, 1, 1, 1.0, None, 0), (None, t, 6, 1, 1, 1.0, 1, 1)]
    want = {"A": (4, 2), "B": (None, 2)}
    assert _stock_stream(spark, tmp_path / "one", [rows]) == want
    assert _stock_stream(spark, tmp_path / "two", [rows[::2], rows[1::2]]) == want


def test_dashboard_builds_the_lines_of_each_delivery_once(spark, monkeypatch):
    from conftest import SMALL
    from shopfloor.plans import fixtures as fx
    from shopfloor.plans.registry import REGISTRY
    built, fx_lines = [], fx.fx_lines

    def counted(spark, sf_dir, lineitem=None):
        built.append((lineitem if lineitem is not None else fx.table(spark, sf_dir, "lineitem")).count())
        return fx_lines(spark, sf_dir, lineitem) if lineitem is not None else fx_lines(spark, sf_dir)

    monkeypatch.setattr(fx, "fx_lines", counted)
    assert REGISTRY["stream_dashboard"](spark, SMALL).count() > 0
    assert len(built) == fx.ARRIVALS and sum(built) == fx.table(spark, SMALL, "lineitem").count()
