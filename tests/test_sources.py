"""Sources, sinks and normalisation guards."""

import pytest
from pyspark.sql import functions as F

from shopfloor.operators.cleaning import normalize_sales, normalize_vault
from shopfloor.schemas import RAW_VAULT
from shopfloor.session import shared_dir
from shopfloor.sources import append, latest_snapshot, read_table, write_snapshot
from shopfloor.sources.changelog import ChangeLog


def test_missing_table_raises_unless_asked(spark, tmp_path):
    missing = str(tmp_path / "nope")
    with pytest.raises(Exception):
        read_table(spark, missing, RAW_VAULT).count()
    empty = read_table(spark, missing, RAW_VAULT, missing_ok=True)
    assert empty.count() == 0 and empty.schema == RAW_VAULT


def test_sheet_headers_are_trimmed_and_mapped(spark):
    raw = spark.createDataFrame([("05/01/2001 10:00:00", " January 5, 2001", "Ann", "@a", "100", "40", "Paid Online")],
                                ["Timestamp ", " Date of Sale", "Client Formal Name", "Instagram/Facebook Handle",
                                 "Total Amount Client Paid You", "Total Cost of These Items", "Payment Status"])
    s = normalize_sales(raw).first()
    # the courier column is optional: missing -> 0; the date text keeps its space but still parses
    assert s["courier"] == 0 and s["paid"] == 100 and s["cost"] == 40 and s["handle"] == "@a"
    assert s["sale_date"] is not None and s["sale_ts"] is not None


def test_missing_required_column_is_an_error(spark):
    raw = spark.createDataFrame([("x",)], ["Timestamp"])
    with pytest.raises(ValueError, match="sale_date_text"):
        normalize_sales(raw)


def test_vault_headers(spark):
    raw = spark.createDataFrame([("JK-1", "100.5", "Ring, gold", " 7 ")],
                                ["Item_SKU", "Sourcing_Price", "tags", "Stock_Quantity"])
    v = normalize_vault(raw).first()
    assert v["sku"] == "JK-1" and v["sourcing_price"] == 100.5 and v["stock_qty"] == 7
    assert v["standard_price"] is None


def test_append_and_snapshots(spark):
    base = shared_dir(spark, "test", "tables")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_pos bigint, sku string")
    append(rows, f"{base}/sales")
    append(rows.withColumn("row_pos", F.col("row_pos") + 2), f"{base}/sales")
    assert read_table(spark, f"{base}/sales").count() == 4
    assert latest_snapshot(spark, f"{base}/vault") is None
    write_snapshot(rows, f"{base}/vault", 0)
    write_snapshot(rows.where("row_pos = 1"), f"{base}/vault", 1)
    write_snapshot(rows.where("row_pos = 1"), f"{base}/vault", 1)  # a retried version rewrites itself
    assert latest_snapshot(spark, f"{base}/vault").count() == 1


def test_shared_dir_uses_session_checkpoint_dir(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base.rstrip("/") + "/")


def test_logged_sales_are_written_protected(spark):
    import datetime as dt
    from shopfloor.functions.pii import pii_key, unprotect
    from shopfloor.operators.items import line_items
    from shopfloor.operators.sales_log import build_sales
    key = pii_key(spark)
    lines = spark.createDataFrame([(1, 2, "JK-2", "Ring", "", 2.0, 10.0, 25.5), (1, 1, "JK-1", "Other", "x", 1.0, 5.0, 9.99)],
                                  "row_pos bigint, line_no int, sku string, category string, details string, "
                                  "quantity double, source_price double, selling_price double")
    headers = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 20, 0, 0), "Ann Lee", "@ann", "Paid Online", 0.0)],
                                    "row_pos bigint, event_ts timestamp, client_name string, handle string, "
                                    "payment_status string, courier double")
    built = build_sales(lines, headers, pii_key=key)
    path = shared_dir(spark, "test", "sales_log")
    append(built, path)
    back = read_table(spark, path)
    r = back.select("*", unprotect("client_name", key).alias("name"), unprotect("handle", key).alias("h")).first()
    assert r["client_name"] != "Ann Lee" and r["name"] == "Ann Lee" and r["h"] == "@ann"
    # 20:00 UTC is 01:30 next day in IST; totals are exact; the JSON keeps line order
    assert r["sale_ts_text"] == "02/01/2024 01:30:00" and r["sale_date_text"] == "January 02, 2024"
    assert (r["total_pieces"], r["total_cost"], r["amount_paid"]) == (3, 25.0, 60.99)
    items = line_items(back).orderBy("line_no").select("sku").collect()
    assert [i["sku"] for i in items] == ["JK-1", "JK-2"]


def test_checkout_appends_sales_and_writes_next_catalogue(spark):
    import datetime as dt
    from shopfloor.operators.flows import checkout
    base = shared_dir(spark, "test", "checkout")
    vault = spark.createDataFrame([(1, "JK-1", "5"), (2, "JK-2", "1"), (3, "JK-3", "x")],
                                  "row_pos bigint, sku string, stock_text string")
    log = ChangeLog(spark, f"{base}/vault")
    log.create(vault)
    lines = spark.createDataFrame([(10, 1, "JK-1", "Ring", "", 2.0, 1.0, 3.0), (10, 2, "JK-2", "Ring", "", 4.0, 1.0, 3.0),
                                   (11, 1, "JK-3", "Ring", "", 1.0, 1.0, 3.0), (11, 2, "N/A", "Other", "x", 1.0, 1.0, 3.0)],
                                  "row_pos bigint, line_no int, sku string, category string, details string, "
                                  "quantity double, source_price double, selling_price double")
    headers = spark.createDataFrame([(10, dt.datetime(2024, 1, 1), "A", "@a", "Paid Online", 0.0),
                                     (11, dt.datetime(2024, 1, 2), "B", "@b", "Pending", 0.0)],
                                    "row_pos bigint, event_ts timestamp, client_name string, handle string, "
                                    "payment_status string, courier double")
    from shopfloor.functions.pii import pii_key
    for _ in range(2):  # a retry changes nothing
        rows, new_vault = checkout(spark, lines, headers, f"{base}/sales", f"{base}/vault", 0, pii_key(spark))
    logged = read_table(spark, f"{base}/sales")
    assert logged.count() == rows.count() == 2
    assert not {r["client_name"] for r in logged.collect()} & {"A", "B"}
    assert {r["sku"]: r["stock_text"] for r in new_vault.collect()} == {"JK-1": "3", "JK-2": "0", "JK-3": "x"}
    assert log.read().count() == 3 and log.version() == 1
    assert log.read(0).where("sku = 'JK-1'").first().stock_text == "5"
    _, later = checkout(spark, lines, headers, f"{base}/sales", f"{base}/vault", 4, pii_key(spark))
    assert {r["sku"]: r["stock_text"] for r in later.collect()} == {"JK-1": "1", "JK-2": "0", "JK-3": "x"}
    checkout(spark, lines, headers, f"{base}/sales", f"{base}/vault", 4, pii_key(spark))  # once only
    _, older = checkout(spark, lines, headers, f"{base}/sales", f"{base}/vault", 2, pii_key(spark))  # any order
    assert {r["sku"]: r["stock_text"] for r in older.collect()} == {"JK-1": "0", "JK-2": "0", "JK-3": "x"}
    with pytest.raises(ValueError):
        checkout(spark, lines, headers, f"{base}/sales", f"{base}/none", 2, pii_key(spark))


def _catalogue(spark, base, rows, **options):
    from shopfloor.streaming.upsert import catalogue
    log = catalogue(spark, base)
    log.__dict__.update(options)
    log.create(spark.createDataFrame(rows, "row_pos bigint, sku string, stock_text string"))
    return log


def _stock(log, version=None):
    return sorted((r.row_pos, r.sku, r.stock_text) for r in log.read(version).collect())


def test_a_batch_writes_only_its_skus(spark, tmp_path):
    from shopfloor.operators import inventory
    log = _catalogue(spark, str(tmp_path), [(i, f"S{i % 50}", "9") for i in range(100)] + [(200, None, "1"), (201, " S3 ", "4")])
    sold = inventory.sold_per_sku(spark.createDataFrame([("S3", 2.0), ("S4", 99.0), ("no", 1.0)], "sku string, quantity double"))
    log.commit("b-0", lambda c: inventory.changed_by_sales(c, sold))
    entry = log._read_marker(1)
    delta = spark.read.parquet(f"{tmp_path}/{entry['folder']}")
    assert sorted(r.row_pos for r in delta.collect()) == [3, 4, 53, 54, 201]
    now = {r[0]: r[2] for r in _stock(log)}
    assert len(now) == 102 and (now[3], now[53], now[201], now[4], now[5], now[200]) == ("7", "7", "2", "0", "9", "1")
    assert _stock(log, 0) == sorted((i, f"S{i % 50}", "9") for i in range(100)) + [(200, None, "1"), (201, " S3 ", "4")]


def test_two_checkouts_at_once_lose_nothing(spark, tmp_path):
    """Both read version 0; the second to commit meets the conflict and deducts from the new state."""
    import threading
    from shopfloor.operators import inventory
    log = _catalogue(spark, str(tmp_path), [(1, "A", "10"), (2, "B", "10")])
    both, calls = threading.Barrier(2), []

    def run(name, sku, quantity):
        sold = inventory.sold_per_sku(spark.createDataFrame([("A", 1.0), (sku, quantity)], "sku string, quantity double"))

        def change(current):
            calls.append(name)
            if calls.count(name) == 1:
                both.wait(60)
            return inventory.changed_by_sales(current, sold)
        log.commit(name, change)

    threads = [threading.Thread(target=run, args=a) for a in (("x", "B", 3.0), ("y", "A", 4.0))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert _stock(log) == [(1, "A", "4"), (2, "B", "7")]
    assert log.version() == 2 and len(calls) == 3
    assert log.commit("x", lambda c: 1 / 0) in (1, 2)  # committed: not computed again


def test_compaction_and_deletes(spark, tmp_path):
    from shopfloor.operators import inventory
    log = _catalogue(spark, str(tmp_path), [(1, "A", "10"), (2, "B", "10"), (3, "C", "1")], compact_every=3)
    for i in range(7):
        sold = inventory.sold_per_sku(spark.createDataFrame([("A", 1.0)], "sku string, quantity double"))
        log.commit(f"sale-{i}", lambda c: inventory.changed_by_sales(c, sold))
    assert _stock(log) == [(1, "A", "3"), (2, "B", "10"), (3, "C", "1")]
    kinds = [log._read_marker(n)["kind"] for n in log.numbers()]
    assert kinds == ["base", "delta", "delta", "delta", "base", "delta", "delta", "delta", "base", "delta"]
    gone = log.commit("gone", lambda c: inventory.deleted_items(c, spark.createDataFrame([("C",), ("none",)], "sku string")))
    log.commit("back", lambda c: spark.createDataFrame([(4, "C", "8")], "row_pos bigint, sku string, stock_text string"))
    assert _stock(log, gone) == [(1, "A", "3"), (2, "B", "10")]
    assert _stock(log)[2:] == [(4, "C", "8")]


def test_dashboard_datasets(spark):
    from conftest import SMALL
    from shopfloor.operators.flows import dashboard
    from shopfloor.plans import fixtures as fx
    out = dashboard(fx.fx_sales(spark, SMALL, with_items=True), fx.fx_purchases(spark, SMALL), fx.as_of_col(),
                    fx.WEEKLY_SPEND)
    assert set(out) == {"summary", "daily_trend", "category_mix", "client_value", "top_clients", "repeat_rate"}
    assert out["summary"].count() == 1 and out["top_clients"].count() == 5
    assert abs(sum(r["share"] for r in out["category_mix"].collect()) - 1.0) < 1e-9


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_sheet_export_round_trip(spark, fmt):
    """A sheet export keeps null, '' and blanks apart and maps back to the columns."""
    from conftest import SMALL
    from pyspark.sql import types as T
    from shopfloor.operators.cleaning import standard_names
    from shopfloor.plans import fixtures as fx
    from shopfloor.plans.registry import sheet
    from shopfloor.schemas import SALES_HEADERS
    options = {"nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"} if fmt == "csv" else {}
    want = fx.fx_sales(spark, SMALL).drop("order_ts")
    path = shared_dir(spark, "test", "export") + "/data"
    out = sheet(want, SALES_HEADERS)
    out.write.format(fmt).options(header="true", **options).save(path)
    back = standard_names(read_table(spark, path, T.StructType(out.schema.fields), fmt=fmt, **options), SALES_HEADERS)
    assert sorted(map(str, back.collect())) == sorted(map(str, want.collect()))


def test_shared_dir_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_missing_ok_hides_no_other_failure(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path / "bad.parquet"), spark.range(1).schema, missing_ok=True).collect()


def test_pii_key_is_in_no_plan(spark):
    from shopfloor.functions.pii import key_column, pii_key, protect, unprotect
    key = "super-secret-key-of-32-bytes-abc"
    df = spark.range(3).selectExpr("cast(id as string) as v")
    out = df.select(protect("v", key_column(spark, key)).alias("e")).select(unprotect("e", key_column(spark, key)).alias("v"))
    assert sorted(r["v"] for r in out.collect()) == ["0", "1", "2"]
    assert key not in out._jdf.queryExecution().toString() and key not in out._jdf.queryExecution().stringWithStats()
    old = spark.conf.get("spark.shopfloor.pii.secret")
    spark.conf.unset("spark.shopfloor.pii.secret")
    try:
        with pytest.raises(RuntimeError):
            pii_key(spark)
    finally:
        spark.conf.set("spark.shopfloor.pii.secret", old)


def test_sales_are_summed_once_for_a_commit(spark):
    """One join picks the sold rows and gives their quantities; rows of the same SKU all change."""
    from shopfloor.operators import inventory
    vault = spark.createDataFrame([(1, "A", "9"), (2, " A ", "4"), (3, "B", "2"), (4, None, "1")], "row_pos bigint, sku string, stock_text string")
    sold = inventory.sold_per_sku(spark.createDataFrame([("A", 2.0), ("A", 3.0), ("no", 1.0)], "sku string, quantity double"))
    out = inventory.changed_by_sales(vault, sold)
    assert sorted(map(tuple, out.collect())) == [(1, "A", "4"), (2, " A ", "0")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
