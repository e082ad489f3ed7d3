import base64
import hashlib

import pytest
from common_data import sf  # noqa: F401
from pyspark.sql import functions as F

from oracle_compare import compare, duck_connect
from shopfloor.llm.registry import LLM_SQL
from shopfloor.llm.warc import cut_records, op6_warc, page_records, read_archive, resolve_revisits, write_archive
from shopfloor.session import shared_dir

NASTY = ["", "\r\n", "\r\n\r\n", "a\r\n\r\nb", "ends\r\n", "ends\r\n\r\n", "ends\r", "WARC/1.1\r\nContent-Length: 5\r\n\r\nx", "é漢😀" * 1000,
         "x" * 3_000_000, "\n\r\n\r", "\r\n\r\n\r\n\r\n\r\n", "\x00\x01", "ends\r", None, "\r\n"]


def pages_of(spark, payloads, parts=3):
    return spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", p) for i, p in enumerate(payloads)],
                                 "page_id long, url string, html string").repartition(parts, "page_id")


def digest(p):
    return base64.b32encode(hashlib.sha1((p or "").encode()).digest()).decode().rstrip("=")


def test_matches_sql(spark, sf):
    ok, msg = compare(op6_warc(spark, sf), duck_connect(sf), LLM_SQL["op6_warc"])
    assert ok, msg


def test_round_trip_of_awkward_payloads(spark):
    path = shared_dir(spark, "t") + "/data"
    write_archive(page_records(pages_of(spark, NASTY)), path)
    got = {r.page_id: r for r in read_archive(spark, path).collect()}
    assert len(got) == len(NASTY)
    for i, p in enumerate(NASTY):
        assert got[i].payload == (p or "") and got[i].payload_digest == digest(p)
        assert got[i].payload_bytes == len((p or "").encode()) and got[i].url == f"http://h/{i}%0D%0AX: y"


def test_revisits_resolve_across_archives(spark):
    """Two archives, written and read, then resolved together."""
    payloads = ["a", "b", "a", "", "a", None]
    records = resolve_revisits(page_records(pages_of(spark, payloads)))
    path = shared_dir(spark, "t") + "/data"
    write_archive(records, path)
    back = read_archive(spark, path)
    by = {r.page_id: (r.record_type, r.refers_to, r.payload) for r in back.collect()}
    assert by == {0: ("revisit", 4, None), 2: ("revisit", 4, None), 4: ("response", None, "a"), 1: ("response", None, "b"),
                  3: ("revisit", 5, None), 5: ("response", None, "")}
    more = page_records(spark.createDataFrame([(9, "u", "a")], "page_id long, url string, html string"))
    merged = {r.page_id: (r.record_type, r.refers_to) for r in resolve_revisits(back.unionByName(more)).collect()}
    assert merged[4] == ("revisit", 9) and merged[0] == ("revisit", 9) and merged[9] == ("response", None)
    alone = resolve_revisits(back.filter("page_id = 0")).first()
    assert (alone.record_type, alone.refers_to) == ("revisit", 4)


def test_small_payloads_stay_responses(spark):
    got = {r.page_id: r.record_type for r in resolve_revisits(page_records(pages_of(spark, ["a", "a", "abc", "abc"])), min_bytes=2).collect()}
    assert got == {0: "response", 1: "response", 2: "revisit", 3: "response"}


def test_a_payload_of_a_third_of_the_pages(spark):
    pages = pages_of(spark, ["hot" if i % 3 == 0 else f"p{i}" for i in range(900)])
    got = resolve_revisits(page_records(pages)).groupBy("record_type").agg(F.count("*").alias("n")).collect()
    assert {r.record_type: r.n for r in got} == {"response": 601, "revisit": 299}


def test_a_cut_archive_is_an_error():
    with pytest.raises(ValueError):
        list(cut_records(["WARC/1.1\r\nContent-Length: 50", "short"]))
