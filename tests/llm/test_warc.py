import base64
import hashlib
import random

import pytest

from ledgersieve.llm import warc

SCHEMA = "page_id long, url string, html string, HTML string, value string, block string"
TRAP = "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (1, "http://www.A.example/x y", "same"), (2, "https://b.a.example:443/p?q#f", "same"),
    (3, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", TRAP), (7, "u", TRAP), (8, "u", TRAP + "z"),
    (9, "u", "WARC/1.1\r\n"), (10, "u\r\nWARC-Type: x", "\r\n\r\n"), (11, "http://[::1]:8080/", "é😀\x00\x85"),
    (12, "u", "x" * 3_000_000), (13, "u", "WARC/WARC/1.1\r\n" * 50), (None, "u", "lone"),
    (None, "u", "same"), (14, "http://a.example/", "rep"), (14, "http://a.example/", "rep"),
    (-5, "u", "neg"), (15, "http://a.example/" + "/p" * 5000, "0\r\n\r\n"),
]


def expected(pages, least=0):
    first = {}
    for number, _, html in pages:
        if number is not None:
            first[html or ""] = max(number, first.get(html or "", number))
    out = []
    for number, _, html in pages:
        body = (html or "").encode()
        leader = first.get(html or "") if len(body) >= least else None
        revisit = leader is not None and number != leader
        out.append((number, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", leader if revisit else None, True))
    return sorted(out, key=str)


def frame(spark, pages):
    return spark.createDataFrame([(*p, "clash", "clash", "clash") for p in pages], SCHEMA)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back_from_archives(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 4)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")  # archives shared by tasks
    try:
        found = warc.archived(frame(spark, PAGES).repartition(3), least).select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, found), key=str) == expected(PAGES, least)


def test_no_pages(spark):
    assert warc.archived(frame(spark, [])).collect() == []


def test_histories_are_in_order_of_all_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 50)
    rnd = random.Random(1)
    pages = [(i, f"http://{'hot' if i % 3 else rnd.choice('abc')}.example/{rnd.randint(0, 20)}", str(i))
             for i in range(400)]
    records = warc.records(frame(spark, pages).repartition(7))
    lines = [r[0].removeprefix(warc.FIRST_LINE) + warc.RECORD_END for r in records.collect()]
    captures = spark.createDataFrame([warc.parse_record(x.encode()) for x in lines], warc.CAPTURE)
    rows = warc.capture_histories(captures.repartition(9)).collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == 400
    assert rows[0].url_key.startswith("example,a)/")


def test_loser_tree_merges_like_sorting():
    rnd = random.Random(0)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rnd.randint(0, 9),) for _ in range(rnd.randint(0, 6))) for _ in range(k)]
        merged = [(runs[r][at], r, at) for r, at in warc.LoserTree(runs)]
        assert merged == sorted((x, r, at) for r, run in enumerate(runs) for at, x in enumerate(run))


def test_keys_of_addresses():
    assert warc.url_key("https://www.News.Example.org:443/a/B?c=D#e") == "org,example,news)/a/B?c=D"
    assert warc.url_key("http://u:p@x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == ")/"
