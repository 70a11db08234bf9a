"""WARC round trip, framing and digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import compare
import pytest

from stratalake.llm import warc
from stratalake.llm.oracles import ORACLES
from stratalake.llm.queries import QUERIES

PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    with compare.duck(d) as con:
        assert compare.difference(QUERIES["op5_warc"](spark, d), con, ORACLES["op5_warc"]) is None


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (4, "http://a/x y%20\r\nz", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (9, "http://b", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (1, "http://c", None),
    (3, "http://d", ""),
    (5, "http://é", "ü" * 100_000),
    (None, "http://e", "<p>same</p>"),
    (None, "http://f", "no id"),
    (6, "http://g", "WARC/1.0\r\n\r\n\x1f\x8b\x08 looks like a header"),
    (7, "http://h", "x" * 65_536),
    (8, "http://i", "after the long ones"),
]


def test_small_cases(spark):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'x' AS payload", "1 AS first_id")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    first = {"<p>same</p>": 2, "": 1}
    want = []
    for page, _, html in ROWS:
        text = html or ""
        again = text in first and page != first[text]
        want.append((
            page, len(text.encode()), digest(text), "revisit" if again else "response",
            first[text] if again else None, None,
        ))
    assert got == sorted(want, key=str)


def test_payloads_and_urls_come_back(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    archives = warc.write_archives(warc.as_records(pages), archive_bytes=2_000)
    rows = warc.read_archives(archives, payloads=True).collect()
    by_id = {r.record_id: r for r in rows if r.record_type == "response"}
    assert bytes(by_id["5"].payload).decode() == ROWS[6][2]
    assert by_id["6"].target_uri == "http://g"
    revisit = next(r for r in rows if r.record_id == "4")
    assert (revisit.target_uri, revisit.payload, revisit.refers_to) == (ROWS[0][1], None, "2")


def test_min_bytes_keeps_small_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], PAGES)
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=3).collect()} == {"response"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_clashing_columns_play_no_part(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    names = ("payload", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to",
             "target_uri", "fault", "archive", "content", "first_id")
    extra = pages.selectExpr("*", *[f"'x' AS {n}" for n in names])
    plain = sorted(map(str, warc.round_trip(pages).collect()))
    assert sorted(map(str, warc.round_trip(extra).collect())) == plain


def test_a_very_long_page(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(3_000_000))
    pages = spark.createDataFrame([(1, "u", text), (2, "v", text)], PAGES)
    rows = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert rows[1].payload_bytes == rows[2].payload_bytes == 3_000_000
    assert (rows[1].payload_digest, rows[2].refers_to) == (digest(text), 1)


def one(page_id, text):
    payload = text.encode()
    return warc.record_bytes({
        "page_id": page_id, "url": "http://a", "payload": payload, "payload_bytes": len(payload),
        "payload_digest": digest(text), "record_type": "response", "refers_to": None,
    })


def test_archives_are_gzip_members():
    content = b"".join(warc.member(one(i, f"page {i}")) for i in range(3))
    plain = gzip.GzipFile(fileobj=io.BytesIO(content)).read()
    assert plain.count(b"WARC/1.0\r\n") == 3
    assert plain == b"".join(one(i, f"page {i}") for i in range(3))


def test_faults_are_reported_and_reading_goes_on():
    good = warc.member(one(1, "good"))
    flipped = warc.member(one(2, "text").replace(b"text", b"tent"))
    short = warc.member(one(3, "cut")[:-6])
    damaged = bytearray(warc.member(one(4, "damaged " * 50)))
    damaged[40] ^= 0xFF
    bad_length = warc.member(one(5, "abc").replace(b"Content-Length: 4", b"Content-Length: x", 1))
    rows = list(warc.read_records("a", good + flipped + short + bytes(damaged) + good + bad_length))
    faults = [r["fault"] for r in rows]
    assert faults[:3] == [None, "block digest", "framing"]
    assert "damaged member" in faults
    assert [r["record_id"] for r in rows if r["fault"] is None] == ["1", "1"]
    assert list(warc.read_records("a", good[:-3]))[0]["fault"] == "truncated member"


def test_long_members_stay_in_step():
    """Payloads around and over the feeding step, compressible and not."""
    import random

    rng = random.Random(1)
    texts = ["a" * n for n in (65_535, 65_536, 65_537, 300_000)]
    texts += ["".join(rng.choices("abcdefghijklmnop0123456789", k=n)) for n in (70_000, 200_000, 10)]
    content = b"".join(warc.member(one(i, t)) for i, t in enumerate(texts))
    rows = list(warc.read_records("a", content, payloads=True))
    assert [r["fault"] for r in rows] == [None] * len(texts)
    assert [r["payload"].decode() for r in rows] == texts
