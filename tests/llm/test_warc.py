"""Archives: exact round trip, revisits, and splitting at every kind of place."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from brightwater.llm.warc import archive_root, archived, page_record, range_records, splittable_warc

FOLDER = "/root/testdata/sf0.001"


def wanted(rows, least=1000):
    """rows: (key, html) to key -> (bytes, digest, type, refers_to)."""
    out, largest = {}, {}
    for key, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            largest[data] = max(key, largest.get(data, key))
    for key, html in rows:
        data = (html or "").encode()
        other = largest.get(data, key)
        kind = ("response", None) if other == key else ("revisit", other)
        out[key] = (len(data), hashlib.sha1(data).hexdigest(), *kind)
    return out


def test_query_is_a_round_trip(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: tuple(r)[1:] for r in splittable_warc(spark, FOLDER).collect()}
    assert got == wanted([(r.page_id, r.html) for r in pages])


@pytest.mark.parametrize("split_bytes", [700, 1 << 20])
def test_revisits_and_odd_rows(spark, split_bytes):
    pick = random.Random(2)
    long = "".join(pick.choices("abcdefgh é", k=3000))
    rows = [(i, f"http://a.example/{i}", long) for i in range(40)]
    rows += [(50, None, None), (51, "no url\r\nX: 1", ""), (52, "http://b/", "short"), (53, "http://b/", "short")]
    rows += [(60 + i, "http://c/", "".join(pick.choices("xyz", k=2000))) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    found = archived(pages, archive_root(spark), split_bytes=split_bytes).collect()
    want = wanted([(k, html) for k, _, html in rows])
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == want
    assert len(found) == len(rows)
    html = {k: (h or "").encode() for k, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in found if r.record_type == "response")
    urls = {r.page_id: r.url for r in found}
    assert urls[50] is None and urls[51] == "no%20url%0D%0AX:%201" and urls[52] == "http://b/"
    assert archived(pages.limit(0), archive_root(spark)).collect() == []


def test_repeated_and_null_keys(spark):
    rows = [(1, "u", "x" * 1500), (1, "u", "x" * 1500), (None, "u", "x" * 1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = archived(pages, archive_root(spark)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in found) == [
        ("1", "revisit", None), ("1", "revisit", None), ("None", "response", None)
    ]


def test_every_cut_gives_every_record_once():
    """Also with gzip magic inside stored payloads."""
    pick = random.Random(5)
    data, want = b"", []
    for k in range(25):
        payload = bytes(pick.choices(range(256), k=pick.randint(0, 300)))
        payload += pick.choice([b"", b"\x1f\x8b\x08", gzip.compress(b"not a record"), gzip.compress(b"WARC/1.0 x" * 9)])
        data += page_record(k, f"http://h/{k}", len(payload), hashlib.sha1(payload).hexdigest(), payload, None)
        want.append((f"<urn:x-row:{k}>", payload))
    for size in (1, 2, 3, 17, 400, 10**6):
        found = []
        for start in range(0, len(data), size):
            for headers, block in range_records(io.BytesIO(data), start, start + size, step=64):
                found.append((headers["warc-record-id"], block.partition(b"\r\n\r\n")[2]))
        assert found == want


def test_damaged_bytes_between_members_are_passed_over():
    one = page_record(1, None, 2, hashlib.sha1(b"ab").hexdigest(), b"ab", None)
    two = page_record(2, None, 2, hashlib.sha1(b"cd").hexdigest(), b"cd", None)
    data = b"junk\x1f\x8b\x08junk" + one + b"\x1f\x8b" + one[:20] + two
    found = [h["warc-record-id"] for h, _ in range_records(io.BytesIO(data), 0, len(data))]
    assert found == ["<urn:x-row:1>", "<urn:x-row:2>"]
