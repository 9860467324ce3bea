"""Archives: records, run merging and the merged index."""

import heapq
import random
from base64 import b32encode
from hashlib import sha1

from pyspark.sql import functions as F

from tallgene.llm import warc


def test_loser_tree_merges_like_a_heap():
    rng = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16, 21):
        runs = [sorted((rng.randint(0, 30), 0) for _ in range(rng.randint(0, 40))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_url_keys():
    assert warc.url_key("http://www.Example.com:81/A?b=C") == "com,example:81)/a?b=c"
    assert warc.url_key("https://a.example.com") == "com,example,a)/"
    assert [warc.url_key(u) for u in (None, "", "no host", "http://[bad")] == ["", "", "no host", "http://[bad"]


def test_record_round_trip():
    row = {"page_id": 3, "url": "http://a/\r\nX: y", "ts": "20200102030405", "html": "é" * 9, "digest": "D", "record_type": "response", "refers_to": None}
    back = warc.parse_record(warc.record_bytes(row))
    assert (back["page_id"], back["payload"], back["payload_bytes"], back["url"]) == (3, "é" * 9, 18, "http://a/%0D%0AX: y")
    back = warc.parse_record(warc.record_bytes(row | {"record_type": "revisit", "refers_to": 1, "page_id": None, "url": None}))
    assert (back["page_id"], back["payload"], back["payload_bytes"], back["refers_to"], back["payload_digest"]) == (None, None, 18, 1, "D")


def _pages(spark):
    rows = [(i, f"http://h{i % 5}.example.com/{i % 3}", f"page {i % 7}" if i % 4 else None, None if i == 6 else i) for i in range(40)]
    rows += [(0, "http://x/", None, 5), (None, None, "page 1", 9), (None, "http://[", "alone", 9), (99, "http://big/", "long " * 100_000, 1), (98, "http://e/", "", 2)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, t long").withColumn("ts", F.timestamp_seconds("t")).withColumn("digest", F.lit("own"))


def _expected(rows):
    first = {}
    for r in rows:
        if r["page_id"] is not None:
            body = r["html"] or ""
            first[body] = min(first.get(body, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        body = r["html"] or ""
        revisit = body in first and r["page_id"] != first[body]
        digest = b32encode(sha1(body.encode()).digest()).decode()
        out.append((r["page_id"], len(body.encode()), digest, "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=str)


def _read(index):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(index).collect()), key=str)


def test_archive_and_read_back(spark):
    pages = _pages(spark)
    index = warc.archive(pages)
    rows = index.orderBy("range_no", "place").collect()
    keys = [(r["urlkey"], r["ts"], r["page_id"] is None, r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys) and len(keys) == pages.count()
    assert _read(index) == _expected(pages.collect())


def test_many_runs_merge_in_passes(spark, monkeypatch):
    for name, value in (("FAN_IN", 2), ("GROUP", 2), ("RANGE", 4), ("ARCHIVE_BYTES", 2000)):
        monkeypatch.setattr(warc, name, value)
    pages = _pages(spark)
    folder = warc.scratch_path(spark, "warc")
    manifest = warc.write_archives(warc.with_roles(pages.select("page_id", "url", "html", "ts")).repartition(9), folder)
    assert manifest.count() > 4
    index = warc.merge_runs(manifest, folder)
    rows = index.orderBy("range_no", "place").collect()
    keys = [(r["urlkey"], r["ts"], r["page_id"] is None, r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys) and len(keys) == pages.count()
    assert _read(index) == _expected(pages.collect())


def test_small_payloads_can_be_exempt_and_empty_table(spark):
    pages = _pages(spark)
    roles = warc.with_roles(pages.select("page_id", "url", "html", "ts"), min_bytes=7).collect()
    assert all(r["record_type"] == "response" for r in roles)
    assert warc.archive(pages.limit(0)).count() == 0
