import base64
import gzip
import hashlib
from collections import Counter

from folioflow.llm import warc
from folioflow.operators.shared import run_folder

PAGES = [
    (1, "https://a.example/x", "<p>one</p>"), (2, None, None), (3, "https://b.example/\r\ny", ""), (4, "u", "<p>one</p>"),
    (5, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (9, "u", "<p>one</p>"), (7, "u", "x" * 200_000), (5, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (None, "n", "<p>one</p>"),
]


def roundtrip(spark, rows, least=0, file_bytes=1000):
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id BIGINT, url STRING, html STRING, digest STRING")
    folder = run_folder(spark, "warc")
    warc.write_archives(pages, folder, least, file_bytes)
    return warc.assemble(warc.read_archives(spark, folder))


def test_captures_come_back_whole(spark):
    captures = roundtrip(spark, PAGES).cache()
    got = {r["page_id"]: r for r in warc.captures_report(captures).collect()}
    assert len(got) == len({i for i, *_ in PAGES}) and captures.count() == len(PAGES)
    largest = {}
    for i, _, html in PAGES:
        if i is not None:
            largest[html or ""] = max(largest.get(html or "", i), i)
    for i, _, html in PAGES:
        payload = (html or "").encode()
        row = got[i]
        assert row["payload_bytes"] == len(payload)
        assert row["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        original = largest[html or ""]
        again = i is not None and i < original
        assert (row["record_type"], row["refers_to"]) == (("revisit", original) if again else ("response", None))
    for row in captures.collect():
        assert row["request"]["concurrent_to"] == row["metadata"]["concurrent_to"] == row["response"]["record_id"]
        assert row["request"]["content"].startswith(b"GET ")
    texts = {bytes(r["response"]["content"]) for r in captures.collect() if r["response"]["record_type"] == "response"}
    assert texts == {(h or "").encode() for _, _, h in PAGES}


def test_short_payloads_are_kept_and_empty_tables(spark):
    kinds = [r["record_type"] for r in warc.captures_report(roundtrip(spark, PAGES, least=100)).collect()]
    assert set(kinds) == {"response"}
    assert roundtrip(spark, []).count() == 0


def test_every_row_is_a_capture(spark):
    rows = [(1, "http://a", "same"), (1, "http://b", "same"), (1, "http://a", "same"), (None, "n", "same"), (None, "n", "same"),
            (0, "http://a", "same"), (0, None, "same")] + [(3, "z", "other")] * 2500
    captures = roundtrip(spark, rows, file_bytes=4000).cache()
    got = warc.captures_report(captures)
    found = Counter(tuple(r) for r in got.select("page_id", "target_uri", "record_type", "refers_to").collect())
    assert found == Counter({
        (1, "http://a", "response", None): 2, (1, "http://b", "response", None): 1, (None, "n", "response", None): 2,
        (0, "http://a", "revisit", 1): 1, (0, "", "revisit", 1): 1, (3, "z", "response", None): 2500})
    assert captures.select("capture_id").distinct().count() == len(rows)
    named = {r["capture_id"] for r in captures.collect()}
    assert {r["response"]["refers_to"] for r in captures.where("response.record_type = 'revisit'").collect()} <= named


def test_files_are_bounded_by_bytes(spark):
    rows = [(i, "u", "x" * 1000 + str(i)) for i in range(200)] + [(900, "u", "y" * 50_000_000)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    folder = run_folder(spark, "warc")
    warc.write_archives(pages, folder, file_bytes=100_000)
    sizes = [len(gzip.decompress(bytes(r["content"]))) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).collect()]
    assert sum(s > 110_000 for s in sizes) == 1 and len(sizes) > 4
    got = warc.captures_report(warc.assemble(warc.read_archives(spark, folder, with_content=False)))
    assert got.count() == 201 and got.where("page_id = 900").first()["payload_bytes"] == 50_000_000


def test_payloads_are_dealt_once_where_no_row_repeats(spark):
    rows = [(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    found = warc.with_originals(pages)
    # a second branch for repeats would shuffle all payloads again, to find none
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["page_id"], r["original"] is None) for r in found.collect()} == {(i, i + 7 >= 40) for i, *_ in rows}
    again = warc.with_originals(pages.union(pages.where("page_id = 3"))).collect()
    assert len(again) == 41 and len({r["name"] for r in again}) == 41
    assert len({r["original"] for r in again if r["page_id"] == 3}) == 1
