"""WARC archives: write captures, read them back, assemble each transaction.

A capture is three records: ``request``, ``response`` (or ``revisit`` where an equal payload is
stored elsewhere) and ``metadata``. Request and metadata name the response in
``WARC-Concurrent-To``; the reader joins the three through that identifier and gives one nested
row per capture.

Archives are ordinary WARC files, compressed whole, written by Spark's text writer into the
shared folder: a record is a line whose separator is the two line ends that close every record.
A task that runs again replaces its own files.

Defined results:

* null payload: empty payload; null url: empty target URI; null id: always a response;
* equal payloads: the largest id is the response, the others revisit it;
* every row is a capture of its own, also where ids, urls and payloads repeat: a capture's name is its
  id, payload digest, url hash and the number of the repeat;
* empty table: no archive records, no captures;
* extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import in_arrow, slices
from folioflow.operators.shared import materialise

END = "\r\n"
CLOSE = END + END  # after every record
RECORDS = (
    "record_id STRING, record_type STRING, concurrent_to STRING, refers_to STRING, target_uri STRING, "
    "payload_digest STRING, payload_bytes BIGINT, content BINARY"
)
FILE_BYTES = 32 << 20  # of a file before it is compressed; a larger capture is a file of its own
REPEATS = 1000  # equal rows written by one task at a time


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record(kind: str, record_id: str, block: str, headers: list[tuple[str, str]]) -> str:
    length = len(block.encode("utf-8", "surrogatepass"))
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("Content-Length", str(length))]
    return "WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in fields) + END + block


def _one_line(text: str | None) -> str:
    """Header values hold no line ends."""
    return " ".join((text or "").split())


def _captures(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Captures in bundles of at most ``file_bytes``, a bundle a row."""
        held: list[str] = []
        size = 0
        for batch in slices(batches, 1000, "html", 1 << 23):
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                capture = _capture(*row)
                more = len(capture.encode("utf-8", "surrogatepass"))
                if held and size + more > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([CLOSE.join(held)], pa.string())], ["value"])
                    held, size = [], 0
                held.append(capture)
                size += more
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([CLOSE.join(held)], pa.string())], ["value"])

    return run


def _capture(name: str, page_id: int | None, url: str | None, html: str, original: str | None) -> str:
    """The three records of a capture; ``original`` is the name of the one whose payload it repeats."""
    payload = html.encode("utf-8", "surrogatepass")
    digest, uri = _digest(payload), _one_line(url)
    named = lambda capture, part: f"<urn:capture:{capture}:{part}>"
    response = named(name, "response")
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(payload)}{CLOSE}"
    shared = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    beside = [("WARC-Target-URI", uri), ("WARC-Concurrent-To", response)]
    if original is None:
        main = _record("response", response, http + html, shared)
    else:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        main = _record("revisit", response, http, [*shared, profile, ("WARC-Refers-To", named(original, "response"))])
    asked = f"GET {uri} HTTP/1.1{CLOSE}"
    facts = f"page_id: {'' if page_id is None else page_id}{END}payload_bytes: {len(payload)}{END}"
    return CLOSE.join((
        _record("request", named(name, "request"), asked, beside), main, _record("metadata", named(name, "metadata"), facts, beside)))


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """``name, page_id, url, html, original`` of every row, ``name`` its own and ``original`` that of the response with an equal payload.

    Of equal payloads of at least ``least`` bytes the largest id is the response (of several rows of that id
    one of them); smaller ids revisit it. Only names and digests are grouped, and joined by digest only
    those of digests that occur twice; the payloads meet the answer on their own name, so copies of one
    page do not meet in one task. Rows equal in id, url and payload are counted, and written in portions
    by many tasks.
    """
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    once = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.left("digest", F.lit(40)), F.coalesce(F.sha1("url"), F.lit("-")))
    keyed = keyed.withColumn("name", once)
    names = materialise(keyed.withColumn("long", F.octet_length("html") >= least).groupBy("name", "page_id", "digest", "long").agg(F.count(F.lit(1)).alias("n")), "names")
    first = F.max(F.struct("page_id", "name")).alias("first")
    largest = names.where("long AND page_id IS NOT NULL").groupBy("digest").agg(first, F.min("page_id").alias("least_id")).where("least_id < first.page_id")
    revisits = names.where("long").join(largest, "digest").where("page_id < first.page_id").select("name", F.concat(F.col("first.name"), F.lit(":0")).alias("original"))
    columns = ["page_id", "url", "html", "original"]
    repeated = materialise(names.where("n > 1").select("name", "n"), "repeated")
    if repeated.isEmpty():
        # payloads cross the network once, to meet their answer
        return keyed.join(revisits, "name", "left").select(F.concat("name", F.lit(":0")).alias("name"), *columns)
    alone = keyed.join(repeated, "name", "left_anti").join(revisits, "name", "left")
    single = alone.select(F.concat("name", F.lit(":0")).alias("name"), *columns)
    firsts = [F.first(c).alias(c) for c in ("page_id", "url", "html", "n")]
    equal = keyed.join(repeated, "name").groupBy("name").agg(*firsts).join(revisits, "name", "left")
    portions = equal.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {REPEATS}"))))
    dealt = portions.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.explode(F.sequence(F.col("part") * REPEATS, F.least(F.col("n"), (F.col("part") + 1) * REPEATS) - 1))
    repeats = dealt.withColumn("number", number).select(F.concat_ws(":", "name", F.col("number").cast("string")).alias("name"), *columns)
    return single.unionByName(repeats)


def write_archives(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Three records per row of ``pages(page_id, url, html)`` below ``folder``, in files of about ``file_bytes``."""
    rows = in_arrow(with_originals(pages, least), _captures(file_bytes), "value STRING")
    (
        rows.write.mode("overwrite").option("lineSep", CLOSE).option("compression", "gzip")
        .option("maxRecordsPerFile", 1).text(folder)
    )


def _parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, cut by their stated lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record must begin with its version")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("a record is shorter than it says")
        yield headers, block


def _http_body(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(CLOSE.encode())
    lines = head.decode("utf-8", "surrogatepass").split(END)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def _reader(with_content: bool):
    schema = pa.schema([
        *((n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "payload_digest")),
        ("payload_bytes", pa.int64()), ("content", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                    for headers, block in _parse(stream):
                        kind, digest, size, body = headers["warc-type"], None, None, block
                        if kind in ("response", "revisit"):
                            http, body = _http_body(block)
                            stated = headers["warc-payload-digest"].removeprefix("sha1:")
                            size = int(http["content-length"])
                            digest = _digest(body) if kind == "response" else stated
                            if digest != stated or kind == "response" and len(body) != size:
                                raise ValueError("a payload differs from its digest")
                        keep = body if with_content or kind == "metadata" else None
                        rows.append((
                            headers["warc-record-id"], kind, headers.get("warc-concurrent-to"),
                            headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, size, keep,
                        ))
                        held += len(keep or b"")
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_archives(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """One row per record (``RECORDS``). ``content`` is the payload of a response, else the block.

    A file is read by one task, record by record; its compressed bytes are held at once, so
    archives should be written in files of bounded size. Digests and lengths are checked.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(_reader(with_content), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """``capture_id, request, response, metadata``: one nested row per transaction.

    The three kinds are joined through the concurrent-to identifier. Ids are unique per
    capture, so no join key is heavy. A transaction without request or metadata has nulls there.
    """
    def part(kinds: tuple[str, ...], key: str, name: str) -> DataFrame:
        rows = records.where(F.col("record_type").isin(*kinds)).select(
            F.col(key).alias("capture_id"), F.struct("*").alias(name)
        )
        return rows.groupBy("capture_id").agg(F.first(name).alias(name))

    return (
        part(("response", "revisit"), "record_id", "response")
        .join(part(("request",), "concurrent_to", "request"), "capture_id", "left")
        .join(part(("metadata",), "concurrent_to", "metadata"), "capture_id", "left")
        .select("capture_id", "request", "response", "metadata")
    )


def captures_report(captures: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of assembled captures."""
    def page_of(urn) -> F.Column:
        return F.regexp_extract(urn, r"<urn:capture:(-?[0-9]+):", 1).try_cast("bigint")

    facts = F.col("metadata.content").cast("string")
    return captures.select(
        F.regexp_extract(facts, r"page_id: (-?[0-9]+)", 1).try_cast("bigint").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
    )
