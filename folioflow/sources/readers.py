"""Corpus scans, raw file intake and page decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.config import AdmissionRules
from folioflow.functions import html
from folioflow.functions.text import let
from folioflow.schemas import LAYOUT

# A decoder turns the bytes of one document into its pages, one list of layout blocks each.
Decoder = Callable[[bytes], Iterable[list[dict]]]

PAGES_AT_ONCE = 256  # that leave a worker together, whatever else holds
BYTES_AT_ONCE = 1 << 20  # of the contents they were decoded from


def scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet scan with a declared schema; filters and columns reach the file reader."""
    return spark.read.schema(schema).parquet(path)


def raw_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder as ``(path, modificationTime, length, content)`` rows."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def screen_files(files: DataFrame, rules: AdmissionRules, manifest: DataFrame | None = None) -> DataFrame:
    """Verdict by size and first bytes. The size limit reaches the file listing, so
    oversized files are judged without being read.

    ``files`` is any ``(path, length, content)``. Spark's file sources leave files of zero bytes
    out; a ``manifest(path, length)`` of all uploads brings them back. What it names and the
    listing lacks is ``empty`` if the manifest says 0 bytes, ``missing`` if its length is null,
    and else ``magic``: the file is there, but its name is of another kind.
    """
    large = files.where(F.col("length") > rules.max_bytes).select("path", "length", F.lit("size").alias("verdict"))
    small = files.where(F.col("length") <= rules.max_bytes)
    verdict = (
        F.when(F.col("length") == 0, "empty")
        .when(F.startswith("content", F.lit(rules.magic)), "admitted")
        .otherwise("magic")
    )
    judged = small.select("path", "length", verdict.alias("verdict")).unionByName(large)
    if manifest is None:
        return judged
    absent = manifest.select("path", F.col("length").cast("bigint").alias("length")).join(
        files.select("path"), "path", "left_anti"
    )
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length").isNull(), "missing").otherwise("magic")
    return judged.unionByName(absent.select("path", "length", reason.alias("verdict")))


HTML_LOOSE = "#text"


def html_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, block_no, tag, text``: all text of ``pages(page_id, html)`` by block elements.

    The same contract as layout blocks, for pages that come as HTML. Every opening or closing tag
    of a block element ends a block, so elements need no closing tag of their own. What an opening
    tag begins bears its name, text before the first tag or after a closing one is ``#text``. ``br`` is
    a space, other tags are nothing, character references are characters, and a ``<`` without a letter
    behind it is text; an inline tag that is not closed before the next block edge stays as text.
    Narrow: a page stays one row until its blocks are numbered; blank blocks are left out and keep
    their number.
    """
    def blocks(page: Column) -> Column:
        def named(edges: Column) -> Column:
            return F.transform(edges, lambda e: F.when((e["close"] != "") | (F.lower(e["tag"]) == "hr"), HTML_LOOSE).otherwise(F.lower(e["tag"])))

        closes, tags = (F.regexp_extract_all(page, F.lit(html.EDGE), F.lit(g)) for g in (1, 2))
        opened = F.concat(F.array(F.lit(HTML_LOOSE)), named(F.arrays_zip(closes.alias("close"), tags.alias("tag"))))
        return F.transform(F.arrays_zip(opened.alias("tag"), F.split(page, html.EDGE, -1).alias("text")), lambda b, i: F.struct(
            i.alias("block_no"), b["tag"].alias("tag"), html.plain(b["text"]).alias("text")))

    found = let(F.regexp_replace("html", html.SILENT, " "), blocks)
    return pages.select("page_id", F.explode(F.filter(found, lambda b: b["text"] != "")).alias("b")).select("page_id", "b.*")


def decode_layout(documents: DataFrame, decoder: Decoder) -> DataFrame:
    """Layout rows of ``documents(doc_id, content)``, one per page.

    A document the decoder cannot read yields one row without page number and page count,
    which the intake reports as ``unreadable``; one without pages yields a row with 0 pages.
    Pages leave the worker with every ``PAGES_AT_ONCE`` of them or ``BYTES_AT_ONCE`` of content, after a whole document.
    """
    out = to_arrow_schema(LAYOUT)

    def pages_of(doc_id: int, content: bytes) -> list[dict]:
        try:
            pages = list(decoder(content))
        except Exception:
            return [{"doc_id": doc_id, "page_num": None, "n_pages": None, "blocks": None}]
        if not pages:
            return [{"doc_id": doc_id, "page_num": None, "n_pages": 0, "blocks": None}]
        return [
            {"doc_id": doc_id, "page_num": n, "n_pages": len(pages), "blocks": blocks}
            for n, blocks in enumerate(pages)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, content in zip(batch["doc_id"], batch["content"]):
                data = content.as_py()
                rows += pages_of(doc_id.as_py(), data)
                held += len(data or b"")
                if len(rows) >= PAGES_AT_ONCE or held >= BYTES_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return documents.select("doc_id", "content").mapInArrow(run, LAYOUT)
