"""Inputs the queries derive from the given tables.

The tables hold plain text and web pages, so layout trees, jobs and endpoint URLs are
derived from whole tables by projections; they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.config import AdmissionRules, Endpoint, ServerDefaults, TranslationConfig
from folioflow.functions.text import let
from folioflow.operators.shared import spread
from folioflow.sources.readers import scan
from folioflow.streaming.jobs import arriving

LINES_PER_PAGE = 20
LINES_PER_BLOCK = 4
FONTS = ("helvetica", "Times-Bold")
SKIP_PAGES = (1,)
CONFIG = TranslationConfig("English", "Spanish", model="stand-in", skip_pages=SKIP_PAGES)
LANGUAGE_CODES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}
JOB_RULES = AdmissionRules(languages=("en", "fr", "es"), magic=b"<!DOCTYPE", max_bytes=4_000)
DEFAULTS = ServerDefaults(
    caller=Endpoint("https://llm.example.com/v1", "small"),
    server=Endpoint("https://llm.example.net/v1", "large"),
    local=Endpoint("http://llm.example.org/v1", "local"),
    hosted=True, server_has_key=True,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", getattr(schemas, name.upper()))


def arriving_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. The pattern lets the same path be one file or a folder of files."""
    return arriving(spark, f"{sf_dir}/{name}.parque[t]", getattr(schemas, name.upper()))


def documents(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def layout_of(docs: DataFrame) -> DataFrame:
    """A layout tree per page of ``docs(doc_id, text)``: 20 lines a page, 4 lines a block,
    one span per comma; made-up geometry, with tight lines in every fifth document."""
    doc = F.col("doc_id")
    pitch = F.when(doc % 5 == 0, 8).otherwise(18)

    def paged(lines: Column) -> Column:
        last = F.floor((F.size(lines) - 1) / LINES_PER_PAGE).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda p: F.struct(
                (last + 1).alias("n_pages"), F.slice(lines, p * LINES_PER_PAGE + 1, LINES_PER_PAGE).alias("lines")
            ),
        )

    pages = docs.select("doc_id", F.posexplode(let(F.split("text", "\n"), paged)).alias("page_num", "page"))
    pages = pages.select("doc_id", "page_num", "page.n_pages", "page.lines")

    def span(text: Column, no: Column, at: Column, mark: Column) -> Column:
        shown = F.when(mark % 13 == 0, F.left(text, F.lit(2))).when(mark % 17 == 0, " ").otherwise(text)
        pick = (doc + F.col("page_num") * LINES_PER_PAGE + at + no) % 7
        box = F.struct(
            (72 + 40 * no).cast("double").alias("x0"),
            (72 + pitch * at).cast("double").alias("y0"),
            (72 + 40 * no + 5 * F.length(text)).cast("double").alias("x1"),
            (72 + pitch * at + 10 + doc % 3).cast("double").alias("y1"),
        )
        return F.struct(
            shown.alias("text"), box.alias("bbox"),
            F.when(pick == 0, "Times-Bold").when(pick == 1, "ABCDEF+Custom").otherwise("helvetica").alias("font"),
            (10 + (doc + no) % 3).cast("double").alias("size"),
        )

    def line(text: Column, i: Column, block: Column, mark: Column) -> Column:
        at = block * LINES_PER_BLOCK + i
        spans = F.transform(F.split(text, ", "), lambda t, no: span(t, no, at, mark))
        # marked blocks consist of their very first span only
        kept = F.when(mark % 13 != 0, spans).when(i == 0, F.slice(spans, 1, 1)).otherwise(F.slice(spans, 1, 0))
        return F.struct(kept.alias("spans"))

    def block(no: Column) -> Column:
        mark = doc + F.col("page_num") * (LINES_PER_PAGE // LINES_PER_BLOCK) + no
        own = F.slice("lines", no * LINES_PER_BLOCK + 1, F.lit(LINES_PER_BLOCK))
        return F.struct(
            F.when(mark % 11 == 0, 1).otherwise(0).alias("type"),
            F.transform(own, lambda text, i: line(text, i, no, mark)).alias("lines"),
        )

    numbers = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES_PER_BLOCK).cast("int"))
    return pages.select("doc_id", "page_num", "n_pages", F.transform(numbers, block).alias("blocks"))


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_of(documents(spark, sf_dir, "doc_id", "text"))


def stand_in(text: Column) -> Column:
    """Column translator for tests: marks the text, swaps letters, and fails or answers
    blank for certain lengths."""
    swapped = F.concat(F.lit("[es] "), F.translate(text, "aeiou0", "eioua1"))
    return F.when(F.length(text) % 17 == 1, " ").when(F.length(text) % 17 != 0, swapped)


def stand_in_batch(texts: list[str]) -> list:
    """The same translator as a batch function, as a service would be called."""
    swap = bytes.maketrans(b"aeiou0", b"eioua1")

    def one(text: str):
        if len(text) % 17 == 0:
            return RuntimeError("no answer")
        # ASCII letters for ASCII letters: the bytes of no other letter are touched
        return " " if len(text) % 17 == 1 else "[es] " + text.encode().translate(swap).decode()

    return [one(t) for t in texts]


def admission_jobs(pages: DataFrame) -> DataFrame:
    page = F.col("page_id")
    return pages.select(
        page.alias("job_id"),
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("source_lang"),
        F.lit("es").alias("target_lang"),
        F.when(page % 13 == 0, "").when(page % 7 == 0, F.concat(F.lit("x"), "html")).otherwise(F.col("html")).alias("content"),
        F.when(page % 10 == 0, "x").when(page % 11 == 0, "200000")
        .otherwise(F.octet_length("html").cast("string")).alias("declared"),
        F.when(page % 19 != 0, (1 + page % 5).cast("int")).alias("n_pages"),
        (page % 12 != 5).alias("has_key"),
        F.when(page % 4 == 0, F.col("url")).when(page % 4 == 1, " ").otherwise("https://llm.example.com/v1").alias("base_url"),
    )


def endpoint_urls(pages: DataFrame) -> DataFrame:
    """The page URLs, two in three of them with the host put in another form."""
    page, n = F.col("page_id"), F.col("page_id") % 256
    octet = n.cast("string")
    value = (page * 16_777_259) % 4_294_967_296
    https = lambda *rest: F.concat(F.lit("https://"), *rest)
    forms = [
        F.col("url"),
        F.col("url"),
        https(F.lit("10."), octet, F.lit(".0.1/v1")),
        https(F.lit("user:pw@"), octet, F.lit(".20.30.40:8443/")),
        https(value.cast("string"), F.lit("/")),
        https(F.lit("0x"), F.lower(F.hex(value)), F.lit("/")),
        https(octet, F.lit(".258/")),
        https(F.lit("0"), F.conv(octet, 10, 8), F.lit(".0.0.1/")),
        https(F.lit("[::ffff:"), octet, F.lit(".1.1.1]/")),
        https(F.lit("[2001:4860:4860::"), F.lower(F.hex(n)), F.lit("]/")),
        https(F.lit("[fe80::"), F.lower(F.hex(n)), F.lit("]:443/")),
        F.concat(F.lit("https%3A%2F%2FHost"), octet, F.lit(".internal%2Fv1")),
        https(F.lit("LOCALHOST:"), octet, F.lit("/")),
        https(octet, F.lit(".1.1.999/")),
        F.concat(F.lit("ftp://a"), octet, F.lit(".example.com/")),
    ]
    form = (page % len(forms)).cast("int")
    return pages.select("page_id", F.get(F.array(*forms), form).alias("endpoint"))
