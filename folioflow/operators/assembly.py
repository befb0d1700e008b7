"""Put translated pieces back together: chunks → blocks → pages → documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.config import ROUTE, TranslationConfig
from folioflow.functions.chunking import chunk_text
from folioflow.functions.text import let
from folioflow.operators.layout import block_texts, page_blocks, page_status, route
from folioflow.operators.translation import EMPTY, FAILED, ColumnTranslator, translate_inline


def ordered_text(ordinal: str, text: str, separator: str) -> Column:
    """Aggregate: texts of a group in ordinal order. ``collect_list`` alone has no order."""
    return F.array_join(F.array_sort(F.collect_list(F.struct(ordinal, text)))[text], separator)


def rejoin(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Chunks of one text back to that text, joined with a space.

    A group is what one input string was cut into, so it is as bounded as that string.
    """
    failed = F.count_if(F.col("status").isin(FAILED, EMPTY))
    return chunks.groupBy(*by).agg(
        ordered_text("chunk_no", "translated", " ").alias("translated"),
        F.count(F.lit(1)).cast("int").alias("n_chunks"),
        failed.cast("int").alias("n_failed"),
    )


def page_pieces(layout: DataFrame, config: TranslationConfig) -> DataFrame:
    """All text of a page in pieces ``(doc_id, page_num, n_pages, block_no, chunk_no, text, sent)``.

    Blocks that are ``sent`` to a translator come in chunks, others whole. Every page also has a
    piece without block, so that pages without any text stay in. No shuffle.
    """
    piece = "struct<block_no: int, chunk_no: int, text: string, sent: boolean>"
    page_only = F.array(F.struct(*[F.lit(None).alias(c) for c in ("block_no", "chunk_no", "text", "sent")]).cast(piece))

    def cut(block: Column) -> Column:
        chunks = F.when(block["sent"], chunk_text(block["text"], config.max_chunk_size)).otherwise(F.array(block["text"]))
        return F.transform(chunks, lambda c, i: F.struct(block["block_no"], i.alias("chunk_no"), c.alias("text"), block["sent"]))

    def routed(block: Column) -> Column:
        sent = route(F.col("page_num"), block["text"], config.skip_pages) == ROUTE.translate
        return F.struct(block["block_no"].alias("block_no"), block["text"].alias("text"), sent.alias("sent"))

    # a document without pages has no blocks at all
    texts = F.coalesce(F.flatten(F.transform(F.transform(block_texts(), routed), cut)), F.array()).cast(f"array<{piece}>")
    pieces = layout.select("doc_id", "page_num", "n_pages", F.explode(F.concat(page_only, texts)).alias("p"))
    return pieces.select("doc_id", "page_num", "n_pages", "p.*")


def pages_of(pieces: DataFrame) -> DataFrame:
    """Translated pieces ``(doc_id, page_num, page_status, block_no, chunk_no, translated, status)`` to pages, in one shuffle.

    Chunks of a block are joined with a space, blocks with a line break. ``status`` is null for what was
    not sent. A group is the text of one page.
    """
    def joined(ordered: Column) -> Column:
        same = lambda p, i: F.get(ordered, i - 1)["block_no"] == p["block_no"]
        between = lambda p, i: F.when(i == 0, "").when(same(p, i), " ").otherwise("\n")
        return F.array_join(F.transform(ordered, lambda p, i: F.concat(between(p, i), p["translated"])), "")

    in_block = F.when(F.col("block_no").isNotNull(), F.struct("block_no", "chunk_no", "translated"))
    pages = pieces.groupBy("doc_id", "page_num").agg(
        F.max("page_status").alias("page_status"),
        F.array_sort(F.collect_list(in_block)).alias("parts"),
        F.count("status").cast("int").alias("n_chunks"),
        F.count_if(F.col("status").isin(FAILED, EMPTY)).cast("int").alias("n_failed"),
    )
    return pages.select(
        "doc_id", "page_num", F.col("page_status").alias("status"),
        F.when(F.col("page_num").isNotNull(), let(F.col("parts"), joined)).alias("translated"),
        F.size(F.array_distinct(F.col("parts.block_no"))).alias("n_blocks"),
        "n_chunks", "n_failed",
    )


def translated_pages(layout: DataFrame, config: TranslationConfig, translator: ColumnTranslator) -> DataFrame:
    """One row per page with its blocks translated in place; no shuffle.

    A document without pages has one row, without page number and text.
    """

    def finish(block: Column) -> Column:
        way = route(F.col("page_num"), block["text"], config.skip_pages)
        untouched = F.struct(block["text"].alias("text"), F.lit(0).alias("n_chunks"), F.lit(0).alias("n_failed"))
        return F.when(way == ROUTE.translate, translate_inline(block["text"], translator, config.max_chunk_size)).otherwise(untouched)

    def total(field: str) -> Column:
        return F.coalesce(F.aggregate("done", F.lit(0), lambda acc, b: acc + b[field]), F.lit(0))

    pages = page_blocks(layout).withColumn("done", F.transform("text_blocks", finish))
    return pages.select(
        "doc_id", "page_num", "n_pages", page_status().alias("status"),
        F.array_join(F.transform("done", lambda b: b["text"]), "\n").alias("translated"),
        F.when(F.col("done").isNotNull(), F.size("done")).otherwise(0).alias("n_blocks"),
        total("n_chunks").alias("n_chunks"),
        total("n_failed").alias("n_failed"),
    )


def documents_of(pages: DataFrame) -> DataFrame:
    """Pages to documents: one shuffle of finished page texts.

    A group is the pages of one document, whose result is one string. Sinks that do not
    need that string should take the pages themselves. ``status`` tells documents without
    pages from those that could not be read; neither has a text.
    """
    n_pages = F.count("page_num").cast("int")
    return pages.groupBy("doc_id").agg(
        F.when(n_pages > 0, ordered_text("page_num", "translated", "\n")).alias("translated"),
        n_pages.alias("n_pages"),
        F.sum("n_blocks").cast("int").alias("n_blocks"),
        F.sum("n_chunks").cast("int").alias("n_chunks"),
        F.sum("n_failed").cast("int").alias("n_failed"),
        F.max("status").alias("status"),
    )
