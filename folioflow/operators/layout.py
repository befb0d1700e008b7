"""From page layout trees to text blocks.

A page decoder returns one tree per page: blocks of lines of spans. Folding such a tree
needs nothing from any other row, so everything below is a narrow projection: no shuffle,
whatever the size of the corpus, and no document or page can become a hot key.

``fold_spans`` gives the same blocks for a source that only has a flat span table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.config import DEFAULT_FONT_SIZE, MIN_BLOCK_CHARS, ROUTE, STATUS
from folioflow.functions.text import let, strip

BLOCK_KEY = ["doc_id", "page_num", "block_no"]


def spans_of(layout: DataFrame) -> DataFrame:
    """Flatten layout trees to one row per span, with the position at every level."""

    def span(s: Column, no: Column, line_no: Column, block: Column, block_no: Column) -> Column:
        return F.struct(
            block_no.alias("block_no"), line_no.alias("line_no"), no.alias("span_no"),
            block["type"].alias("block_type"), s["text"].alias("text"),
            *[s["bbox"][k].alias(k) for k in ("x0", "y0", "x1", "y1")],
            s["font"].alias("font"), s["size"].alias("size"),
        )

    def of_block(block: Column, block_no: Column) -> Column:
        of_line = lambda line, i: F.transform(line["spans"], lambda s, no: span(s, no, i, block, block_no))
        return F.flatten(F.transform(block["lines"], of_line))

    spans = F.explode(F.flatten(F.transform("blocks", of_block)))
    return layout.select("doc_id", "page_num", spans.alias("s")).select("doc_id", "page_num", "s.*")


def common_font(fonts: Column) -> Column:
    """The most frequent font; the smallest name where several are equally frequent."""
    return let(
        fonts,
        lambda all_: F.array_min(
            F.transform(
                F.array_distinct(all_),
                lambda f: F.struct((-F.size(F.filter(all_, lambda x: x == f))).alias("rank"), f.alias("font")),
            )
        )["font"],
    )


def mean_size(sizes: Column) -> Column:
    total = F.aggregate(sizes, F.lit(0.0), lambda acc, s: acc + s)
    return F.coalesce(total / F.nullif(F.size(sizes), F.lit(0)), F.lit(DEFAULT_FONT_SIZE))


def union_box(boxes: Column) -> Column:
    """Smallest box that holds all of them."""
    return F.struct(
        F.array_min(F.transform(boxes, lambda b: b["x0"])).alias("x0"),
        F.array_min(F.transform(boxes, lambda b: b["y0"])).alias("y0"),
        F.array_max(F.transform(boxes, lambda b: b["x1"])).alias("x1"),
        F.array_max(F.transform(boxes, lambda b: b["y1"])).alias("y1"),
    )


def _folded(block: Column, number: Column) -> Column:
    def fields(spans: Column) -> Column:
        boxes = F.transform(spans, lambda s: s["bbox"])
        return F.struct(
            number.alias("block_no"),
            strip(F.array_join(F.transform(spans, lambda s: s["text"]), " ")).alias("text"),
            boxes.alias("bboxes"),
            union_box(boxes).alias("rect"),
            common_font(F.transform(spans, lambda s: s["font"])).alias("font"),
            mean_size(F.transform(spans, lambda s: s["size"])).alias("size"),
        )

    return let(F.flatten(F.transform(block["lines"], lambda line: line["spans"])), fields)


def _kept_blocks() -> Column:
    numbered = F.transform("blocks", lambda b, i: F.struct(b["type"].alias("type"), b["lines"].alias("lines"), i.alias("no")))
    text_only = F.filter(numbered, lambda b: b["type"] == 0)
    folded = F.transform(text_only, lambda b: _folded(b, b["no"]))
    return F.filter(folded, lambda b: b["text"] != "")


def page_blocks(layout: DataFrame) -> DataFrame:
    """One row per page with its non-blank text blocks as an ordered array.

    Image blocks and blank blocks are left out; ``block_no`` keeps the position the
    block has on the page.
    """
    return layout.select("doc_id", "page_num", "n_pages", _kept_blocks().alias("text_blocks"))


def block_texts() -> Column:
    """Number and text of the blocks that ``page_blocks`` keeps, without their boxes and fonts."""
    numbered = F.transform("blocks", lambda b, i: F.struct(
        i.alias("block_no"),
        F.when(b["type"] == 0, strip(F.array_join(F.flatten(F.transform(b["lines"], lambda line: line["spans"]["text"])), " "))).alias("text")))
    return F.filter(numbered, lambda b: b["text"] != "")


def text_blocks(layout: DataFrame) -> DataFrame:
    """One row per text block. ``block_seq`` counts only the blocks that were kept."""
    # The array goes straight into the generator: exploding a column of an earlier select
    # makes the optimiser add a "not empty" filter that folds every page once more.
    return _block_rows(layout, _kept_blocks())


def blocks_of(pages: DataFrame) -> DataFrame:
    """The same rows from pages that are folded already (``page_blocks``)."""
    return _block_rows(pages, F.col("text_blocks"))


def _block_rows(rows: DataFrame, found: Column) -> DataFrame:
    return rows.select("doc_id", "page_num", "n_pages", F.posexplode(found).alias("block_seq", "b")).select(
        "doc_id", "page_num", "b.block_no", "n_pages", "block_seq",
        "b.text", "b.bboxes", "b.rect", "b.font", "b.size",
    )


def page_status() -> Column:
    """What became of a page or, where a document has none, of the document."""
    return (
        F.when(F.col("n_pages").isNull(), STATUS.unreadable)
        .when(F.col("n_pages") == 0, STATUS.no_pages)
        .otherwise(STATUS.translated)
    )


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share an area."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def collisions(layout: DataFrame) -> DataFrame:
    """Per text block, how many earlier blocks of its page it overlaps.

    Edits are applied block by block, so clearing such a block wipes out what was written
    before it. Counted within the page's own row.
    """
    earlier = F.transform("text_blocks", lambda b, i: F.struct(
        b["block_no"].alias("block_no"),
        F.size(F.filter(F.slice("text_blocks", F.lit(1), i), lambda e: overlaps(e["rect"], b["rect"]))).alias("n_earlier"),
    ))
    pages = page_blocks(layout).select("doc_id", "page_num", F.explode(earlier).alias("b"))
    return pages.select("doc_id", "page_num", "b.block_no", "b.n_earlier")


def fold_spans(spans: DataFrame) -> DataFrame:
    """Blocks from a flat span table ``(…ordinals, block_type, text, x0…y1, font, size)``.

    One shuffle on the block key. A group is one block, that is one string of one page,
    so a long document spreads over many tasks.
    """
    ordered = F.array_sort(
        F.collect_list(
            F.struct("line_no", "span_no", "text", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "size")
        )
    )
    grouped = (
        spans.where("block_type = 0")
        .groupBy(*BLOCK_KEY)
        .agg(
            ordered.alias("spans"),
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
            F.mode("font", True).alias("font"),
            F.coalesce(F.avg("size"), F.lit(DEFAULT_FONT_SIZE)).alias("size"),
        )
    )
    return grouped.select(
        *BLOCK_KEY,
        strip(F.array_join("spans.text", " ")).alias("text"),
        F.col("spans.bbox").alias("bboxes"),
        F.struct("x0", "y0", "x1", "y1").alias("rect"),
        "font", "size",
    ).where("text <> ''")


def route(page_num: Column, text: Column, skip_pages: Sequence[int]) -> Column:
    """Where a block goes. Nothing is dropped: untranslated blocks keep their text."""
    skipped = page_num.isin(*skip_pages) if skip_pages else F.lit(False)
    return (
        F.when(skipped, ROUTE.skipped_page)
        .when(F.length(strip(text)) < MIN_BLOCK_CHARS, ROUTE.short)
        .otherwise(ROUTE.translate)
    )


def routed_blocks(blocks: DataFrame, skip_pages: Sequence[int] = ()) -> DataFrame:
    return blocks.withColumn("route", route(F.col("page_num"), F.col("text"), skip_pages))


def block_batches(blocks: DataFrame, batch_size: int) -> DataFrame:
    """Number of the batch each block of a page falls into; has no effect on results."""
    return blocks.withColumn("batch_no", F.floor(F.col("block_seq") / batch_size).cast("int"))


def blank_pages(layout: DataFrame) -> DataFrame:
    """Pages that pass through because no text was found on them; stops at the first text."""

    def has_text(block: Column) -> Column:
        filled = lambda line: F.exists(line["spans"], lambda s: strip(s["text"]) != "")
        return (block["type"] == 0) & F.exists(block["lines"], filled)

    return layout.where(F.col("page_num").isNotNull() & ~F.exists("blocks", has_text)).select("doc_id", "page_num")


def flagged_pages(layout: DataFrame, skip_pages: Sequence[int]) -> DataFrame:
    """All pages, with a flag on those the job leaves untranslated."""
    skipped = F.col("page_num").isin(*skip_pages) if skip_pages else F.lit(False)
    return layout.select("doc_id", "page_num", skipped.alias("skipped"))


def page_counts(layout: DataFrame) -> DataFrame:
    """Pages per document: 0 without any, null if unreadable.

    Each page carries the number, so the first one tells it without a shuffle.
    """
    return layout.where("page_num = 0 OR page_num IS NULL").select("doc_id", "n_pages")
