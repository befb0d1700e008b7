"""Edit plans: what a renderer has to remove from a page and write in its place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.config import ROUTE, TranslationConfig
from folioflow.functions.text import let, strip, words
from folioflow.operators.layout import BLOCK_KEY, overlaps, page_blocks, route, routed_blocks
from folioflow.operators.translation import ColumnTranslator, translate_inline

ALIGN_LEFT = 0
CHAR_WIDTH, LINE_HEIGHT = 0.5, 1.2


def resolved_font(font: Column, available: Sequence[str], fallback: str) -> Column:
    """The block's own font if the renderer has it. The catalog is a driver-side list and
    becomes a set of literals in the plan."""
    return F.when(font.isin(*available), font).otherwise(fallback)


def translated_blocks(blocks: DataFrame, config: TranslationConfig, translator: ColumnTranslator) -> DataFrame:
    """Blocks the job replaces, with their new text; other blocks stay as they are on the page."""
    chosen = routed_blocks(blocks, config.skip_pages).where(F.col("route") == ROUTE.translate).drop("route")
    done = translate_inline(F.col("text"), translator, config.max_chunk_size)
    return chosen.withColumn("translated", done["text"])


def with_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Blocks with texts that came back from a service; keys are single blocks."""
    return blocks.join(translations.select(*BLOCK_KEY, "translated"), BLOCK_KEY)


def edit_plan(blocks: DataFrame, config: TranslationConfig, fonts: Sequence[str]) -> DataFrame:
    """Ordered edits of blocks that carry ``translated``.

    With ``preserve_layout`` a block is one edit: clear the union box and write into it.
    Without, every span box is cleared on its own and the text is inserted afterwards.
    """
    none = F.lit(None)

    def edit(op: str, box: Column, written: bool) -> Column:
        return F.struct(
            F.lit(op).alias("op"),
            box["x0"].alias("x0"), box["y0"].alias("y0"), box["x1"].alias("x1"), box["y1"].alias("y1"),
            (F.col("translated") if written else none.cast("string")).alias("text"),
            (resolved_font(F.col("font"), fonts, config.fallback_font) if written else none.cast("string")).alias("font"),
            (F.col("size") if written else none.cast("double")).alias("size"),
            (F.lit(ALIGN_LEFT) if written else none.cast("int")).alias("align"),
        )

    if config.preserve_layout:
        edits = F.array(edit("redact", F.col("rect"), True))
    else:
        clears = F.transform("bboxes", lambda box: edit("redact", box, False))
        edits = F.concat(clears, F.array(edit("insert", F.col("rect"), True)))
    rows = blocks.select("doc_id", "page_num", "block_no", F.posexplode(edits).alias("edit_no", "e"))
    return rows.select("doc_id", "page_num", "block_no", "edit_no", "e.*")


def overflows(text: Column, size: Column, rect: Column) -> Column:
    """Whether a text is likely not to fit its box: its width at ``CHAR_WIDTH`` of the font size
    per character, broken into lines of ``LINE_HEIGHT`` of the font size."""
    lines = F.ceil(F.length(text) * size * CHAR_WIDTH / F.nullif(rect["x1"] - rect["x0"], F.lit(0.0)))
    return F.coalesce(lines * size * LINE_HEIGHT > rect["y1"] - rect["y0"], F.lit(True))


def wrapped(text: Column, per_line: Column, lines: Column) -> Column:
    """``STRUCT<n_lines, n_lost>`` of a text set word by word into lines of ``per_line`` characters.

    A word goes on the line if it fits behind a space, else on the next one; a longer one than a line
    is cut. ``n_lost`` are the characters of words, or parts of words, behind line ``lines``.
    """
    room = F.greatest(per_line, F.lit(1))

    def put(acc: Column, word: Column) -> Column:
        size = F.length(word)
        beside = acc["used"] + F.when(acc["used"] > 0, 1).otherwise(0) + size <= room
        first = acc["line"] + F.when(beside | (acc["used"] == 0), 0).otherwise(1)  # line on which the word begins
        full = F.floor((size - 1) / room).cast("int")  # lines it fills before its last one
        kept = F.least(size, F.greatest((lines - first) * room, F.lit(0)))
        return F.when(beside, F.struct(
            acc["line"].alias("line"), (acc["used"] + F.when(acc["used"] > 0, 1).otherwise(0) + size).alias("used"),
            (acc["lost"] + F.when(acc["line"] < lines, 0).otherwise(size)).alias("lost"),
        )).otherwise(F.struct((first + full).alias("line"), (size - full * room).alias("used"), (acc["lost"] + size - kept).alias("lost")))

    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("used"), F.lit(0).alias("lost"))
    done = lambda acc: F.struct((acc["line"] + 1).alias("n_lines"), acc["lost"].alias("n_lost"))
    blank = F.struct(F.lit(0).alias("n_lines"), F.lit(0).alias("n_lost"))
    return F.when(strip(text) == "", blank).otherwise(F.aggregate(words(text), start, put, done))


def line_report(translated: DataFrame) -> DataFrame:
    """Per block that carries ``translated``: lines its box has room for, lines it takes, characters that fall out of it.

    Widths and heights are those of ``overflows``. Narrow: each block is set on its own.
    """
    width = F.floor((F.col("rect.x1") - F.col("rect.x0")) / (F.col("size") * CHAR_WIDTH)).cast("int")
    room = F.greatest(F.floor((F.col("rect.y1") - F.col("rect.y0")) / (F.col("size") * LINE_HEIGHT)).cast("int"), F.lit(0))
    sized = translated.select(*BLOCK_KEY, "translated", width.alias("per_line"), room.alias("n_room"))
    done = sized.withColumn("w", wrapped(F.col("translated"), F.col("per_line"), F.col("n_room")))
    return done.select(*BLOCK_KEY, "n_room", "w.n_lines", "w.n_lost")


def covered_area(rects: Column) -> Column:
    """Area of a union of rectangles: their edges cut the plane into slabs, in each of which intervals are merged."""
    def slab(edges: Column, i: Column) -> Column:
        left, right = F.get(edges, i), F.get(edges, i + 1)
        inside = F.filter(rects, lambda r: (r["x0"] <= left) & (r["x1"] >= right))
        spans = F.array_sort(F.transform(inside, lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"))))
        merged = F.aggregate(spans, F.struct(F.lit(0.0).alias("total"), F.lit(float("-inf")).alias("reach")), lambda acc, s: F.struct(
            (acc["total"] + F.greatest(F.lit(0.0), s["y1"] - F.greatest(acc["reach"], s["y0"]))).alias("total"),
            F.greatest(acc["reach"], s["y1"]).alias("reach")))
        return (right - left) * merged["total"]

    def total(edges: Column) -> Column:
        areas = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: slab(edges, i))
        return F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)

    edges = F.array_sort(F.array_distinct(F.concat(F.transform(rects, lambda r: r["x0"]), F.transform(rects, lambda r: r["x1"]))))
    return F.when(F.size(rects) == 0, 0.0).otherwise(let(edges, total))


def survival(layout: DataFrame, config: TranslationConfig) -> DataFrame:
    """Per text block ``n_clearing, cleared``: edits that wipe out some of what it ends up with, and the share of its box they clear.

    Edits come block by block. A replaced block loses to the edits behind its own; one that keeps its
    text loses to all of them. Boxes of no area have a share of 0. A page stays one row.
    """
    def beside(b: Column, at: Column) -> Column:
        later = F.filter("edited", lambda e: ((e["seq"] > at) | ~b["replaced"]) & (e["seq"] != at) & overlaps(e["rect"], b["rect"]))
        return F.transform(later, lambda e: F.struct(
            F.greatest(e["rect"]["x0"], b["rect"]["x0"]).alias("x0"), F.greatest(e["rect"]["y0"], b["rect"]["y0"]).alias("y0"),
            F.least(e["rect"]["x1"], b["rect"]["x1"]).alias("x1"), F.least(e["rect"]["y1"], b["rect"]["y1"]).alias("y1")))

    def judged(b: Column, at: Column) -> Column:
        area = (b["rect"]["x1"] - b["rect"]["x0"]) * (b["rect"]["y1"] - b["rect"]["y0"])
        return let(beside(b, at), lambda cut: F.struct(
            b["block_no"].alias("block_no"), F.size(cut).alias("n_clearing"),
            F.when(area > 0, covered_area(cut) / area).otherwise(0.0).alias("cleared")))

    replaced = lambda b: route(F.col("page_num"), b["text"], config.skip_pages) == ROUTE.translate
    placed = page_blocks(layout).withColumn("placed", F.transform("text_blocks", lambda b, i: F.struct(
        i.alias("seq"), b["block_no"].alias("block_no"), b["rect"].alias("rect"), replaced(b).alias("replaced"))))
    pages = placed.withColumn("edited", F.filter("placed", lambda b: b["replaced"]))
    return pages.select("doc_id", "page_num", F.explode(F.transform("placed", lambda b: judged(b, b["seq"]))).alias("b")).select(
        "doc_id", "page_num", "b.*")


def overflow_report(translated: DataFrame) -> DataFrame:
    """Blocks that carry ``translated``, with ``overflow``: a renderer would lose part of their text."""
    return translated.select(*BLOCK_KEY, overflows(F.col("translated"), F.col("size"), F.col("rect")).alias("overflow"))
