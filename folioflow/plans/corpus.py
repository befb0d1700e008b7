"""The whole job: layout trees in, translated pages, documents or edit plans out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.config import ROUTE, TranslationConfig
from folioflow.operators import assembly, edits
from folioflow.operators import layout as lay
from folioflow.operators.shared import materialise
from folioflow.operators.translation import BatchTranslator, ColumnTranslator, chunk_key, chunks_of, translate_once, with_answers


def translate_pages(
    layout: DataFrame,
    config: TranslationConfig,
    *,
    column: ColumnTranslator | None = None,
    batch: BatchTranslator | None = None,
    **service,
) -> DataFrame:
    """One row per page: ``doc_id, page_num, status, translated, n_blocks, n_chunks, n_failed``.

    Give either a ``column`` translator, which stays within each page's row, or a ``batch``
    translator, which is called once per distinct chunk of the corpus; ``service`` are the
    settings of ``translation.answered``. For the latter the layout is read once: its text is
    cut and written before anything else looks at it. A document without pages, or one that could
    not be read, has one row without page number; ``status`` says which.
    """
    if (column is None) == (batch is None):
        raise ValueError("give either a column or a batch translator")
    if column is not None:
        return assembly.translated_pages(layout, config, column).drop("n_pages")
    pieces = assembly.page_pieces(layout, config)
    key = chunk_key(F.col("text"), config.source_lang, config.target_lang, config.model)
    cut = materialise(pieces.withColumn("chunk_key", F.when(F.col("sent"), key)).drop("sent"), "chunks")
    sent = cut.where("chunk_key IS NOT NULL")
    done = with_answers(sent.drop("n_pages"), batch, **service)
    place = ["doc_id", "page_num", "block_no", "chunk_no"]
    kept = cut.where("chunk_key IS NULL").select(*place, F.col("text").alias("translated"), lay.page_status().alias("page_status"))
    return assembly.pages_of(done.select(*place, "translated", "status").unionByName(kept, allowMissingColumns=True))


def folded(layout: DataFrame) -> DataFrame:
    """Pages with their blocks folded, written: a decoder runs once, however many branches follow."""
    return materialise(lay.page_blocks(layout), "folded")


def translate_blocks(blocks: DataFrame, config: TranslationConfig, batch: BatchTranslator, **service) -> DataFrame:
    """Blocks routed to translation, as ``(…block key, translated, n_chunks, n_failed)``."""
    chosen = blocks.where(F.col("route") == ROUTE.translate)
    pieces = chunks_of(chosen, config.max_chunk_size, lay.BLOCK_KEY)
    done = translate_once(pieces, batch, config.source_lang, config.target_lang, config.model, **service)
    return assembly.rejoin(done, lay.BLOCK_KEY)


def translate_documents(layout: DataFrame, config: TranslationConfig, **translator) -> DataFrame:
    """Translated pages put together to one row per document."""
    return assembly.documents_of(translate_pages(layout, config, **translator))


def translate_edits(
    layout: DataFrame,
    config: TranslationConfig,
    fonts: Sequence[str],
    *,
    column: ColumnTranslator | None = None,
    batch: BatchTranslator | None = None,
    **service,
) -> DataFrame:
    """The edit plan of all pages, by either kind of translator; decoding happens once."""
    if (column is None) == (batch is None):
        raise ValueError("give either a column or a batch translator")
    if column is not None:
        return edits.edit_plan(edits.translated_blocks(lay.text_blocks(layout), config, column), config, fonts)
    blocks = lay.routed_blocks(lay.blocks_of(folded(layout)), config.skip_pages)
    done = translate_blocks(blocks, config, batch, **service)
    return edits.edit_plan(edits.with_translations(blocks.drop("route"), done), config, fonts)
