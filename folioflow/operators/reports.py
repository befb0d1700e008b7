"""Progress rows and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioflow.config import FAILED_MESSAGE, MAX_OUTPUT_BYTES, STATUS, TOO_LARGE_MESSAGE
from folioflow.functions.text import download_name, let, megabytes, percent, reduction
from folioflow.operators.translation import EMPTY, FAILED


def page_progress(layout: DataFrame) -> DataFrame:
    """One row per page, as announced when work on the page starts; skipped pages count too.

    The number of pages travels with each page, so nothing has to be counted or ranked.
    """
    page = F.col("page_num") + 1
    return layout.where("page_num IS NOT NULL").select(
        "doc_id", page.alias("page"), F.col("n_pages").alias("total"), percent(page, F.col("n_pages")).alias("percent")
    )


def progress_event() -> Column:
    """JSON line of a progress row."""
    return F.to_json(F.struct(F.lit("progress").alias("type"), "page", "total", "percent"))


def done_event(filename: Column, payload: Column) -> Column:
    """JSON line that hands over the result as base64 text, without the line breaks of MIME."""
    encoded = F.replace(F.base64(payload), F.lit("\r\n"), F.lit(""))
    return F.to_json(F.struct(
        F.lit("done").alias("type"), download_name(filename).alias("filename"), encoded.alias("pdf_b64")
    ))


def error_event(message: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("type"), message.alias("message")))


def final_event(filename: Column, max_output_bytes: int) -> Column:
    """The one event that ends a job with ``status`` and ``translated``."""
    payload = F.encode("translated", "utf-8")
    return (
        F.when(F.col("status") != STATUS.translated, error_event(F.lit(FAILED_MESSAGE)))
        .when(F.octet_length(payload) > max_output_bytes, error_event(F.lit(TOO_LARGE_MESSAGE)))
        .otherwise(done_event(filename, payload))
    )


def job_events(
    layout: DataFrame, documents: DataFrame, name: Column, max_output_bytes: int = MAX_OUTPUT_BYTES
) -> DataFrame:
    """``doc_id, seq, event``: JSON lines of every job, in order of ``seq``.

    A line of progress as each page starts, then exactly one ``done`` with the result, or one
    ``error``: for a job that could not be read, or whose result is larger than
    ``max_output_bytes``. ``documents`` are translated ones with their ``status``; ``name`` is
    the upload's name, an expression over them.
    """
    progress = page_progress(layout).select("doc_id", F.col("page").alias("seq"), progress_event().alias("event"))
    last = documents.select("doc_id", (F.col("n_pages") + 1).alias("seq"), final_event(name, max_output_bytes).alias("event"))
    return progress.unionByName(last)


def size_report(df: DataFrame, before: str, after: str, by: Sequence[str]) -> DataFrame:
    """Totals before and after, megabytes and reduction in percent, per group."""
    totals = df.groupBy(*by).agg(
        F.sum(F.octet_length(before).cast("bigint")).alias("in_bytes"),
        F.sum(F.octet_length(after).cast("bigint")).alias("out_bytes"),
    )
    return with_sizes(totals)


def with_sizes(totals: DataFrame) -> DataFrame:
    """Derived figures for ``(in_bytes, out_bytes)``."""
    was, now = F.col("in_bytes"), F.col("out_bytes")
    return totals.withColumns({
        "in_mb": megabytes(was),
        "out_mb": megabytes(now),
        "saved_mb": megabytes(was) - megabytes(now),
        "reduction_pct": reduction(was, now),
    })


# What a translation has to leave as it is.
KEPT_KINDS = {
    "number": "[0-9]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "url": r"https?://[^ \n<>]+",
    "placeholder": r"\[[A-Z_]+\]",
    "phone": r"\+[0-9][0-9 ().-]{5,}[0-9]",
    "path": r"(?:/[A-Za-z0-9._-]+){2,}/?|[A-Za-z]:(?:\\[A-Za-z0-9._-]+)+",
}


def preservation_audit(df: DataFrame, before: str, after: str, by: Sequence[str]) -> DataFrame:
    """Per group and kind: pieces of the source that must survive, and how many did not.

    Copies count: pieces are counted per row on both sides, one after the other, and rows then meet in
    sums only. A text of very many pieces costs as much as the pieces it has. Grouping columns may have
    any name.
    """
    def pieces(kind: str, pattern: str) -> Column:
        found = lambda c, sign: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.struct(
            F.lit(kind).alias("kind"), x.alias("piece"), F.lit(sign).alias("sign")))
        # a row without pieces of a kind is a row all the same
        none = F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("piece"), F.lit(0).alias("sign")))
        return F.concat(none, F.coalesce(found(before, 1), none), F.coalesce(found(after, -1), none))

    group = F.struct(*[F.col(c) for c in by]).alias("_by")
    # numbered first: beside a generator the number would be that of the piece
    rows = df.select(group, F.concat(*[pieces(k, p) for k, p in KEPT_KINDS.items()]).alias("_xs"), F.monotonically_increasing_id().alias("_row"))
    each = rows.select("_by", "_row", F.explode("_xs").alias("_x"))
    counted = each.groupBy("_by", "_row", F.col("_x.kind").alias("_kind"), F.col("_x.piece").alias("_piece")).agg(
        F.count_if(F.col("_x.sign") == 1).alias("_n"), F.sum("_x.sign").alias("_more"))
    rows = counted.groupBy("_by", "_row", "_kind").agg(F.sum("_n").alias("_n"), F.sum(F.greatest("_more", F.lit(0))).alias("_lost"))
    return rows.groupBy("_by", "_kind").agg(
        F.sum("_n").alias("n_pieces"), F.sum("_lost").alias("n_lost"), F.count_if(F.col("_lost") > 0).alias("n_rows_with_loss"),
    ).select("_by.*", F.col("_kind").alias("kind"), "n_pieces", "n_lost", "n_rows_with_loss")


def outcome_rollup(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Chunks by ``by`` and ``status`` and by every beginning of that list, with ``level``: the columns summed up, as bits.

    One pass over the chunks; what meets are sums of the finest level.
    """
    columns = [*by, "status"]
    finest = chunks.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return finest.rollup(*columns).agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"))


def outcome_report(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many chunks ended in which status."""
    return chunks.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def outcome_causes(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many chunks ended in which status for which reason: the kind of the service's error."""
    cause = F.nullif(F.regexp_extract("error", "^([A-Za-z_.]+)", 1), F.lit(""))
    return chunks.groupBy(*by, "status", cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def observed(chunks: DataFrame, observation: Observation) -> DataFrame:
    """Count chunks and failures while another action runs; read them from the observation.

    Counted is what the action runs over, once per task that succeeds.
    """
    return chunks.observe(
        observation,
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_if(F.col("status").isin(FAILED, EMPTY)).alias("n_failed"),
    )
