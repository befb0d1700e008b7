"""Intake rules: each job gets exactly one verdict, ``admitted`` or the first rule it breaks.

All rules are expressions over one row, so a verdict never shuffles and the same function
serves batch and streaming input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.config import MAX_OUTPUT_BYTES, AdmissionRules, ServerDefaults
from folioflow.functions.text import first_filled
from folioflow.functions.urls import screen_url

ADMITTED = "admitted"
LANGUAGE = "language"

# Order of the rules; the first one that applies names the verdict.
REASONS = (
    "language", "credentials", "url", "declared_length", "empty", "magic", "size", "unreadable", "pages",
)


def over_declared(declared: Column, limit: int) -> Column:
    """Too long by its own header; a header that is not all digits says nothing."""
    digits = F.regexp_extract(declared, "^0*([0-9]+)$", 1)
    # more digits than a BIGINT holds is too long as well
    return F.when(digits == "", False).otherwise(
        (F.length(digits) > 18) | (digits.try_cast("bigint") > limit)
    )


def with_verdict(jobs: DataFrame, rules: AdmissionRules) -> DataFrame:
    """Adds ``verdict`` to jobs ``(source_lang, target_lang, content, declared, n_pages[, has_key, base_url])``.

    ``content`` may be text or binary; ``n_pages`` is null where the content could not be read.
    """
    known = list(rules.languages)
    language_ok = F.col("source_lang").isin(known) & F.col("target_lang").isin(known)
    size = F.octet_length("content")
    tests = {
        "language": ~F.coalesce(language_ok, F.lit(False)),
        "declared_length": over_declared(F.col("declared"), rules.max_declared),
        "empty": F.col("content").isNull() | (size == 0),
        "magic": ~F.startswith(F.col("content").cast("binary"), F.lit(rules.magic)),
        "size": size > rules.max_bytes,
        "unreadable": F.col("n_pages").isNull(),
        "pages": F.col("n_pages") > rules.max_pages,
    }
    if "has_key" in jobs.columns:
        own = F.coalesce("has_key", F.lit(False))
        named = first_filled(F.col("base_url"))  # a caller who names no endpoint gets the default
        tests["credentials"] = ~own & F.lit(rules.hosted and not rules.server_has_key)
        tests["url"] = own & F.lit(rules.hosted) & named.isNotNull() & screen_url(named).isNotNull()
    picks = [F.when(tests[r], F.lit(r)) for r in REASONS if r in tests]
    return jobs.withColumn("verdict", F.coalesce(*picks, F.lit(ADMITTED)))


def precheck_uploads(uploads: DataFrame, rules: AdmissionRules, mime: str = "application/pdf", suffix: str = ".pdf") -> DataFrame:
    """Adds ``verdict`` to a listing ``(name, mime, length, n_pages)``, before any payload is sent.

    Either the declared type or the name has to fit.
    """
    fits = F.coalesce(F.col("mime") == mime, F.lit(False)) | F.coalesce(F.lower("name").endswith(suffix), F.lit(False))
    return uploads.withColumn(
        "verdict",
        F.when(~fits, "type").when(F.col("length") > rules.max_bytes, "size")
        .when(F.col("n_pages").isNull(), "unreadable").when(F.col("n_pages") > rules.max_pages, "pages")
        .otherwise(ADMITTED),
    )


def verdict_report(judged: DataFrame, column: str = "verdict") -> DataFrame:
    return judged.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def language_allowed(column: Column, known: Sequence[str]) -> Column:
    """A literal list, so that the test reaches the file scan."""
    return column.isin(*known)


def label_languages(df: DataFrame, code: str, names: dict[str, str]) -> DataFrame:
    """Adds ``language``, the name behind a code; null for codes that are not known."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return df.withColumn("language", F.try_element_at(F.create_map(*pairs), F.col(code)))


def capped_output(df: DataFrame, output: str, limit: int = MAX_OUTPUT_BYTES) -> DataFrame:
    """Result size and whether it may be returned; an oversized result becomes an error, not a row less."""
    size = F.octet_length(output)
    return df.withColumn("out_bytes", size.cast("bigint")).withColumn(
        "status", F.when(size > limit, "too_large").otherwise("done")
    )


def route_jobs(jobs: DataFrame, defaults: ServerDefaults) -> DataFrame:
    """Effective endpoint and model of jobs ``(has_key, base_url, model)``.

    A caller with a key may choose both; otherwise the server's own settings apply. Only
    the presence of a key is known here, never the key.
    """
    own = F.coalesce("has_key", F.lit(False))
    server = defaults.server if defaults.server_has_key else defaults.local
    stuck = ~own & F.lit(defaults.hosted and not defaults.server_has_key)
    return (
        jobs.withColumn("route", F.when(own, "caller").when(stuck, "rejected")
                        .otherwise("server" if defaults.server_has_key else "local"))
        .withColumn("eff_base_url", F.when(own, first_filled(F.col("base_url"), F.lit(defaults.caller.base_url)))
                    .when(~stuck, F.lit(server.base_url)))
        .withColumn("eff_model", F.when(own, first_filled(F.col("model"), F.lit(defaults.caller.model)))
                    .when(~stuck, F.lit(server.model)))
    )
