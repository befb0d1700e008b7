"""Queries of this subpackage: each operator on its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontam, katz, langid, licenses, merkle, neardup, packing, periods, pii, quality, rules, urlrules, warc
from folioflow.llm.common import fold, table
from folioflow.operators.shared import materialise, run_folder

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Write every page as a capture, read the archives back and assemble the transactions."""
    folder = run_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.captures_report(warc.assemble(warc.read_archives(spark, folder, with_content=False))).drop("target_uri")


ORACLE["op6_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < original THEN original END AS refers_to
FROM r
"""


@query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Count rules and log-likelihood ratio against documents labelled as good."""
    documents = table(spark, sf, "documents")
    trusted = table(spark, sf, "labels").where("quality = 1")
    return rules.judge(rules.measures(documents, rules.fit(documents, trusted)))


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(materialise(pieces, "pieces"))


@query
def op4_langid(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from three of four folds."""
    documents = table(spark, sf, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    return langid.identify(documents, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they hold."""
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op10_pu_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learnt from positives of four of five folds."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = fold(F.col("doc_id"), 5) == 0
    done = quality.classify(table(spark, sf, "documents"), labels, ~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: base spans, and proposals that the classifier accepts."""
    spans = materialise(pii.spans_of(table(spark, sf, "documents"), "doc_id"), "spans")
    return pii.report(spans, pii.fit(spans))


@query
def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all documents by four-word shingles."""
    return neardup.near_duplicates(table(spark, sf, "documents"), width=4)


@query
def op8_katz(spark: SparkSession, sf: str) -> DataFrame:
    """Log probability of every document under a model of six of seven folds."""
    held_out = fold(F.col("doc_id"), 7) == 2
    done = katz.score(table(spark, sf, "documents"), ~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.matches(table(spark, sf, "documents"))


ORACLE["op5_licenses"] = licenses.oracle()


@query
def op12_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts over the URLs of all pages: site rules, then patterns."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    return urlrules.report(urlrules.judged(pages, urlrules.rule_table(spark)))


ORACLE["op12_url_rules"] = urlrules.oracle()


@query
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    """Merkle proofs of all documents; one in five is presented with its text in lower case."""
    return merkle.manifest(table(spark, sf, "documents"), fold(F.col("doc_id"), 5) == 0)


ORACLE["op11_merkle"] = merkle.oracle()


@query
def op13_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which loop."""
    return periods.runs_of(table(spark, sf, "documents"), periods.looped)
