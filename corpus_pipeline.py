"""Documents through the stages of a training corpus, each written and read again.

Language ID drops documents without letters and those whose letters fit no language that was learnt, near duplicates leave one document
of each group, decontamination drops documents that hold benchmark items, personal data is
masked in the texts, and what remains is packed into sequences. The first four stages return the
columns of ``documents``.

Defined results beyond those of the operators: rows without id pass all stages that do not reject
their text; rows that repeat id and text leave the second stage once, rows of one id with different
texts are judged as different documents; ``n_chars`` follows the masked
text; extra columns are carried along, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontam, langid, neardup, packing, pii
from folioflow.llm.common import table
from folioflow.llm.merkle import ranked
from folioflow.operators.shared import materialise

MOST_BROADCAST = 4_000_000  # ids of dropped documents that go to all executors; with more of them texts are joined

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; profiles are learnt from all documents that state theirs."""
    return langid.recognised(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by five-word shingles at 0.8."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    if ids.count() == ids.distinct().count():
        judged = neardup.near_duplicates(docs, width=5)
        return _without(docs, materialise(judged.where(~F.col("kept")).select("doc_id"), "dropped"), "doc_id")
    # rows of one id with different texts are documents of their own: each gets its place in a fixed order as its id
    key = ["doc_id", F.xxhash64("text").alias("_text")]
    texts = docs.where("doc_id IS NOT NULL").select(*key).distinct().withColumn("_all", F.lit(0))
    places = materialise(ranked(texts, "_all", ["doc_id", "_text"]).select("doc_id", "_text", F.col("rank").alias("_number")), "places")
    # of rows that repeat id and text the one whose other columns hash lowest
    row = F.struct("*").alias("_row")
    once = docs.where("doc_id IS NOT NULL").select(*key, row).groupBy("doc_id", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    placed = materialise(once.join(places, ["doc_id", "_text"]).select("_number", "_row"), "placed")
    judged = neardup.near_duplicates(placed.select(F.col("_number").alias("doc_id"), "_row.text"), width=5)
    kept = materialise(judged.where("doc_id IS NOT NULL AND kept").select(F.col("doc_id").alias("_number")), "kept")
    rows = placed.join(kept, "_number", "left_semi").select("_row.*")
    return rows.unionByName(docs.where("doc_id IS NULL"))


def _without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``dropped``, a written table: texts stay where they are, its keys travel."""
    keys = F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped
    return docs.join(keys, key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    # the row itself is the key: rows without id, or with a repeated one, are judged by their text
    key = F.xxhash64("doc_id", "text")
    found = decontam.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = materialise(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return _without(docs.withColumn("_key", key), bad, "_key").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    spans = pii.spans_of(docs.select(F.struct("*").alias("_row"), "text"), "_row")
    masked = spans.select("_row", pii.redacted(F.col("_row.text"), pii.accepted(pii.fit(spans))).alias("_text"))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return masked.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(materialise(packing.token_pieces(docs, TOKENIZER), "pieces"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

# Learnt profiles, MinHash and tokens are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
