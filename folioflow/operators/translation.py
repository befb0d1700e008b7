"""Translate chunks, with the source text standing in for every answer that failed.

Two kinds of translator are supported:

* a *column translator* (``Column -> Column``, null or blank on failure) is applied in
  place and needs no shuffle at all;
* a *batch translator* (``list[str] -> list[str | None | Exception]``) stands for a slow,
  possibly unrepeatable service. Each distinct chunk is sent once, the answers are written
  down before anything reads them, and then joined back to all chunks that share the text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.functions.chunking import chunk_text
from folioflow.functions.text import let, strip
from folioflow.operators.shared import attach, exists, materialise, run_folder
from folioflow.schemas import ANSWERED, ANSWERS

ColumnTranslator = Callable[[Column], Column]
BatchTranslator = Callable[[list[str]], Sequence["str | None | Exception"]]

TRANSLATED = "translated"
FAILED = "failed"
EMPTY = "empty"
BLANK = "blank"


def outcome(text: Column, answer: Column) -> Column:
    """``STRUCT<text, status>``: the stripped answer, or the source text and why.

    ``failed`` is a missing answer and ``empty`` a blank one; a blank chunk is never sent.
    """

    def judge(both: Column) -> Column:
        source, got = both["source"], both["answer"]
        status = (
            F.when(strip(source) == "", BLANK).when(got.isNull(), FAILED).when(got == "", EMPTY).otherwise(TRANSLATED)
        )
        kept = F.when(status == TRANSLATED, got).otherwise(source)
        return F.struct(kept.alias("text"), status.alias("status"))

    return let(F.struct(text.alias("source"), strip(answer).alias("answer")), judge)


def translate_inline(text: Column, translator: ColumnTranslator, size: int) -> Column:
    """``STRUCT<text, n_chunks, n_failed>`` for a whole text: cut, translate, join with a space."""

    def rejoin(done: Column) -> Column:
        bad = F.filter(done, lambda c: c["status"].isin(FAILED, EMPTY))
        return F.struct(
            F.array_join(F.transform(done, lambda c: c["text"]), " ").alias("text"),
            F.size(done).alias("n_chunks"),
            F.size(bad).alias("n_failed"),
        )

    untouched = F.struct(text.alias("text"), F.lit(0).alias("n_chunks"), F.lit(0).alias("n_failed"))
    worked = let(F.transform(chunk_text(text, size), lambda c: outcome(c, translator(c))), rejoin)
    return F.when(strip(text) == "", untouched).otherwise(worked)


def chunks_of(texts: DataFrame, size: int, keep: Sequence[str]) -> DataFrame:
    """One row per chunk of ``texts.text``. ``over_limit`` marks a single word longer than ``size``."""
    pieces = texts.select(*keep, F.posexplode(chunk_text(F.col("text"), size)).alias("chunk_no", "text"))
    return pieces.withColumn("over_limit", F.length("text") > size)


def chunk_key(text: Column, source_lang: str, target_lang: str, model: str | None) -> Column:
    """Identity of one piece of work: same text, languages and model give the same key."""
    job = "\x1f".join((source_lang, target_lang, model or ""))
    return F.sha2(F.concat(F.lit(job + "\x1f"), text), 256)


def distinct_requests(chunks: DataFrame, key: Column) -> DataFrame:
    """Each text once, with the number of its copies; counted before the shuffle."""
    return chunks.groupBy(key.alias("chunk_key"), "text").agg(F.count(F.lit(1)).alias("copies"))


def missing_requests(requests: DataFrame, memory: DataFrame) -> DataFrame:
    """Requests the memory has no answer for.

    The memory may be far larger than the requests, so its keys are first reduced to those
    asked for; the optimiser can do that without shuffling the memory while requests are few.
    """
    known = memory.select("chunk_key").join(requests.select("chunk_key"), "chunk_key", "left_semi")
    return requests.join(known, "chunk_key", "left_anti")


def ask(
    requests: DataFrame, translator: BatchTranslator, max_tasks: int | None = None, per_call: int = 100
) -> DataFrame:
    """Run a batch translator over ``(chunk_key, text, copies)``; blank texts are not sent.

    A call gets at most ``per_call`` texts. If it raises, or gives the wrong number of
    answers, only its own texts fail. ``max_tasks`` limits how many tasks call the service
    at the same time. The result is lazy and would call again on every use: write it down
    before reading it (``answered``).
    """

    def call(texts: list[str]) -> list:
        try:
            replies = list(translator(texts))
            if len(replies) == len(texts):
                return replies
            failure: Exception = ValueError(f"{len(replies)} answers for {len(texts)} texts")
        except Exception as raised:
            failure = raised
        return [failure] * len(texts)

    out = to_arrow_schema(ANSWERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got: list = [None] * len(texts)
            sent = [i for i, t in enumerate(texts) if t is None or t.strip() != ""]
            for at in range(0, len(sent), per_call):
                part = sent[at:at + per_call]
                for i, reply in zip(part, call([texts[i] for i in part])):
                    got[i] = reply
            answers = pa.array([g if isinstance(g, str) else None for g in got], pa.string())
            errors = pa.array([repr(g) if isinstance(g, Exception) else None for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, answers, errors], schema=out)

    if max_tasks:
        requests = requests.repartition(max_tasks, "chunk_key")
    return requests.select("chunk_key", "text", "copies").mapInArrow(run, ANSWERS)


def usable_answers(memory: DataFrame) -> DataFrame:
    """``chunk_key, translated, status``: one finished answer per key, the smallest of several."""
    done = memory.where(F.col("status") == TRANSLATED)
    return done.groupBy("chunk_key").agg(F.min("translated").alias("translated"), F.first("status").alias("status"))


def answered(
    requests: DataFrame,
    translator: BatchTranslator,
    max_tasks: int | None = None,
    memory: DataFrame | None = None,
    answers_at: str | None = None,
    per_commit: int = 100_000,
) -> DataFrame:
    """A written table ``(chunk_key, copies, translated, status, error)``, one row per distinct text.

    Only what has no answer yet is sent: neither in ``memory(chunk_key, translated, status)`` nor
    in ``answers_at``, a folder where answers are kept. For that folder requests go out in hash
    buckets of about ``per_commit`` texts, each written as soon as it is complete, so a job that
    breaks off loses at most one bucket: run again with the same folder, it sends only what is
    missing. Without it nothing could be taken up again, and all requests go out at once; without
    ``memory`` either, they go out as they are made and are not written before.
    ``max_tasks`` limits how many tasks call the service at the same time.
    """
    spark = requests.sparkSession
    if memory is None and answers_at is None:
        # read once: nothing is looked up or counted
        return materialise(resolve(ask(requests, translator, max_tasks)), "answers")
    requests = materialise(requests, "requests")
    known = None if memory is None else memory.select("chunk_key", "translated", "status")
    if answers_at is not None and exists(spark, answers_at):
        kept = spark.read.schema(ANSWERED).option("recursiveFileLookup", "true").parquet(answers_at)
        kept = kept.select("chunk_key", "translated", "status")
        known = kept if known is None else known.unionByName(kept)
    usable = None if known is None else usable_answers(known)
    missing = requests if usable is None else materialise(missing_requests(requests, usable), "missing")
    buckets = max(1, -(-missing.count() // per_commit)) if answers_at else 1
    run = f"{answers_at}/run-{uuid.uuid4().hex}" if answers_at else run_folder(spark, "answers")
    for bucket, part in enumerate(_bucketed(missing, buckets)):
        resolve(ask(part, translator, max_tasks)).write.parquet(f"{run}/bucket-{bucket}")
    sent = spark.read.schema(ANSWERED).option("recursiveFileLookup", "true").parquet(run)
    if usable is None:
        return sent
    found = requests.select("chunk_key", "copies").join(usable, "chunk_key").withColumn("error", F.lit(None).cast("string"))
    return materialise(sent.unionByName(found), "answers")


def _bucketed(requests: DataFrame, buckets: int) -> Iterator[DataFrame]:
    """Requests in hash buckets: dealt to folders once, each of which is then read alone.

    Buckets go one after the other, so each is written as several files per core: no core waits for another's.
    """
    if buckets == 1:
        yield requests
        return
    spark = requests.sparkSession
    folder = run_folder(spark, "buckets")
    slots = 4 * spark.sparkContext.defaultParallelism
    number = F.pmod(F.xxhash64("chunk_key"), F.lit(buckets)).cast("int")
    # of another hash than the bucket, or a bucket would have few of the slots
    slot = F.pmod(F.hash("chunk_key"), F.lit(slots))
    dealt = requests.withColumn("bucket", number).repartition(max(slots, buckets), "bucket", slot)
    dealt.write.partitionBy("bucket").parquet(folder)
    for bucket in range(buckets):
        at = f"{folder}/bucket={bucket}"
        if exists(spark, at):
            yield spark.read.schema(requests.schema).parquet(at)


def resolve(answers: DataFrame) -> DataFrame:
    done = answers.withColumn("done", outcome(F.col("text"), F.col("answer")))
    return done.select(
        "chunk_key", "copies", F.col("done.text").alias("translated"), F.col("done.status").alias("status"), "error"
    )


def translate_once(
    chunks: DataFrame,
    translator: BatchTranslator,
    source_lang: str,
    target_lang: str,
    model: str | None = None,
    **service,
) -> DataFrame:
    """All chunks with ``translated``, ``status`` and ``error``; every distinct text is sent once.
    ``service`` are the settings of ``answered``.

    Chunks are cut once and written with their key. The texts then cross the network once,
    for the distinct; the way back reads only ordinals and keys of the written chunks and
    meets the finished texts.
    """
    key = chunk_key(F.col("text"), source_lang, target_lang, model)
    cut = materialise(chunks.withColumn("chunk_key", key), "chunks")
    return with_answers(cut, translator, **service)


def with_answers(cut: DataFrame, translator: BatchTranslator, **service) -> DataFrame:
    """The second half of ``translate_once``, for chunks that are written with their ``chunk_key``."""
    answers = answered(distinct_requests(cut, F.col("chunk_key")), translator, **service)
    keyed = cut.drop("text", "over_limit")
    return attach(keyed, answers, "chunk_key", "copies").drop("chunk_key")


def with_fallback(chunks: DataFrame, responses: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join given responses ``(…on, answer)`` to chunks; the source stays where none is usable.

    ``on`` identifies a single chunk, so no key is heavy.
    """
    joined = chunks.join(responses, list(on), "left")
    return joined.withColumn("done", outcome(F.col("text"), F.col("answer"))).select(
        *[c for c in chunks.columns if c not in ("text", "over_limit")],
        F.col("done.text").alias("translated"), F.col("done.status").alias("status"),
    )
