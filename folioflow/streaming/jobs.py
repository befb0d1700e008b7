"""Continuous intake, translation, progress and quotas.

Every job takes a streaming DataFrame and returns a started query. Offsets and state live
below ``folder``, which must be reachable by all executors. Without a trigger a job works
off what is there and stops; pass for instance ``processingTime="1 minute"`` to keep it going.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from folioflow.config import AdmissionRules, Quota
from folioflow.operators.admission import with_verdict
from folioflow.operators.quota import first_arrivals, period_of
from folioflow.operators.reports import page_progress
from folioflow.operators.shared import exists, file_system, materialise, scratch, spread
from folioflow.operators.translation import EMPTY, FAILED, BatchTranslator, ask, chunk_key, chunks_of, distinct_requests, resolve
from folioflow.sources.keyed import KeyedTable

MEMORY = T.StructType([
    T.StructField("chunk_key", T.StringType()),
    T.StructField("copies", T.LongType()),
    T.StructField("translated", T.StringType()),
    T.StructField("status", T.StringType()),
])

COUNTS = T.StructType([
    T.StructField("client", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("period", T.TimestampType()),
    T.StructField("n", T.LongType()),
    T.StructField("updated", T.TimestampType()),
])

# Of each unit the latest period whose counts were let go.
MARKS = T.StructType([T.StructField("unit", T.StringType()), T.StructField("period", T.TimestampType())])


def _utc_now() -> datetime:
    return datetime.now(UTC)


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start_intake(jobs: DataFrame, rules: AdmissionRules, folder: str, **trigger) -> StreamingQuery:
    """Each arriving job gets its verdict; the payload is not carried along."""
    judged = with_verdict(jobs, rules).select("job_id", "verdict")
    return _append(judged, folder, "parquet", trigger)


def start_progress(layout: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Progress events as JSON lines."""
    page = page_progress(layout).select("doc_id", F.lit("progress").alias("type"), "page", "total", "percent")
    return _append(page, folder, "json", trigger)


def _append(df: DataFrame, folder: str, fmt: str, trigger: dict) -> StreamingQuery:
    return (
        df.writeStream.format(fmt).outputMode("append")
        .option("checkpointLocation", f"{folder}/offsets").option("path", f"{folder}/out")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _batch_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with one folder per micro-batch, so that a repeated batch replaces its own rows."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _each_batch(stream: DataFrame, folder: str, work, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", f"{folder}/offsets")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def memory_of(spark: SparkSession, folder: str) -> KeyedTable:
    """The translation memory below ``folder``: an answer per chunk, and how often the chunk came up."""
    return KeyedTable(spark, f"{folder}/memory", MEMORY, "chunk_key", add=["copies"])


def start_translation(
    texts: DataFrame, translator: BatchTranslator, source_lang: str, target_lang: str, size: int, folder: str,
    model: str | None = None, max_tasks: int | None = None, **trigger,
) -> StreamingQuery:
    """Fill the translation memory ``folder/memory`` with whatever arriving texts need.

    Only chunks the memory does not hold are sent, those that failed before again. The memory is a
    keyed table: a batch reads the folders its own chunks belong to and adds what is new; chunks that
    are known only have their copies counted. A batch that is run again after its rows were written
    does nothing.
    """
    spark = texts.sparkSession
    memory = memory_of(spark, folder)
    key = chunk_key(F.col("text"), source_lang, target_lang, model)

    def work(batch: DataFrame, batch_id: int) -> None:
        if memory.holds(batch_id):
            return
        with scratch(spark):
            requests = materialise(distinct_requests(chunks_of(spread(batch), size, []), key), "requests")
            known = materialise(memory.lookup(requests.select("chunk_key")), "known")
            settled = known.where(~F.col("status").isin(FAILED, EMPTY)).select("chunk_key")
            some = not settled.isEmpty()
            new = requests.join(settled, "chunk_key", "left_anti") if some else requests
            again = requests.join(settled, "chunk_key", "left_semi").select(
                "chunk_key", "copies", *[F.lit(None).cast("string").alias(c) for c in ("translated", "status")])
            n = requests.count()
            # dealt before they are asked, answers go straight to their folders; few rows, or few tasks that may ask, are not
            straight = max_tasks is None and memory.digits_for(n) > 0
            if straight:
                new, again = memory.dealt(new, n), memory.dealt(again, n)
            rows = resolve(ask(new, translator, max_tasks)).select(MEMORY.names)
            memory.write(rows.unionByName(again) if some else rows, batch_id, n if straight else None)

    return _each_batch(texts, folder, work, trigger)


def read_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The newest answer per chunk, and its copies in all batches."""
    return memory_of(spark, folder).read()


def _previous(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Counts as the batch before left them; only that folder is read."""
    return spark.read.schema(COUNTS).parquet(f"{path}/batch_id={batch_id - 1}")


def _hand_over(counts: DataFrame, path: str, batch_id: int) -> None:
    """Write the counts of a batch, then let go of those that no repeated batch can need."""
    spark = counts.sparkSession
    counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    fs, old = file_system(spark, f"{path}/batch_id={batch_id - 2}")
    fs.delete(old, True)


def _merged(before: DataFrame, used: Sequence[DataFrame], now: datetime) -> DataFrame:
    """Counts with those of a batch added; ``updated`` is when a count last changed."""
    fresh = reduce(DataFrame.unionByName, used).withColumn("updated", F.lit(now).cast("timestamp"))
    keys = ["client", "unit", "period"]
    return before.unionByName(fresh).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("updated").alias("updated"))


def _retired(counts: DataFrame, now: datetime, keep_days: int) -> Column:
    """Counts that have not changed for ``keep_days`` by the clock, of periods that are over by the clock."""
    at = F.lit(now).cast("timestamp")
    return (F.col("updated") < at - F.expr(f"INTERVAL {keep_days} DAYS")) & (F.col("period") < at)


def start_quota(
    requests: DataFrame, quotas: Sequence[Quota], folder: str, keep_days: int = 2,
    clock: Callable[[], datetime] = _utc_now, **trigger,
) -> StreamingQuery:
    """Verdicts for arriving ``(event_id, client, ts)`` in ``folder/verdicts``.

    What earlier batches used up is a small table of counts per client and period. Within a
    batch arrivals are ranked as in the batch job; their ranks meet the counts, so a client
    that floods the service costs no more than others. Counts are let go ``keep_days`` after
    they last changed by ``clock``, never by what arrivals claim; of each unit the latest such
    period is remembered (``folder/marks``), and arrivals of that period or an earlier one that have no count any
    more are ``late``: refused, not given a fresh quota. A period in the future is kept until
    the clock has passed it.
    """
    counts_at, verdicts_at, marks_at = f"{folder}/counts", f"{folder}/verdicts", f"{folder}/marks"
    spark = requests.sparkSession
    if not exists(spark, counts_at):
        _write_batch(spark.createDataFrame([], COUNTS), counts_at, -1)
        _write_batch(spark.createDataFrame([], MARKS), marks_at, -1)

    def work(batch: DataFrame, batch_id: int) -> None:
        now = clock()
        with scratch(spark):
            rows = materialise(batch, "arrivals")
            before = _previous(spark, counts_at, batch_id)
            marks = spark.read.schema(MARKS).parquet(f"{marks_at}/batch_id={batch_id - 1}")
            newest = {r["unit"]: r["period"] for r in marks.collect()}  # one per unit
            flags = [f"within_{q.period}" for q in quotas]
            passing, used = [], []
            for q, flag in zip(quotas, flags):
                timed = rows.withColumn("period", period_of(F.col("ts"), q.period))
                prior = before.where(F.col("unit") == q.period).select(
                    F.col("client").alias("_client"), F.col("period").alias("_period"), "n")
                # arrivals without client are a client of their own, as in the batch job
                same = F.col("client").eqNullSafe(F.col("_client")) & F.col("period").eqNullSafe(F.col("_period"))
                if q.period in newest:
                    # counted again from nothing they would get a second quota
                    old = F.coalesce(F.col("period") <= F.lit(newest[q.period]).cast("timestamp"), F.lit(False))
                    gone = timed.where(old).join(prior, same, "left_anti")
                    passing.append(gone.select("event_id", *[F.lit(False).alias(f) for f in flags], F.lit(True).alias("late")))
                    timed = timed.where(~old).unionByName(timed.where(old).join(prior, same, "left_semi"))
                ok = first_arrivals(timed, q.limit).join(prior, same, "left").where(F.col("rank") + F.coalesce("n", F.lit(0)) <= q.limit)
                passing.append(ok.select("event_id", *[F.lit(f == flag).alias(f) for f in flags], F.lit(False).alias("late")))
                used.append(timed.groupBy("client", F.lit(q.period).alias("unit"), "period").agg(F.count(F.lit(1)).alias("n")))
            each = [*flags, "late"]
            merged = reduce(DataFrame.unionByName, passing).groupBy("event_id").agg(*[F.bool_or(f).alias(f) for f in each])
            verdicts = rows.join(merged, "event_id", "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in each})
            verdicts = verdicts.withColumn("allowed", reduce(lambda a, b: a & b, [F.col(f) for f in flags]) & ~F.col("late"))
            _write_batch(verdicts, verdicts_at, batch_id)
            after = materialise(_merged(before, used, now), "counts")
            gone = F.coalesce(_retired(after, now, keep_days), F.lit(False))
            _hand_over(after.where(gone).select("unit", "period").unionByName(marks).groupBy("unit").agg(F.max("period").alias("period")), marks_at, batch_id)
            _hand_over(after.where(~gone), counts_at, batch_id)

    return _each_batch(requests, folder, work, trigger)


def start_over_limit(
    requests: DataFrame, quota: Quota, folder: str, keep_days: int = 2,
    clock: Callable[[], datetime] = _utc_now, **trigger,
) -> StreamingQuery:
    """Periods in which a client went over its quota; read them with ``read_over_limit``.

    Every arrival counts, however late, and open periods are reported too. Counts that have
    not changed for ``keep_days`` by the clock are moved to ``folder/closed``; the reader adds
    what arrives for such a period afterwards.
    """
    counts_at, closed_at = f"{folder}/counts", f"{folder}/closed"
    spark = requests.sparkSession
    if not exists(spark, counts_at):
        _write_batch(spark.createDataFrame([], COUNTS), counts_at, -1)
        _write_batch(spark.createDataFrame([], COUNTS), closed_at, -1)

    def work(batch: DataFrame, batch_id: int) -> None:
        now = clock()
        with scratch(spark):
            before = _previous(spark, counts_at, batch_id)
            period = period_of(F.col("ts"), quota.period).alias("period")
            used = batch.groupBy("client", F.lit(quota.period).alias("unit"), period).agg(F.count(F.lit(1)).alias("n"))
            after = materialise(_merged(before, [used], now), "counts")
            gone = F.coalesce(_retired(after, now, keep_days), F.lit(False))
            _write_batch(after.where(gone), closed_at, batch_id)
            _hand_over(after.where(~gone), counts_at, batch_id)

    return _each_batch(requests, folder, work, trigger)


def read_over_limit(spark: SparkSession, folder: str, quota: Quota) -> DataFrame:
    """``client, period, n`` of all periods over the quota, open ones included."""
    live = _batch_table(spark, f"{folder}/counts", COUNTS)
    newest = live.join(F.broadcast(live.agg(F.max("batch_id").alias("batch_id"))), "batch_id")
    rows = newest.drop("batch_id").unionByName(_batch_table(spark, f"{folder}/closed", COUNTS).drop("batch_id"))
    return rows.groupBy("client", "period").agg(F.sum("n").alias("n")).where(F.col("n") > quota.limit)


class BatchProgress(StreamingQueryListener):
    """Calls ``callback(batch_id, input_rows)`` on the driver after every micro-batch."""

    def __init__(self, callback: Callable[[int, int], None]) -> None:
        self.callback = callback

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.callback(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
