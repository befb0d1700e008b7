"""The service as one stream: uploads in, verdicts, translated documents and events out.

Pages of a document may arrive in any order and over many batches, more than once, or not at all. A
document ends exactly once: as ``translated`` with the batch that brings its last page, at once if it
is ``unreadable`` or has ``no_pages``, or as ``incomplete`` when it has waited too long. What comes
for a document that has ended is written to ``folder/late`` and changes nothing.

Below ``folder``, each with one folder per batch: ``verdicts``, ``documents``, ``events``, ``late``, and
``open``, the translated pages of documents that have not ended (only the last two batches are kept).
``ended`` is a keyed table of the ids of all documents that have, read by key. It is written last: a
batch that is found there is complete, any other one is done again and replaces what it had written.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folioflow.config import MAX_OUTPUT_BYTES, NOT_HTTPS_MESSAGE, REFUSED_MESSAGES, STATUS, AdmissionRules
from folioflow.functions.text import first_filled
from folioflow.functions.urls import screen_url
from folioflow.operators.admission import ADMITTED, with_verdict
from folioflow.operators.assembly import documents_of
from folioflow.operators.reports import error_event, final_event, page_progress, progress_event
from folioflow.operators.shared import delete, materialise, no_rows, scratch
from folioflow.schemas import RAW_FILE
from folioflow.sources.keyed import KeyedTable
from folioflow.sources.readers import Decoder, decode_layout
from folioflow.streaming.jobs import _append, _each_batch, _utc_now, _write_batch

Translate = Callable[[DataFrame], DataFrame]

OPEN = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("n_pages", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("translated", T.StringType()),
    T.StructField("n_blocks", T.IntegerType()),
    T.StructField("n_chunks", T.IntegerType()),
    T.StructField("n_failed", T.IntegerType()),
    T.StructField("since", T.TimestampType()),
])
LATE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("page_num", T.IntegerType())])
ENDED = T.StructType([T.StructField("doc", T.StringType())])


def ended_table(spark: SparkSession, folder: str) -> KeyedTable:
    """Ids alone: a folder of 16,000 holds no more bytes than one of 1,000 answers."""
    return KeyedTable(spark, f"{folder}/ended", ENDED, "doc", rows_per_folder=16_000)


def _once(pages: DataFrame) -> DataFrame:
    """Each page once. Trees are only shuffled if some page did come twice; of different ones the same is taken every time."""
    key = ["doc_id", "page_num"]
    if pages.groupBy(*key).count().where("count > 1").isEmpty():
        return pages
    rest = [c for c in pages.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("page")
    return pages.groupBy(*key).agg(first).select(*key, "page.*").select(*pages.columns)


def _settle(
    layout: DataFrame, batch_id: int, translate: Translate, name: Column, folder: str, wait: timedelta, now: datetime, max_output_bytes: int,
    refused: DataFrame | None = None,
) -> None:
    """One batch of pages, a written table: translate what is new, end what is complete or overdue, keep the rest.

    ``refused(doc_id, event)`` are uploads that ended before they had any page.
    """
    spark = layout.sparkSession
    ended = ended_table(spark, folder)
    text_id = F.col("doc_id").cast("string").alias("doc")
    before = spark.read.schema(OPEN).parquet(f"{folder}/open/batch_id={batch_id - 1}") if batch_id else no_rows(spark, OPEN)
    known = materialise(ended.lookup(layout.select(text_id).distinct()), "known").select(F.col("doc").cast("bigint").alias("doc_id"))
    held = before.select("doc_id", F.coalesce("page_num", F.lit(-1)).alias("page"))
    paged = layout.withColumn("page", F.coalesce("page_num", F.lit(-1)))
    late = paged.join(known, "doc_id", "left_semi").unionByName(paged.join(held, ["doc_id", "page"], "left_semi")).unionByName(paged.where("doc_id IS NULL"))
    _write_batch(late.select("doc_id", "page_num"), f"{folder}/late", batch_id)
    if spark.read.schema(LATE).parquet(f"{folder}/late/batch_id={batch_id}").isEmpty():
        # all pages are new: they are not written again
        fresh = _once(layout)
        fresh = fresh if fresh is layout else materialise(fresh, "fresh")
    else:
        fresh = paged.where("doc_id IS NOT NULL").join(known, "doc_id", "left_anti").join(held, ["doc_id", "page"], "left_anti")
        fresh = materialise(_once(fresh.drop("page").select(layout.columns)), "fresh")
    shown = materialise(page_progress(fresh), "progress")
    done = translate(fresh).withColumn("since", F.lit(now).cast("timestamp"))
    page = [c for c in OPEN.names if c != "n_pages"]
    pool = materialise(done.select(page).unionByName(before.select(page)), "pool")
    # who ends is found from numbers alone; texts are only joined where some documents wait, or end without all pages
    numbers = fresh.select("doc_id", "n_pages").unionByName(before.select("doc_id", "n_pages"))
    state = pool.select("doc_id", "page_num", "status", "since").unionByName(numbers, allowMissingColumns=True).groupBy("doc_id").agg(
        F.count("page_num").alias("here"), F.coalesce(F.max("n_pages"), F.lit(0)).alias("announced"), F.min("since").alias("since"),
        F.coalesce(F.bool_or(F.col("status") == STATUS.unreadable), F.lit(False)).alias("unreadable"))
    whole = F.col("unreadable") | (F.col("here") >= F.col("announced"))
    overdue = F.col("since") < F.lit(now - wait).cast("timestamp")
    state = materialise(state.withColumn("whole", whole).withColumn("ends", F.col("whole") | overdue), "state")
    waiting, cut, short = state.where("NOT ends"), state.where("ends AND NOT whole"), state.where("ends AND announced > here")
    some = state.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in (("wait", "NOT ends"), ("cut", "ends AND NOT whole"), ("short", "ends AND announced > here"))]).first()
    documents = documents_of(pool.join(waiting, "doc_id", "left_anti") if some["wait"] else pool)
    if some["cut"]:
        partial = F.col("partial").isNotNull()
        documents = documents.join(cut.select("doc_id", F.lit(True).alias("partial")), "doc_id", "left").withColumns({
            "translated": F.when(~partial, F.col("translated")), "status": F.when(partial, STATUS.incomplete).otherwise(F.col("status"))}).drop("partial")
    _write_batch(documents, f"{folder}/documents", batch_id)
    documents = spark.read.schema(documents.schema).parquet(f"{folder}/documents/batch_id={batch_id}")
    numbered = documents.withColumn("seq", F.col("n_pages") + 1)
    if some["short"]:
        numbered = documents.join(short.select("doc_id", "announced"), "doc_id", "left").withColumn("seq", F.coalesce("announced", "n_pages") + 1)
    last = numbered.select("doc_id", "seq", final_event(name, max_output_bytes).alias("event"))
    events = shown.select("doc_id", F.col("page").alias("seq"), progress_event().alias("event")).unionByName(last)
    ends = documents.select(text_id)
    if refused is not None:
        ends = ends.unionByName(refused.select(text_id))
        events = events.unionByName(refused.select("doc_id", F.lit(1).alias("seq"), "event"))
    _write_batch(events, f"{folder}/events", batch_id)
    still = pool.join(waiting.select("doc_id", F.col("announced").alias("n_pages")), "doc_id") if some["wait"] else no_rows(spark, OPEN)
    _write_batch(still.select(OPEN.names), f"{folder}/open", batch_id)
    ended.write(ends, batch_id)
    if batch_id > 1:
        delete(spark, f"{folder}/open/batch_id={batch_id - 2}")


def start_documents(
    layout: DataFrame, translate: Translate, folder: str, name: Column | None = None, wait: timedelta = timedelta(hours=1),
    max_output_bytes: int = MAX_OUTPUT_BYTES, clock: Callable[[], datetime] = _utc_now, **trigger,
) -> StreamingQuery:
    """Translated documents of arriving pages in ``folder/documents``, their events in ``folder/events``.

    ``translate`` is the batch job over pages, for instance ``lambda pages: translate_pages(pages, config,
    batch=service, answers_at=f"{folder}/answers")``. Arriving pages are translated at once and kept until
    all ``n_pages`` of their document are there. A document that has waited longer than ``wait`` by ``clock``
    ends as ``incomplete`` with the next batch; a stream that stands still ends nothing. ``name`` is the
    upload's name, an expression over documents.
    """
    spark = layout.sparkSession
    shown = F.lit("document.pdf") if name is None else name

    def work(batch: DataFrame, batch_id: int) -> None:
        if not ended_table(spark, folder).holds(batch_id):
            with scratch(spark):
                _settle(materialise(batch, "arrived"), batch_id, translate, shown, folder, wait, clock(), max_output_bytes)

    return _each_batch(layout, folder, work, trigger)


def refusal(jobs: DataFrame) -> Column:
    """The message that ends a job with a ``verdict`` other than admitted."""
    message = F.try_element_at(F.create_map(*[F.lit(x) for pair in REFUSED_MESSAGES.items() for x in pair]), F.col("verdict"))
    if "base_url" in jobs.columns:
        insecure = (F.col("verdict") == "url") & (screen_url(first_filled(F.col("base_url"))) == "not_https")
        message = F.when(insecure, NOT_HTTPS_MESSAGE).otherwise(message)
    return message


def start_service(
    uploads: DataFrame, rules: AdmissionRules, decoder: Decoder, translate: Translate, folder: str, name: Column | None = None,
    wait: timedelta = timedelta(hours=1), max_output_bytes: int = MAX_OUTPUT_BYTES, clock: Callable[[], datetime] = _utc_now, **trigger,
) -> StreamingQuery:
    """Uploads through intake, decoding, translation and events, in one checkpointed job.

    ``uploads`` are ``(doc_id, content, source_lang, target_lang, declared[, has_key, base_url])``. Every one gets
    a row in ``folder/verdicts`` and exactly one last event: ``done``, or ``error`` with the reason it was
    refused or failed. Only what passes the rules on its bytes is decoded, once; the number of pages
    found then completes the verdict. An id that comes again after its job has ended, or twice in a
    batch, is one job: the first one, and of the same batch the one of the smallest content hash.
    """
    spark = uploads.sparkSession
    shown = F.lit("document.pdf") if name is None else name

    def work(batch: DataFrame, batch_id: int) -> None:
        ended = ended_table(spark, folder)
        if ended.holds(batch_id):
            return
        with scratch(spark):
            held = spark.read.schema(OPEN).parquet(f"{folder}/open/batch_id={batch_id - 1}").select("doc_id") if batch_id else None
            jobs = materialise(with_verdict(batch.where("doc_id IS NOT NULL").withColumn("n_pages", F.lit(0)), rules).drop("n_pages"), "jobs")
            if not jobs.groupBy("doc_id").count().where("count > 1").isEmpty():
                rest = [c for c in jobs.columns if c != "doc_id"]
                jobs = jobs.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.xxhash64("content")).alias("u")).select("doc_id", "u.*")
            gone = ended.lookup(jobs.select(F.col("doc_id").cast("string").alias("doc"))).select(F.col("doc").cast("bigint").alias("doc_id"))
            gone = materialise(gone if held is None else gone.unionByName(held).distinct(), "gone")
            jobs = jobs.join(gone, "doc_id", "left_anti")
            layout = materialise(decode_layout(jobs.where(F.col("verdict") == ADMITTED), decoder), "layout")
            found = layout.groupBy("doc_id").agg(F.max("n_pages").alias("n_pages"), F.bool_or(F.col("n_pages").isNull()).alias("unreadable"))
            counted = jobs.drop("content").join(found, "doc_id", "left").withColumn("verdict", F.when(F.col("verdict") != ADMITTED, F.col("verdict"))
                .when(F.coalesce("unreadable", F.lit(True)), "unreadable").when(F.col("n_pages") > rules.max_pages, "pages").otherwise(ADMITTED))
            judged = materialise(counted.withColumn("message", refusal(jobs)).select("doc_id", "verdict", "message"), "judged")
            _write_batch(judged.select("doc_id", "verdict"), f"{folder}/verdicts", batch_id)
            refused = judged.where(F.col("verdict") != ADMITTED).select("doc_id", error_event(F.col("message")).alias("event"))
            admitted = layout.join(judged.where(F.col("verdict") == ADMITTED), "doc_id", "left_semi")
            _settle(materialise(admitted, "admitted"), batch_id, translate, shown, folder, wait, clock(), max_output_bytes, refused)

    return _each_batch(uploads, folder, work, trigger)


# --- files ------------------------------------------------------------------------------------


def arriving_files(spark: SparkSession, path: str, pattern: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder and its subfolders as a stream of ``(path, modificationTime, length, content)``."""
    return (
        spark.readStream.format("binaryFile").schema(RAW_FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).load(path)
    )


HASHED_BYTES = 512 << 20  # of a file beyond the size limit; a row could not hold one of 2 GB at all


def first_copies(files: DataFrame, rules: AdmissionRules, within: str = "1 day", hashed_bytes: int = HASHED_BYTES) -> DataFrame:
    """Files with ``content_key``; of equal contents within ``within`` of file time the first one to arrive.

    The state holds one hash per content. Contents beyond the size limit are told apart by their hash but
    not carried along: they will be refused, and nothing else needs them. Of those also beyond ``hashed_bytes``
    not a byte is read: each such file is refused as itself, its key that of its path, time and length.
    """
    most = max(rules.max_bytes, hashed_bytes)
    read = files.where(F.col("length") <= most).withColumns({
        "content_key": F.sha2("content", 256), "content": F.when(F.col("length") <= rules.max_bytes, F.col("content"))})
    itself = F.sha2(F.concat_ws("\n", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string")), 256)
    unread = files.where(F.col("length") > most).withColumns({"content_key": itself, "content": F.lit(None).cast("binary")})
    kept = read.unionByName(unread)
    return kept.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["content_key"])


def start_raw_intake(files: DataFrame, rules: AdmissionRules, decoder: Decoder, folder: str, within: str = "1 day", **trigger) -> StreamingQuery:
    """Verdicts ``path, length, content_key, verdict, n_pages`` of arriving files, each content judged once.

    The same rules as for files of a folder, and with the decoder in the stream also ``unreadable`` and ``pages``.
    """
    judged = with_file_verdict(first_copies(files, rules, within), rules, decoder)
    return _append(judged.select("path", "length", "content_key", "verdict", "n_pages"), folder, "parquet", trigger)


def with_file_verdict(files: DataFrame, rules: AdmissionRules, decoder: Decoder) -> DataFrame:
    """Adds ``verdict`` and ``n_pages`` to ``(length, content)``, row by row. Only files that pass by their bytes are decoded."""
    @F.pandas_udf("int")
    def count(contents):
        def one(content):
            try:
                return None if content is None else sum(1 for _ in decoder(bytes(content)))
            except Exception:
                return None

        return contents.map(one).astype("Int32")

    early = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > rules.max_bytes, "size")
        .when(~F.startswith("content", F.lit(rules.magic)), "magic")
    )
    checked = files.withColumn("early", early)
    counted = checked.withColumn("n_pages", F.when(F.col("early").isNull(), count(F.when(F.col("early").isNull(), F.col("content")))))
    verdict = F.coalesce(F.col("early"), F.when(F.col("n_pages").isNull(), "unreadable").when(F.col("n_pages") > rules.max_pages, "pages"), F.lit(ADMITTED))
    return counted.withColumn("verdict", verdict).drop("early")
