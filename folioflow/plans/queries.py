"""The registered queries: ``name → (spark, sf_dir) → DataFrame`` with flat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.config import MODEL_LIST_QUOTAS, TRANSLATE_QUOTAS, AdmissionRules, Quota
from folioflow.functions import chat, text
from folioflow.functions.urls import screen_url
from folioflow.operators import admission, assembly, edits, glossary, quota, reports, translation
from folioflow.operators import layout as lay
from folioflow.operators.shared import materialise, run_folder
from folioflow.plans import corpus, inputs
from folioflow.plans.inputs import CONFIG, FONTS, JOB_RULES, SKIP_PAGES, documents, stand_in, stand_in_batch, table
from folioflow.sources import readers, sinks
from folioflow.streaming import jobs, service

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# --- scans, sources, sinks ---------------------------------------------------------------


@query
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "text")


@query
def raw_intake(spark, sf):
    rules = AdmissionRules(magic=b"PAR1", max_bytes=1 << 20)
    return readers.screen_files(readers.raw_files(spark, sf, "*.parquet"), rules)


@query
def spans_flatten(spark, sf):
    return lay.spans_of(inputs.layout(spark, sf))


@query
def decode_spans(spark, sf):
    docs = documents(spark, sf, "doc_id", F.encode("text", "utf-8").alias("content"))
    return lay.spans_of(readers.decode_layout(docs, _lines_as_layout)).select(
        "doc_id", "page_num", "block_no", "line_no", "text"
    )


def _lines_as_layout(content: bytes):
    """Smallest possible decoder: a page per 20 lines, a block per line."""
    lines = content.decode("utf-8").split("\n")
    box = {"x0": 0.0, "y0": 0.0, "x1": 0.0, "y1": 0.0}
    for at in range(0, len(lines), 20):
        yield [
            {"type": 0, "lines": [{"spans": [{"text": t, "bbox": box, "font": "helvetica", "size": 11.0}]}]}
            for t in lines[at:at + 20]
        ]


@query
def write_translated(spark, sf):
    done = translated_docs(spark, sf).select("doc_id", "translated")
    routed = done.withColumn("target_lang", F.when(F.col("doc_id") % 2 == 0, "Spanish").otherwise("French"))
    out = run_folder(spark, "translated")
    sinks.write_translated(routed, out)
    return spark.read.schema("doc_id BIGINT, translated STRING, target_lang STRING").parquet(out)


@query
def progress_ndjson(spark, sf):
    return reports.page_progress(inputs.layout(spark, sf)).select("doc_id", "page", reports.progress_event().alias("event"))


@query
def payload_b64(spark, sf):
    raw = F.encode("html", "utf-8")
    name = F.concat(F.lit("page."), F.col("page_id").cast("string"), F.lit(".html"))
    line = reports.done_event(name, raw)
    back = F.from_json(line, schemas.PROGRESS_EVENT)["pdf_b64"]
    return table(spark, sf, "pages").select(
        "page_id", line.alias("event"), F.octet_length(F.unbase64(back)).cast("bigint").alias("n_bytes")
    )


@query
def compact_dataset(spark, sf):
    out = run_folder(spark, "compacted")
    return sinks.compact_dataset(spark, f"{sf}/documents.parquet", out).drop("path")


@query
def intake_files(spark, sf):
    """Pages as uploads, some not listed: empty, of another kind, or never arrived."""
    page = F.col("page_id")
    path = F.concat(F.lit("up/"), page.cast("string"), F.when(page % 9 == 4, ".txt").otherwise(".html"))
    content = F.when(page % 9 == 2, "").when(page % 9 == 3, F.concat(F.lit(" "), "html")).otherwise(F.col("html"))
    uploads = table(spark, sf, "pages").select(path.alias("path"), F.encode(content, "utf-8").alias("content"), page.alias("id"))
    sized = uploads.withColumn("length", F.octet_length("content").cast("bigint"))
    manifest = sized.select("path", F.when(page_is(5), None).otherwise(F.col("length")).alias("length"))
    listed = sized.where((F.col("length") > 0) & ~page_is(4) & ~page_is(5)).drop("id")
    return readers.screen_files(listed, JOB_RULES, manifest).select("path", "verdict")


def page_is(rest: int):
    return F.col("id") % 9 == rest


@query
def compacted_rows(spark, sf):
    """What the rewritten dataset holds: all rows, unchanged."""
    out = run_folder(spark, "compacted")
    sinks.compact_dataset(spark, f"{sf}/documents.parquet", out)
    return readers.scan(spark, out, schemas.DOCUMENTS)


# --- admission ---------------------------------------------------------------------------


def _judged(spark, sf):
    return admission.with_verdict(inputs.admission_jobs(table(spark, sf, "pages")), JOB_RULES)


@query
def admit(spark, sf):
    return _judged(spark, sf).select("job_id", "verdict")


@query
def admit_report(spark, sf):
    return admission.verdict_report(_judged(spark, sf))


@query
def upload_precheck(spark, sf):
    page = F.col("page_id")
    uploads = table(spark, sf, "pages").select(
        page.alias("job_id"),
        F.concat(F.lit("upload"), page.cast("string"), F.when(page % 3 == 0, ".PDF").otherwise(".html")).alias("name"),
        F.when(page % 4 == 0, "application/pdf").when(page % 4 == 1, "text/html").alias("mime"),
        F.octet_length("html").alias("length"),
        F.when(page % 19 != 0, (1 + page % 5).cast("int")).alias("n_pages"),
    )
    return admission.precheck_uploads(uploads, JOB_RULES).select("job_id", "name", "verdict")


@query
def lang_allowed(spark, sf):
    docs = table(spark, sf, "documents").where(admission.language_allowed(F.col("lang"), JOB_RULES.languages))
    return admission.label_languages(docs, "lang", inputs.LANGUAGE_CODES).select("doc_id", "lang", "language")


@query
def lang_rejected(spark, sf):
    docs = table(spark, sf, "documents").where(~admission.language_allowed(F.col("lang"), JOB_RULES.languages))
    return docs.select("doc_id", "lang")


@query
def url_screen(spark, sf):
    urls = inputs.endpoint_urls(table(spark, sf, "pages"))
    return urls.select("page_id", "endpoint", F.coalesce(screen_url(F.col("endpoint")), F.lit("allowed")).alias("verdict"))


@query
def url_screen_report(spark, sf):
    return admission.verdict_report(url_screen(spark, sf))


@query
def output_cap(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return admission.capped_output(pages, "html", 4_000).drop("html")


@query
def job_routing(spark, sf):
    page = F.col("page_id")
    jobs_ = table(spark, sf, "pages").select(
        page.alias("job_id"), (page % 3 == 0).alias("has_key"),
        F.when(page % 2 == 0, F.concat(F.lit(" "), "url")).otherwise("\t ").alias("base_url"),
        F.when(page % 5 == 0, "own ").when(page % 5 == 1, "").alias("model"),
    )
    return admission.route_jobs(jobs_, inputs.DEFAULTS).select("job_id", "route", "eff_base_url", "eff_model")


@query
def output_names(spark, sf):
    name = F.regexp_extract("url", "([^/?#]*)(?:[?#].*)?$", 1)
    return table(spark, sf, "pages").select("page_id", name.alias("name")).select(
        "page_id",
        text.suffixed_name(F.col("name"), "_translated").alias("translated_name"),
        text.suffixed_name(F.col("name"), "_compressed").alias("compressed_name"),
        text.download_name(F.col("name")).alias("download_name"),
    )


# --- layout ------------------------------------------------------------------------------


def _boxes(column: str):
    whole = lambda b, k: b[k].cast("int").cast("string")
    return F.array_join(
        F.transform(column, lambda b: F.concat_ws(",", *[whole(b, k) for k in ("x0", "y0", "x1", "y1")])), ";"
    )


@query
def doc_pages(spark, sf):
    return inputs.layout(spark, sf).select("doc_id", "page_num", "n_pages")


@query
def page_counts(spark, sf):
    return lay.page_counts(inputs.layout(spark, sf))


@query
def blocks(spark, sf):
    found = lay.text_blocks(inputs.layout(spark, sf))
    return found.select(
        "doc_id", "page_num", "block_no", "text", _boxes("bboxes").alias("bboxes"), "font", F.round("size", 6).alias("size")
    )


@query
def blocks_from_spans(spark, sf):
    found = lay.fold_spans(lay.spans_of(inputs.layout(spark, sf)))
    return found.select(
        "doc_id", "page_num", "block_no", "text", _boxes("bboxes").alias("bboxes"), "font", F.round("size", 6).alias("size")
    )


@query
def block_bbox(spark, sf):
    return lay.text_blocks(inputs.layout(spark, sf)).select("doc_id", "page_num", "block_no", "rect.*")


@query
def block_font(spark, sf):
    return lay.text_blocks(inputs.layout(spark, sf)).select("doc_id", "page_num", "block_no", "font")


@query
def resolve_fonts(spark, sf):
    font = edits.resolved_font(F.col("font"), FONTS, CONFIG.fallback_font)
    spans = lay.spans_of(inputs.layout(spark, sf))
    return spans.select("doc_id", "page_num", "block_no", "line_no", "span_no", "font", font.alias("resolved"))


@query
def skip_pages(spark, sf):
    return lay.flagged_pages(inputs.layout(spark, sf), SKIP_PAGES)


@query
def blank_pages(spark, sf):
    return lay.blank_pages(inputs.layout(spark, sf))


@query
def route_blocks(spark, sf):
    found = lay.text_blocks(inputs.layout(spark, sf))
    return lay.routed_blocks(found, SKIP_PAGES).select("doc_id", "page_num", "block_no", "route")


@query
def block_batches(spark, sf):
    found = lay.text_blocks(inputs.layout(spark, sf))
    return lay.block_batches(found, 2).select("doc_id", "page_num", "block_no", "batch_no")


@query
def html_blocks(spark, sf):
    return readers.html_blocks(table(spark, sf, "pages"))


@query
def layout_collisions(spark, sf):
    return lay.collisions(inputs.layout(spark, sf))


# --- chunks and translation --------------------------------------------------------------


def _doc_chunks(spark, sf):
    return translation.chunks_of(documents(spark, sf, "doc_id", "text"), CONFIG.max_chunk_size, ["doc_id"])


@query
def chunks(spark, sf):
    return _doc_chunks(spark, sf)


@query
def chunk_stats(spark, sf):
    sized = translation.chunks_of(documents(spark, sf, "doc_id", "lang", "text"), CONFIG.max_chunk_size, ["lang"])
    n = F.length("text")
    return sized.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(n.cast("bigint")).alias("n_chars"),
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.count_if("over_limit").alias("n_over"),
    )


@query
def build_requests(spark, sf):
    body = chat.request_json(F.col("text"), "stand-in", CONFIG.source_lang, CONFIG.target_lang)
    return _doc_chunks(spark, sf).select("doc_id", "chunk_no", body.alias("request"))


@query
def parse_responses(spark, sf):
    """Bodies made from conversation turns: well-formed, blank, without choices, and broken."""
    turn = F.col("turn")
    content = F.when((F.col("conv_id") + turn) % 7 == 0, " \n ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    good = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    body = F.when((F.col("conv_id") + turn) % 11 == 0, '{"choices":[]}').when(
        (F.col("conv_id") + turn) % 13 == 0, "upstream error"
    ).otherwise(good)
    turns = spark.read.schema("conv_id BIGINT, turn BIGINT, role STRING, text STRING").parquet(f"{sf}/conversations.parquet")
    return turns.select("conv_id", "turn", chat.response_text(body).alias("answer"))


@query
def translate_fallback(spark, sf):
    """Responses arrive as a table of their own and are joined on the chunk's position."""
    pieces = _doc_chunks(spark, sf)
    responses = pieces.select("doc_id", "chunk_no", stand_in(F.col("text")).alias("answer")).where("answer IS NOT NULL")
    return translation.with_fallback(pieces, responses, ["doc_id", "chunk_no"])


@query
def translate_distinct(spark, sf):
    return translation.translate_once(
        _doc_chunks(spark, sf), stand_in_batch, CONFIG.source_lang, CONFIG.target_lang, CONFIG.model
    ).drop("error")


@query
def glossary_translate(spark, sf):
    """Chunks with the opening words of benchmark items, one to four of them, replaced as fixed phrases."""
    item = F.col("item_id")
    term = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(glossary.WORD), F.lit(0)), F.lit(1), (1 + item % 4).cast("int")), " ")
    terms = table(spark, sf, "benchmark").select(term.alias("term"), F.concat(F.lit("<"), item.cast("string"), F.lit(">")).alias("translation"))
    pieces = materialise(_doc_chunks(spark, sf), "pieces")
    return glossary.apply_glossary(pieces, terms, ["doc_id", "chunk_no"]).select("doc_id", "chunk_no", "answer", "n_terms")


@query
def memory_misses(spark, sf):
    """Requests of all documents against a memory filled by those in English."""
    key = translation.chunk_key(F.col("text"), CONFIG.source_lang, CONFIG.target_lang, CONFIG.model)
    docs = documents(spark, sf, "doc_id", "lang", "text")
    wanted = translation.distinct_requests(translation.chunks_of(docs, 1000, ["lang"]), key)
    known = translation.distinct_requests(translation.chunks_of(docs.where("lang = 'en'"), 1000, ["lang"]), key)
    return translation.missing_requests(wanted, known)


@query
def rejoin_blocks(spark, sf):
    """Blocks of the layout through the batch translator and back."""
    found = lay.routed_blocks(lay.text_blocks(inputs.layout(spark, sf)), SKIP_PAGES)
    return corpus.translate_blocks(found, CONFIG, stand_in_batch)


@query
def translated_pages(spark, sf):
    return corpus.translate_pages(inputs.layout(spark, sf), CONFIG, column=stand_in).drop("status")


@query
def translated_docs(spark, sf):
    return corpus.translate_documents(inputs.layout(spark, sf), CONFIG, column=stand_in).drop("status")


@query
def translated_docs_service(spark, sf):
    """The same documents through the batch translator."""
    return corpus.translate_documents(inputs.layout(spark, sf), CONFIG, batch=stand_in_batch).drop("status")


@query
def decode_outcomes(spark, sf):
    """Every document through a decoder that fails on some and finds no pages in others."""
    docs = documents(spark, sf, "doc_id", F.encode("text", "utf-8").alias("content"))
    done = corpus.translate_documents(readers.decode_layout(docs, _moody_decoder), CONFIG, batch=stand_in_batch)
    return done.select("doc_id", "status", "n_pages", F.col("translated").isNull().alias("without_text"))


def _moody_decoder(content: bytes):
    if len(content) % 7 == 0:
        raise ValueError("not readable")
    return [] if len(content) % 7 == 1 else list(_lines_as_layout(content))


@query
def translate_corpus(spark, sf):
    """Admission by language, chunks, each distinct chunk once, fallback, documents.

    Documents in other languages stay, with the verdict that says why they have no translation.
    """
    docs = documents(spark, sf, "doc_id", "lang", "text")
    allowed = F.coalesce(admission.language_allowed(F.col("lang"), JOB_RULES.languages), F.lit(False))
    pieces = translation.chunks_of(docs.where(allowed), CONFIG.max_chunk_size, ["doc_id", "lang"])
    done = translation.translate_once(pieces, stand_in_batch, CONFIG.source_lang, CONFIG.target_lang, CONFIG.model)
    translated = assembly.rejoin(done, ["doc_id", "lang"]).withColumn("verdict", F.lit(admission.ADMITTED))
    none = F.lit(0)
    refused = docs.where(~allowed).select(
        "doc_id", "lang", F.lit(None).cast("string").alias("translated"), none.alias("n_chunks"), none.alias("n_failed"),
        F.lit(admission.LANGUAGE).alias("verdict"),
    )
    return translated.unionByName(refused)


@query
def outcome_causes(spark, sf):
    """Chunks by outcome, and by the kind of error where the service failed."""
    pieces = translation.chunks_of(documents(spark, sf, "doc_id", "lang", "text"), CONFIG.max_chunk_size, ["doc_id", "lang"])
    done = translation.translate_once(pieces, stand_in_batch, CONFIG.source_lang, CONFIG.target_lang, CONFIG.model)
    return reports.outcome_causes(done, ["lang"])


@query
def outcome_report(spark, sf):
    docs = documents(spark, sf, "lang", "text")
    pieces = translation.chunks_of(docs, CONFIG.max_chunk_size, ["lang"])
    done = translation.outcome(F.col("text"), stand_in(F.col("text")))
    return reports.outcome_report(pieces.select("lang", done["status"].alias("status")), ["lang"])


def _outcomes(spark, sf):
    docs = documents(spark, sf, "lang", "source", "text")
    done = translation.outcome(F.col("text"), stand_in(F.col("text")))
    return translation.chunks_of(docs, CONFIG.max_chunk_size, ["lang", "source"]).select("lang", "source", done["status"].alias("status"))


@query
def outcome_rollup(spark, sf):
    return reports.outcome_rollup(_outcomes(spark, sf), ["lang", "source"])


@query
def observed_outcomes(spark, sf):
    """What a job counts while it writes its result, beside what the result then holds."""
    from pyspark.sql import Observation

    seen = Observation("outcomes")
    out = run_folder(spark, "outcomes")
    reports.observed(_outcomes(spark, sf), seen).write.parquet(out)
    counts = seen.get
    rows = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n_written"))
    return rows.select(*[F.lit(counts[c]).cast("bigint").alias(c) for c in ("n_chunks", "n_failed")], "n_written")


@query
def size_report(spark, sf):
    docs = documents(spark, sf, "lang", "source", "text")
    done = translation.translate_inline(F.col("text"), stand_in, CONFIG.max_chunk_size)
    sizes = reports.size_report(docs.withColumn("out", done["text"]), "text", "out", ["lang", "source"])
    shown = {c: F.round(c, 6) for c in ("in_mb", "out_mb", "saved_mb", "reduction_pct")}
    return sizes.withColumns(shown)


@query
def preservation_audit(spark, sf):
    docs = documents(spark, sf, "lang", "text")
    done = translation.translate_inline(F.col("text"), stand_in, CONFIG.max_chunk_size)
    return reports.preservation_audit(docs.withColumn("out", done["text"]), "text", "out", ["lang"])


# --- edit plans --------------------------------------------------------------------------


def _plan(spark, sf, preserve: bool, **translator):
    config = inputs.TranslationConfig(
        CONFIG.source_lang, CONFIG.target_lang, skip_pages=SKIP_PAGES, preserve_layout=preserve
    )
    plan = corpus.translate_edits(inputs.layout(spark, sf), config, FONTS, **translator)
    return plan.withColumns({"size": F.round("size", 6), "align": F.col("align").cast("string")})


@query
def edit_plan_preserve(spark, sf):
    return _plan(spark, sf, True, column=stand_in)


@query
def edit_plan_free(spark, sf):
    return _plan(spark, sf, False, column=stand_in)


@query
def edit_plan_service_preserve(spark, sf):
    return _plan(spark, sf, True, batch=stand_in_batch)


@query
def edit_plan_service_free(spark, sf):
    return _plan(spark, sf, False, batch=stand_in_batch)


@query
def overflow_report(spark, sf):
    config = inputs.TranslationConfig(CONFIG.source_lang, CONFIG.target_lang, skip_pages=SKIP_PAGES)
    return edits.overflow_report(edits.translated_blocks(lay.text_blocks(inputs.layout(spark, sf)), config, stand_in))


@query
def line_report(spark, sf):
    config = inputs.TranslationConfig(CONFIG.source_lang, CONFIG.target_lang, skip_pages=SKIP_PAGES)
    return edits.line_report(edits.translated_blocks(lay.text_blocks(inputs.layout(spark, sf)), config, stand_in))


@query
def edit_survival(spark, sf):
    return edits.survival(inputs.layout(spark, sf), CONFIG).withColumn("cleared", F.round("cleared", 6))


@query
def event_fragments(spark, sf):
    """The events of every job as one stream of bytes, cut every 97 bytes, and put together again."""
    lines = job_events(spark, sf).withColumn("line", F.concat("event", F.lit("\n")))
    whole = lines.groupBy("doc_id").agg(F.encode(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "line")))["line"], ""), "utf-8").alias("bytes"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("bytes") - 1) / 97).cast("int"))).alias("seq")
    cut = whole.select("doc_id", "bytes", at).select(F.col("doc_id").alias("stream"), "seq", F.substring("bytes", F.col("seq") * 97 + 1, F.lit(97)).alias("data"))
    return sinks.events_of(cut).select(F.col("stream").alias("doc_id"), "type", "page", "total", "percent", "filename", "pdf_b64", "message")


@query
def job_events(spark, sf):
    """All events of every job as JSON lines, with a limit on the size of results."""
    layout = inputs.layout(spark, sf)
    docs = corpus.translate_documents(layout, CONFIG, column=stand_in)
    return reports.job_events(layout, docs, _doc_name(), max_output_bytes=6_000)


# --- progress and quotas -----------------------------------------------------------------


@query
def progress(spark, sf):
    return reports.page_progress(inputs.layout(spark, sf))


def _arrivals(spark, sf):
    return quota.arrivals(table(spark, sf, "events"), "event_type")


@query
def quota_(spark, sf):
    return quota.with_verdicts(_arrivals(spark, sf), TRANSLATE_QUOTAS).drop("ts")


@query
def quota_admitted(spark, sf):
    return quota.admitted(_arrivals(spark, sf), TRANSLATE_QUOTAS).select("event_id", "client")


@query
def quota_model_list(spark, sf):
    return quota.with_verdicts(_arrivals(spark, sf), MODEL_LIST_QUOTAS).drop("ts")


@query
def quota_report(spark, sf):
    return quota.quota_report(_arrivals(spark, sf), TRANSLATE_QUOTAS)


@query
def quota_large(spark, sf):
    """A limit beyond the optimiser's threshold for group limits."""
    month = quota.arrivals(table(spark, sf, "events").withColumn("ts", F.date_trunc("month", "ts").cast("timestamp_ntz")), "event_type")
    return quota.with_verdicts(month, (Quota("day", 1_500),)).drop("ts")


# --- streaming ---------------------------------------------------------------------------


def _finish(running) -> None:
    running.awaitTermination()


@query
def stream_intake(spark, sf):
    pages = inputs.arriving_table(spark, sf, "pages")
    folder = run_folder(spark, "intake")
    _finish(jobs.start_intake(inputs.admission_jobs(pages), JOB_RULES, folder))
    return spark.read.schema("job_id BIGINT, verdict STRING").parquet(f"{folder}/out")


@query
def stream_progress(spark, sf):
    docs = inputs.arriving_table(spark, sf, "documents")
    folder = run_folder(spark, "progress")
    _finish(jobs.start_progress(inputs.layout_of(docs), folder))
    lines = spark.read.schema("doc_id BIGINT, type STRING, page INT, total INT, percent INT").json(f"{folder}/out")
    return lines


def _dealt(spark, rows: DataFrame, schema, parts: int, key: str):
    """``rows`` written in ``parts`` deliveries by a hash of ``key``; yields a stream over what is there after each."""
    folder = run_folder(spark, "deliveries")
    for part in range(parts):
        rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part).write.parquet(f"{folder}/part-{part}")
        yield spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def _doc_name():
    return F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf"))


@query
def stream_documents(spark, sf):
    """Arriving documents through the batch translator, with a memory that all batches share."""
    folder = run_folder(spark, "documents")
    layout = inputs.layout_of(inputs.arriving_table(spark, sf, "documents"))
    _finish(service.start_documents(layout, lambda pages: corpus.translate_pages(
        pages, CONFIG, batch=stand_in_batch, answers_at=f"{folder}/answers"), folder))
    return spark.read.parquet(f"{folder}/documents").drop("batch_id", "status")


@query
def stream_documents_parts(spark, sf):
    """Pages dealt over three deliveries, so that most long documents come in pieces."""
    folder = run_folder(spark, "documents")
    pages = inputs.layout(spark, sf).withColumn("at", F.concat_ws(":", "doc_id", "page_num"))
    for layout in _dealt(spark, pages, pages.schema, 3, "at"):
        _finish(service.start_documents(layout.drop("at"), lambda p: corpus.translate_pages(p, CONFIG, column=stand_in), folder))
    return spark.read.parquet(f"{folder}/documents").drop("batch_id")


@query
def stream_events(spark, sf):
    folder = run_folder(spark, "events")
    layout = inputs.layout_of(inputs.arriving_table(spark, sf, "documents"))
    _finish(service.start_documents(
        layout, lambda pages: corpus.translate_pages(pages, CONFIG, column=stand_in), folder, _doc_name(), max_output_bytes=6_000))
    return spark.read.parquet(f"{folder}/events").drop("batch_id")


@query
def stream_service(spark, sf):
    """Pages as uploads, in three deliveries: verdicts, decoding, translation and events in one job."""
    folder = run_folder(spark, "service")
    jobs_ = inputs.admission_jobs(table(spark, sf, "pages")).drop("n_pages").withColumnRenamed("job_id", "doc_id")
    uploads = jobs_.withColumn("content", F.encode("content", "utf-8"))
    for stream in _dealt(spark, uploads, uploads.schema, 3, "doc_id"):
        _finish(service.start_service(
            stream, JOB_RULES, _strict_decoder, lambda p: corpus.translate_pages(p, CONFIG, column=stand_in), folder, _doc_name(), max_output_bytes=2_000))
    return spark.read.parquet(f"{folder}/events").drop("batch_id")


def _strict_decoder(content: bytes):
    if len(content) % 7 == 0:
        raise ValueError("not readable")
    return list(_lines_as_layout(content))


@query
def stream_raw_files(spark, sf):
    """The table files themselves as arriving uploads, each content judged once."""
    folder = run_folder(spark, "raw")
    rules = AdmissionRules(magic=b"PAR1", max_bytes=1 << 20)
    _finish(service.start_raw_intake(service.arriving_files(spark, sf, "*.parquet"), rules, _footers, folder))
    return spark.read.schema("path STRING, length BIGINT, content_key STRING, verdict STRING, n_pages INT").parquet(f"{folder}/out")


def _footers(content: bytes):
    """Decoder of Parquet files: their row groups are the pages."""
    import io

    import pyarrow.parquet as pq

    return [[] for _ in range(pq.ParquetFile(io.BytesIO(content)).num_row_groups)]


@query
def stream_translate(spark, sf):
    docs = inputs.arriving_table(spark, sf, "documents")
    folder = run_folder(spark, "memory")
    _finish(jobs.start_translation(
        docs, stand_in_batch, CONFIG.source_lang, CONFIG.target_lang, CONFIG.max_chunk_size, folder, CONFIG.model
    ))
    return jobs.read_memory(spark, folder)


@query
def stream_translate_parts(spark, sf):
    """Documents in four deliveries: chunks that come up again are found in the keyed memory and counted."""
    folder = run_folder(spark, "memory")
    docs = documents(spark, sf, "doc_id", "text")
    for stream in _dealt(spark, docs, docs.schema, 4, "doc_id"):
        _finish(jobs.start_translation(
            stream, stand_in_batch, CONFIG.source_lang, CONFIG.target_lang, CONFIG.max_chunk_size, folder, CONFIG.model))
    return jobs.read_memory(spark, folder)


@query
def stream_quota(spark, sf):
    events = quota.arrivals(inputs.arriving_table(spark, sf, "events"), "event_type")
    folder = run_folder(spark, "quota")
    _finish(jobs.start_quota(events, TRANSLATE_QUOTAS, folder))
    return spark.read.parquet(f"{folder}/verdicts").drop("ts", "batch_id", "late")


@query
def stream_over_limit(spark, sf):
    events = quota.arrivals(inputs.arriving_table(spark, sf, "events"), "event_type")
    folder = run_folder(spark, "over-limit")
    _finish(jobs.start_over_limit(events, TRANSLATE_QUOTAS[0], folder))
    over = jobs.read_over_limit(spark, folder, TRANSLATE_QUOTAS[0])
    return over.withColumn("period", F.col("period").cast("timestamp_ntz"))
