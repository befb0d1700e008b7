"""Documents whose pages arrive in pieces, and the whole service as one stream."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.config import AdmissionRules
from folioflow.operators import reports
from folioflow.operators.layout import page_status
from folioflow.plans import corpus, inputs
from folioflow.plans.queries import _strict_decoder
from folioflow.schemas import LAYOUT
from folioflow.sources import readers
from folioflow.streaming import service

NOON = datetime(2024, 3, 1, 12, tzinfo=UTC)


def translate(pages):
    return corpus.translate_pages(pages, inputs.CONFIG, column=inputs.stand_in)


def light(pages):
    """The cheapest job over pages, for tests that are not about translation."""
    zero = F.lit(0)
    return pages.select("doc_id", "page_num", page_status().alias("status"), F.col("blocks")[0]["lines"][0]["spans"][0]["text"].alias("translated"),
                        zero.alias("n_blocks"), zero.alias("n_chunks"), zero.alias("n_failed"))


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def page(doc_id, page_num, n_pages, text="some words"):
    box = {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0}
    return {"doc_id": doc_id, "page_num": page_num, "n_pages": n_pages, "blocks": None if page_num is None else [
        {"type": 0, "lines": [{"spans": [{"text": f"{text} {page_num}", "bbox": box, "font": "helvetica", "size": 11.0}]}]}]}


class Desk:
    """Deliveries of pages, each worked off as a batch of its own at its own time."""

    def __init__(self, spark, tmp_path, **settings):
        self.spark, self.source, self.folder, self.n, self.settings = spark, tmp_path / "in", str(tmp_path / "out"), 0, settings

    def deliver(self, pages, now=NOON, work=light):
        self.spark.createDataFrame(pages, LAYOUT).coalesce(1).write.parquet(f"{self.source}/n{self.n}")
        self.n += 1
        self.run(now, work)

    def run(self, now=NOON, work=light):
        stream = self.spark.readStream.schema(LAYOUT).option("recursiveFileLookup", "true").parquet(str(self.source))
        service.start_documents(stream, work, self.folder, clock=lambda: now, **self.settings).awaitTermination()

    def read(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}").drop("batch_id")

    def statuses(self):
        return {r["doc_id"]: r["status"] for r in self.read("documents").collect()}


def test_pages_over_batches_give_the_documents_of_the_batch_job(spark, tmp_path):
    desk = Desk(spark, tmp_path)
    pages = [page(d, n, 3) for d in range(6) for n in range(3)]
    desk.deliver([p for p in pages if (p["doc_id"] + p["page_num"]) % 3 == 0], work=translate)
    assert desk.statuses() == {}
    desk.deliver([p for p in pages if (p["doc_id"] + p["page_num"]) % 3 == 1] + [page(9, None, None), page(8, None, 0)], work=translate)
    assert desk.statuses() == {8: "no_pages", 9: "unreadable"}, "they end at once"
    # the rest, with pages that were sent before, twice in one batch, and for documents that have ended
    rest = [p for p in pages if (p["doc_id"] + p["page_num"]) % 3 == 2]
    desk.deliver(rest + rest[:2] + pages[:4] + [page(9, 0, 1), page(None, 0, 1)], work=translate)
    layout = spark.createDataFrame(pages + [page(9, None, None), page(8, None, 0)], LAYOUT)
    want = corpus.translate_documents(layout, inputs.CONFIG, column=inputs.stand_in)
    assert same(desk.read("documents"), want)
    assert same(desk.read("events"), reports.job_events(layout, want, F.lit("document.pdf")))
    desk.deliver(pages, work=translate)
    assert same(desk.read("documents"), want), "a document ends once, whatever comes afterwards"
    assert desk.read("late").count() >= len(pages)
    ends = desk.read("events").where("event LIKE '%\"done\"%' OR event LIKE '%\"error\"%'").groupBy("doc_id").count()
    assert ends.count() == 8 and ends.where("count <> 1").count() == 0
    assert desk.read("open").count() == 0


def test_documents_that_wait_too_long_end_as_incomplete(spark, tmp_path):
    desk = Desk(spark, tmp_path, wait=timedelta(minutes=30))
    desk.deliver([page(1, 0, 2), page(2, 0, 2)])
    desk.deliver([page(2, 1, 2), page(3, 0, 2)], NOON + timedelta(minutes=20))
    assert desk.statuses() == {2: "translated"}
    desk.deliver([page(4, 0, 1)], NOON + timedelta(minutes=40))
    assert desk.statuses() == {1: "incomplete", 2: "translated", 4: "translated"}, "3 is younger"
    desk.deliver([page(1, 1, 2), page(3, 1, 2)], NOON + timedelta(minutes=45))
    assert desk.statuses() == {1: "incomplete", 2: "translated", 3: "translated", 4: "translated"}
    last = desk.read("events").where("doc_id = 1").orderBy("seq").collect()
    assert [json.loads(r["event"])["type"] for r in last] == ["progress", "error"] and last[-1]["seq"] == 3
    kept = sorted(p.name for p in (tmp_path / "out" / "open").iterdir())
    assert kept == ["batch_id=2", "batch_id=3"], "older open pages are removed"


def test_a_batch_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    desk = Desk(spark, tmp_path)
    desk.deliver([page(1, 0, 2), page(2, 0, 1)])
    monkeypatch.setattr(service.KeyedTable, "write", lambda *a: 1 / 0)  # the last step of a batch
    with pytest.raises(Exception, match="ZeroDivision"):
        desk.deliver([page(1, 1, 2), page(3, 0, 1)])
    monkeypatch.undo()
    desk.run()
    assert desk.statuses() == {1: "translated", 2: "translated", 3: "translated"}
    assert desk.read("documents").count() == 3 and desk.read("events").count() == 4 + 3


def test_pages_of_different_content_under_one_number(spark, tmp_path):
    got = set()
    for n, order in enumerate(([0, 1], [1, 0])):
        desk = Desk(spark, tmp_path / str(n))
        both = [page(1, 0, 1, "first"), page(1, 0, 1, "second")]
        desk.deliver([both[i] for i in order])
        got.add(desk.read("documents").first()["translated"])
    assert len(got) == 1, "the same one is taken, in whatever order they come"


UPLOAD = "doc_id BIGINT, content BINARY, source_lang STRING, target_lang STRING, declared STRING, has_key BOOLEAN, base_url STRING"
RULES = AdmissionRules(languages=("en", "es"), magic=b"%P", max_bytes=200, max_pages=2)


def uploads():
    good = b"%P line one\nline two\n"
    rows = [(i, good + b"x" * i, "en", "es", "20", True, None) for i in range(12)]
    rows += [
        (20, good, "xx", "es", "20", True, None), (21, good, "en", "es", "20", False, None), (22, good, "en", "es", "20", True, "http://a.example"),
        (23, good, "en", "es", "20", True, "https://localhost"), (24, good, "en", "es", "99999999", True, None), (25, b"", "en", "es", "0", True, None),
        (26, b"GIF", "en", "es", "3", True, None), (27, b"%P" + b"y" * 300, "en", "es", "3", True, None), (28, None, "en", "es", None, True, None),
        (29, b"%P" + b"\nl" * 50, "en", "es", "3", True, None),
    ]
    return rows


def serve(spark, tmp_path, deliveries, work=translate):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    for n, rows in enumerate(deliveries):
        spark.createDataFrame(rows, UPLOAD).coalesce(1).write.mode("overwrite").parquet(f"{source}/n{n}")
        stream = spark.readStream.schema(UPLOAD).option("recursiveFileLookup", "true").parquet(str(source))
        service.start_service(stream, RULES, _strict_decoder, work, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/verdicts").drop("batch_id"), spark.read.parquet(f"{folder}/events").drop("batch_id")


def test_every_upload_has_one_verdict_and_one_end(spark, tmp_path):
    rows = uploads()
    verdicts, events = serve(spark, tmp_path, [rows[:10], rows[5:] + rows[12:14]])
    got = {r["doc_id"]: r["verdict"] for r in verdicts.collect()}
    readable = {i: len(rows[i][1]) % 7 != 0 for i in range(12)}
    want = {i: "admitted" if ok else "unreadable" for i, ok in readable.items()} | {
        20: "language", 21: "credentials", 22: "url", 23: "url", 24: "declared_length", 25: "empty", 26: "magic", 27: "size", 28: "empty", 29: "pages"}
    assert got == want and verdicts.count() == len(want)
    assert set(readable.values()) == {True, False}
    layout = readers.decode_layout(spark.createDataFrame([(r[0], r[1]) for r in rows if want[r[0]] == "admitted"], "doc_id BIGINT, content BINARY"), _strict_decoder)
    batch = reports.job_events(layout, corpus.translate_documents(layout, inputs.CONFIG, column=inputs.stand_in), F.lit("document.pdf"))
    admitted = events.join(verdicts.where("verdict = 'admitted'"), "doc_id").drop("verdict")
    assert same(admitted, batch)
    refused = {r["doc_id"]: json.loads(r["event"]) for r in events.join(verdicts.where("verdict <> 'admitted'"), "doc_id").collect()}
    assert len(refused) == len(want) - sum(readable.values()) and {e["type"] for e in refused.values()} == {"error"}
    assert refused[22]["message"] == "Only https:// endpoints are allowed." and refused[23]["message"] == "That endpoint is not allowed."


def test_a_stop_between_verdict_and_translation(spark, tmp_path):
    rows = uploads()

    def stops(pages):
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        serve(spark, tmp_path / "a", [rows], stops)
    assert spark.read.parquet(str(tmp_path / "a/out/verdicts")).count() == 22
    stream = spark.readStream.schema(UPLOAD).option("recursiveFileLookup", "true").parquet(str(tmp_path / "a/in"))
    service.start_service(stream, RULES, _strict_decoder, light, str(tmp_path / "a/out")).awaitTermination()
    whole = serve(spark, tmp_path / "b", [rows], light)
    for name, want in zip(("verdicts", "events"), whole):
        assert same(spark.read.parquet(str(tmp_path / f"a/out/{name}")).drop("batch_id"), want)


def test_files_are_judged_once_by_content(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    files = {"a.pdf": b"%P one", "b.pdf": b"%P one", "sub/c.pdf": b"%P" + b"z" * 300, "d.pdf": b"GIF", "e.pdf": b"%P 12345", "f.txt": b"%P one",
             "g.pdf": b"%P" + b"\nl" * 50}
    for name, data in files.items():
        (source / name).write_bytes(data)

    def run():
        stream = service.arriving_files(spark, str(source), files_per_batch=2)
        service.start_raw_intake(stream, RULES, _strict_decoder, str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out/out"))

    got = run()
    verdicts = {r["path"].rsplit("/", 1)[1]: r["verdict"] for r in got.collect()}
    one = {"a.pdf", "b.pdf"} & set(verdicts)
    assert len(one) == 1 and got.count() == 5
    assert {k: v for k, v in verdicts.items() if k not in one} == {"c.pdf": "size", "d.pdf": "magic", "e.pdf": "admitted" if len(files["e.pdf"]) % 7 else "unreadable", "g.pdf": "pages"}
    (source / "again.pdf").write_bytes(b"%P one")
    (source / "new.pdf").write_bytes(b"%P two")
    assert run().count() == 6, "an upload that was judged before is not judged again, also after a restart"
    batch = readers.screen_files(readers.raw_files(spark, str(source)), RULES)
    by_bytes = {r["path"]: r["verdict"] for r in batch.collect()}
    for row in run().collect():
        assert by_bytes[row["path"]] == (row["verdict"] if row["verdict"] not in ("unreadable", "pages") else "admitted")


def test_files_too_large_for_a_row_are_refused_unread(spark, tmp_path):
    from folioflow.streaming.jobs import _append

    source = tmp_path / "in"
    source.mkdir()
    for name, data in {"a.pdf": b"%P one", "b.pdf": b"%P one", "c.pdf": b"%P" + b"z" * 300, "d.pdf": b"%P" + b"z" * 300}.items():
        (source / name).write_bytes(data)
    limit = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "250")  # of a column's content; 2 GB by default
    try:
        kept = service.first_copies(service.arriving_files(spark, str(source)), RULES, hashed_bytes=250)
        judged = service.with_file_verdict(kept, RULES, _strict_decoder).select("path", "length", "content_key", "verdict", "n_pages")
        _append(judged, str(tmp_path / "out"), "parquet", {}).awaitTermination()
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", limit)
    got = [(r["length"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out/out")).collect()]
    assert len(got) == 3 and got.count((302, "size")) == 2


def test_new_pages_are_written_once(spark, tmp_path, monkeypatch):
    made, write = [], service.materialise
    monkeypatch.setattr(service, "materialise", lambda df, label: made.append(label) or write(df, label))
    jobs_ = spark.createDataFrame([(1, b"a\nb"), (2, b"c")], "doc_id BIGINT, content BINARY")
    layout = write(service.decode_layout(jobs_, _strict_decoder), "layout")
    folder = str(tmp_path / "out")
    translate = lambda p: corpus.translate_pages(p, inputs.CONFIG, column=inputs.stand_in)
    service._settle(layout, 0, translate, F.lit("x.pdf"), folder, timedelta(hours=1), service._utc_now(), 10_000)
    assert "fresh" not in made and spark.read.parquet(f"{folder}/documents").count() == 2


def test_texts_are_not_joined_where_all_documents_end(spark, tmp_path, monkeypatch):
    plans, write = {}, service._write_batch

    def seen(df, path, batch_id):
        plans[path.rsplit("/", 1)[1], batch_id] = df._jdf.queryExecution().executedPlan().toString()
        write(df, path, batch_id)

    monkeypatch.setattr(service, "_write_batch", seen)
    desk = Desk(spark, tmp_path)
    desk.deliver([page(d, n, 2) for d in range(6) for n in range(2)])
    assert not any("Join" in plans[name, 0] for name in ("documents", "events", "open"))
    desk.deliver([page(7, 0, 2), page(8, 0, 1)])
    assert desk.statuses() == dict.fromkeys((0, 1, 2, 3, 4, 5, 8), "translated")
    kept = [(r["doc_id"], r["page_num"], r["n_pages"]) for r in desk.read("open").collect()]
    assert kept == [(7, 0, 2)]
