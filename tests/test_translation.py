from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import Observation

from folioflow.functions import chat
from folioflow.operators import assembly, reports
from folioflow.operators import translation as tr
from folioflow.operators.shared import attach, materialise, run_folder
from folioflow.plans.inputs import stand_in, stand_in_batch


def swap(text):
    return "[es] " + text.translate(str.maketrans("aeiou0", "eioua1"))


def final(text):
    return (text, "blank") if not text.strip() else (text, "failed") if len(text) % 17 == 0 else (
        (text, "empty") if len(text) % 17 == 1 else (swap(text), "translated"))


def texts_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")


TEXTS = ["Hello there", "x" * 17, "y" * 18, "  ", "Hello there", "one. " * 60 + "end", "", " padded "]


def test_outcomes_of_both_kinds_of_translator(spark):
    df = texts_df(spark, TEXTS[:5])
    want = [final(t) for t in TEXTS[:5]]
    inline = df.withColumn("o", tr.outcome(F.col("text"), stand_in(F.col("text")))).orderBy("doc_id").collect()
    assert [tuple(r.o) for r in inline] == want
    pieces = tr.chunks_of(df, 1000, ["doc_id"])
    sent = tr.translate_once(pieces, stand_in_batch, "English", "Spanish").orderBy("doc_id").collect()
    assert [(r.translated, r.status) for r in sent] == want


def test_each_distinct_text_is_sent_once(spark, tmp_path):
    calls = str(tmp_path)

    def counting(texts):
        import os
        import uuid

        with open(os.path.join(calls, uuid.uuid4().hex), "w") as out:
            json.dump(texts, out)
        return [t.upper() for t in texts]

    df = texts_df(spark, ["a b c", "d e f", "a b c", "   "] * 50)
    done = tr.translate_once(tr.chunks_of(df, 100, ["doc_id"]), counting, "English", "Spanish", max_tasks=2)
    assert done.count() == 200 and done.where("status = 'translated'").count() == 150
    sent = [t for f in tmp_path.iterdir() for t in json.loads(f.read_text())]
    assert sorted(sent) == ["a b c", "d e f"]


def test_rejoin_gives_back_what_inline_gives(spark):
    df = texts_df(spark, TEXTS)
    inline = {r.doc_id: tuple(r.o) for r in df.select("doc_id", tr.translate_inline(F.col("text"), stand_in, 100).alias("o")).collect()}
    pieces = tr.chunks_of(df, 100, ["doc_id"])
    done = tr.translate_once(pieces, stand_in_batch, "English", "Spanish")
    joined = {r.doc_id: (r.translated, r.n_chunks, r.n_failed) for r in assembly.rejoin(done, ["doc_id"]).collect()}
    for i, text in enumerate(TEXTS):
        if text.strip():
            assert inline[i] == joined[i]
        else:
            assert inline[i] == (text, 0, 0) and joined[i][0] == text
    assert inline[5][1] > 1


def test_identity_translator_keeps_the_words(spark):
    texts = ["w%d. and more words! yes? " % i * 30 for i in range(5)]
    df = texts_df(spark, texts)
    same = tr.translate_inline(F.col("text"), lambda c: c, 100)
    for r in df.select("text", same["text"].alias("out")).collect():
        assert r.out.split() == r.text.split()


def test_given_responses_fall_back_chunk_by_chunk(spark):
    pieces = tr.chunks_of(texts_df(spark, ["first", "second", "third"]), 100, ["doc_id"])
    responses = spark.createDataFrame([(0, 0, " primero "), (1, 0, " ")], "doc_id BIGINT, chunk_no INT, answer STRING")
    rows = tr.with_fallback(pieces, responses, ["doc_id", "chunk_no"]).orderBy("doc_id").collect()
    assert [(r.translated, r.status) for r in rows] == [("primero", "translated"), ("second", "empty"), ("third", "failed")]


def test_memory_leaves_only_unknown_requests(spark):
    key = tr.chunk_key(F.col("text"), "English", "Spanish", None)
    wanted = tr.distinct_requests(texts_df(spark, ["a", "b", "a", "c"]), key)
    known = tr.distinct_requests(texts_df(spark, ["b", "z"]), key)
    assert sorted((r.text, r.copies) for r in tr.missing_requests(wanted, known).collect()) == [("a", 2), ("c", 1)]


def test_key_depends_on_the_job(spark):
    jobs = [("English", "Spanish", None), ("English", "French", None), ("English", "Spanish", "m")]
    keys = spark.range(1).select(*[tr.chunk_key(F.lit("t"), *j).alias(str(i)) for i, j in enumerate(jobs)]).first()
    assert len(set(keys)) == 3


def test_attach_splits_a_heavy_key(spark):
    """A third of the rows share one key: nothing is lost, and the key meets its match in pieces."""
    facts = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    lookup = materialise(
        facts.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("v")).where("v % 7 <> 0 OR k = 'hot'"), "lookup"
    )
    plain = facts.join(lookup.drop("copies"), "k", "left")
    spread_out = attach(facts, lookup, "k", "copies", share=10)
    assert spread_out.exceptAll(plain.select(spread_out.columns)).count() == 0
    assert spread_out.count() == 30_000
    heavy = [l for l in spread_out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "broadcast" in l.lower()]
    assert heavy, "the table of splits is broadcast"


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    one, two = run_folder(spark, "x"), run_folder(spark, "x")
    assert one != two
    if named:
        assert one.startswith(named)


def test_requests_and_responses(spark):
    row = spark.range(1).select(chat.request_json(F.lit('say "hi"\n'), "m", "English", "Greek").alias("r")).first()
    body = json.loads(row.r)
    assert body["model"] == "m" and [m["role"] for m in body["messages"]] == ["system", "user"]
    assert "English" in body["messages"][0]["content"] and "Greek" in body["messages"][0]["content"]
    assert body["messages"][1]["content"].endswith('say "hi"\n')
    bodies = ['{"choices":[{"message":{"content":" hola \\n"}},{"message":{"content":"no"}}]}', '{"choices":[]}',
              '{"choices":[{"message":{"content":"  "}}]}', "gateway error", "", None, '{"choices":[{"message":{}}]}']
    df = spark.createDataFrame(list(enumerate(bodies)), "i INT, b STRING")
    got = [r.a for r in df.orderBy("i").select(chat.response_text(F.col("b")).alias("a")).collect()]
    assert got == ["hola"] + [None] * 6


def test_failures_can_be_observed_while_writing(spark):
    seen = Observation("run")
    pieces = tr.chunks_of(texts_df(spark, TEXTS[:5]), 100, ["doc_id"])
    done = tr.translate_once(pieces, stand_in_batch, "English", "Spanish")
    reports.observed(done, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_chunks": 5, "n_failed": 2}
    counts = {r.status: r.n for r in reports.outcome_report(done, []).collect()}
    assert counts == {"translated": 2, "failed": 1, "empty": 1, "blank": 1}


def test_a_call_that_raises_costs_only_its_own_texts(spark):
    def shaky(texts):
        if "bad" in texts:
            raise ConnectionError("gone")
        return [t.upper() for t in texts] if "short" not in texts else []

    df = texts_df(spark, ["good", "bad", "short", "fine"]).withColumnRenamed("doc_id", "copies")
    requests = df.select(F.col("text").alias("chunk_key"), "text", "copies")
    rows = {r.text: r for r in tr.ask(requests, shaky, per_call=1).collect()}
    assert {t: r.answer for t, r in rows.items()} == {"good": "GOOD", "bad": None, "short": None, "fine": "FINE"}
    assert "gone" in rows["bad"].error and "0 answers" in rows["short"].error and rows["good"].error is None


def test_memory_answers_are_not_sent_again(spark):
    def refuse(texts):
        raise AssertionError(texts)

    def chunks(texts):
        return tr.chunks_of(texts_df(spark, texts), 100, ["doc_id"])

    key = tr.chunk_key(F.col("text"), "English", "Spanish", None)
    first = tr.answered(tr.distinct_requests(chunks(["one", "two", "x" * 17]), key), stand_in_batch)
    again = tr.translate_once(chunks(["two", "one", "one", "new", "x" * 17]), refuse, "English", "Spanish", memory=first)
    got = [(r.translated, r.status) for r in again.orderBy("doc_id").collect()]
    assert got == [final("two"), final("one"), final("one"), ("new", "failed"), ("x" * 17, "failed")]


def test_a_memory_with_repeated_keys_multiplies_nothing(spark):
    pieces = tr.chunks_of(texts_df(spark, ["same text"] * 4), 100, ["doc_id"])
    key = tr.chunk_key(F.lit("same text"), "English", "Spanish", None)
    memory = spark.range(2).select(key.alias("chunk_key"), F.concat(F.lit("v"), F.col("id")).alias("translated"), F.lit("translated").alias("status"))
    done = tr.translate_once(pieces, lambda texts: ["never"] * len(texts), "English", "Spanish", memory=memory)
    assert [r.translated for r in done.collect()] == ["v0"] * 4


def test_a_job_that_broke_off_sends_only_what_is_missing(spark, tmp_path):
    sent_at, answers = tmp_path / "sent", str(tmp_path / "answers")
    sent_at.mkdir()

    def service(texts, broken=False):
        import uuid

        if broken and len(list(sent_at.iterdir())) >= 2:
            raise SystemExit("the worker is gone")
        (sent_at / uuid.uuid4().hex).write_text(json.dumps(list(texts)))
        return [t.upper() for t in texts]

    texts = [f"text number {i}" for i in range(60)]
    requests = tr.distinct_requests(texts_df(spark, texts), tr.chunk_key(F.col("text"), "English", "Spanish", None)).coalesce(1)
    settings = {"max_tasks": 1, "answers_at": answers, "per_commit": 12}
    try:
        tr.answered(requests, lambda t: service(t, broken=True), **settings)
        raise AssertionError("the first run must fail")
    except Exception as failure:
        assert "first run must fail" not in str(failure)
    done = tr.answered(requests, service, **settings)
    assert {r.translated for r in done.collect()} == {t.upper() for t in texts}
    sent = [t for f in sent_at.iterdir() for t in json.loads(f.read_text())]
    assert sorted(sent) == sorted(texts), "each text is sent once over both runs"


def test_causes_of_failures_are_reported(spark):
    pieces = tr.chunks_of(texts_df(spark, TEXTS[:5]), 1000, ["doc_id"])
    done = tr.translate_once(pieces, stand_in_batch, "English", "Spanish")
    found = {(r.status, r.cause): r.n for r in reports.outcome_causes(done, []).collect()}
    assert found == {("translated", None): 2, ("failed", "RuntimeError"): 1, ("empty", None): 1, ("blank", None): 1}


def test_requests_wait_for_buckets_only_where_answers_are_kept(spark, tmp_path, monkeypatch):
    calls = []
    ask = tr.ask
    monkeypatch.setattr(tr, "ask", lambda part, *a: calls.append(len(part.inputFiles())) or ask(part, *a))
    requests = tr.distinct_requests(texts_df(spark, [f"text {i}" for i in range(400)]), tr.chunk_key(F.col("text"), "a", "b", None))
    upper = lambda texts: [t.upper() for t in texts]
    assert tr.answered(requests, upper, per_commit=100).where("status = 'translated'").count() == 400
    assert len(calls) == 1, "nothing could be taken up again: one job on all cores"
    calls.clear()
    assert tr.answered(requests, upper, per_commit=100, answers_at=str(tmp_path / "answers")).count() == 400
    cores = spark.sparkContext.defaultParallelism
    assert len(calls) == 4 and all(n >= cores for n in calls), "every core has its part of a bucket"


def test_requests_that_go_out_once_are_not_written_before(spark, monkeypatch):
    labels, write = [], tr.materialise
    monkeypatch.setattr(tr, "materialise", lambda df, label: labels.append(label) or write(df, label))
    chunks = spark.createDataFrame([(i, 0, f"text {i % 3}") for i in range(9)], "doc_id LONG, chunk_no INT, text STRING")
    done = tr.translate_once(chunks, lambda texts: [t.upper() for t in texts], "English", "Spanish")
    assert {(r.doc_id, r.translated, r.status) for r in done.collect()} == {(i, f"TEXT {i % 3}", "translated") for i in range(9)}
    assert labels == ["chunks", "answers"]


def test_stand_in_as_a_service_answers_like_the_column(spark):
    texts = ["", "aeiou0 AEIOU", "über ñandú 0 a\u0301", "e" * 17, "o" * 18, "漢字 a 😀", " i "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    column = [r.a for r in rows.select("i", stand_in(F.col("text")).alias("a")).orderBy("i").collect()]
    assert [a if isinstance(a, str) else None for a in stand_in_batch(texts)] == column
