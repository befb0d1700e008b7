from __future__ import annotations

import random
from collections import Counter
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.config import TRANSLATE_QUOTAS, Quota
from folioflow.operators import quota, reports
from folioflow.operators import translation as tr
from folioflow.plans import inputs
from folioflow.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The tables in several files, events in order of time."""
    root = tmp_path_factory.mktemp("parts")
    for name, schema, order, cut in (
        ("events", schemas.EVENTS, "ts", 250), ("documents", schemas.DOCUMENTS, "doc_id", 50), ("pages", schemas.PAGES, "page_id", 20),
    ):
        rows = spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet").orderBy(order, schema.names[0]).toPandas()
        for n, at in enumerate(range(0, len(rows), cut)):
            part = spark.createDataFrame(rows[at:at + cut], schema).coalesce(1)
            part.write.mode("append").parquet(str(root / name))
    return root


def arriving(spark, parts, name):
    return jobs.arriving(spark, str(parts / name), getattr(schemas, name.upper()), files_per_batch=1)


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def test_intake(spark, parts, sf_dir, tmp_path):
    from folioflow.plans.queries import admit

    jobs.start_intake(inputs.admission_jobs(arriving(spark, parts, "pages")), inputs.JOB_RULES, str(tmp_path)).awaitTermination()
    assert same(spark.read.parquet(f"{tmp_path}/out"), admit(spark, sf_dir))


def test_progress(spark, parts, sf_dir, tmp_path):
    jobs.start_progress(inputs.layout_of(arriving(spark, parts, "documents")), str(tmp_path)).awaitTermination()
    out = spark.read.schema("doc_id BIGINT, page INT, total INT, percent INT").json(f"{tmp_path}/out")
    assert same(out, reports.page_progress(inputs.layout(spark, sf_dir)))


def test_translation_memory(spark, parts, sf_dir, tmp_path):
    def run():
        jobs.start_translation(
            arriving(spark, parts, "documents"), inputs.stand_in_batch, "English", "Spanish", 1000, str(tmp_path)
        ).awaitTermination()
        return jobs.read_memory(spark, str(tmp_path))

    memory = run()
    assert len(jobs.memory_of(spark, str(tmp_path)).segments()) > 1
    key = tr.chunk_key(F.col("text"), "English", "Spanish", None)
    pieces = tr.chunks_of(inputs.documents(spark, sf_dir, "doc_id", "text"), 1000, ["doc_id"])
    want = pieces.select(key.alias("chunk_key"), tr.outcome(F.col("text"), inputs.stand_in(F.col("text")))["text"].alias("translated"))
    assert same(memory.select("chunk_key", "translated"), want.distinct())
    assert same(memory.select("chunk_key", "copies"), want.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("copies"))), "copies of all batches"
    before = memory.count()
    assert run().count() == before, "a restart without new files adds nothing"


def test_quota_over_batches(spark, parts, sf_dir, tmp_path):
    """All arrivals under one client, so that both limits are exceeded and counts cross batches."""
    def one_client(df):
        return df.select("event_id", F.lit("all").alias("client"), F.col("ts").cast("timestamp").alias("ts"))

    jobs.start_quota(one_client(arriving(spark, parts, "events")), TRANSLATE_QUOTAS, str(tmp_path)).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/verdicts")
    assert got.select("batch_id").distinct().count() > 2
    want = quota.with_verdicts(one_client(spark.read.parquet(f"{sf_dir}/events.parquet")), TRANSLATE_QUOTAS)
    assert want.where("NOT allowed").count() > 100
    assert same(got.drop("batch_id", "late"), want)


def _run_quota(spark, tmp_path, waves, clocks, quotas, **settings):
    """Arrivals ``(event_id, client, ts)`` in waves, each at its own time of the clock."""
    source = tmp_path / "in"
    for n, (wave, at) in enumerate(zip(waves, clocks)):
        df = spark.createDataFrame(wave, "event_id BIGINT, client STRING, ts STRING").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(str(source / f"n={n}"))
        stream = spark.readStream.schema("event_id BIGINT, client STRING, ts TIMESTAMP, n INT").parquet(str(source)).drop("n")
        jobs.start_quota(stream, quotas, str(tmp_path / "q"), clock=lambda at=at: at, **settings).awaitTermination()
    return {r["event_id"]: r for r in spark.read.parquet(f"{tmp_path}/q/verdicts").collect()}


def test_one_future_arrival_changes_nothing(spark, tmp_path):
    day = [(i, "c", f"2024-03-01 10:{i:02d}:00") for i in range(20)]
    waves = [day[:8], [(99, "c", "2031-01-01 00:00:00")], day[8:]]
    got = _run_quota(spark, tmp_path, waves, [datetime(2024, 3, 1, 11, tzinfo=UTC)] * 3, TRANSLATE_QUOTAS[:1])
    assert sorted(i for i, r in got.items() if r["allowed"]) == [0, 1, 2, 3, 4, 99]
    assert not any(r["late"] for r in got.values())


def test_arrivals_of_a_retired_period_get_no_fresh_quota(spark, tmp_path):
    waves = [
        [(i, "c", "2024-03-01 10:00:00") for i in range(6)],
        [(10, "c", "2024-03-06 10:00:00"), (11, "c", "2031-01-01 00:00:00")],
        [(20, "c", "2024-03-01 10:30:00"), (21, "c", "2024-03-06 10:30:00"), (22, "d", "2024-03-07 09:00:00")],
    ]
    clocks = [datetime(2024, 3, d, 12, tzinfo=UTC) for d in (1, 6, 7)]
    got = _run_quota(spark, tmp_path, waves, clocks, TRANSLATE_QUOTAS[:1], keep_days=2)
    assert (got[20]["late"], got[20]["allowed"]) == (True, False)
    assert got[21]["allowed"] and got[22]["allowed"] and got[11]["allowed"]
    folders = sorted(p.name for p in (tmp_path / "q" / "counts").iterdir() if p.is_dir())
    assert folders == ["batch_id=1", "batch_id=2"], "older counts are removed"


def test_arrivals_without_client_are_a_client_of_their_own(spark, tmp_path):
    waves = [[(0, None, "2024-03-01 10:00:00")], [(1, "b", "2024-03-01 10:01:00"), (2, None, "2024-03-01 10:02:00"), (3, None, "2024-03-01 10:03:00")]]
    got = _run_quota(spark, tmp_path, waves, [datetime(2024, 3, 1, 11, tzinfo=UTC)] * 2, (Quota("hour", 2),))
    assert {i: (r["allowed"], r["late"]) for i, r in got.items()} == {0: (True, False), 1: (True, False), 2: (True, False), 3: (False, False)}


def test_random_batches_get_the_verdicts_of_the_batch_job(spark, tmp_path):
    """Clients with and without name, periods in the past and in the future, in three waves."""
    rng = random.Random(7)
    hours = ["2024-03-01 09", "2024-03-01 10", "2024-03-01 11", "2031-01-01 00"]
    rows = [(i, rng.choice(["a", "b", None]), f"{rng.choice(hours)}:{i % 60:02d}:00") for i in range(90)]
    quotas = (Quota("hour", 3), Quota("day", 8))
    waves = [sorted(rows[at:at + 30], key=lambda r: (r[2], r[0])) for at in range(0, 90, 30)]
    got = _run_quota(spark, tmp_path, waves, [datetime(2024, 3, 1, 12, tzinfo=UTC)] * 3, quotas)
    seen, want = Counter(), {}
    for wave in waves:  # in the stream, arrivals are ranked in order of the batches
        for i, client, ts in wave:
            keys = [("hour", client, ts[:13]), ("day", client, ts[:10])]
            want[i] = all(seen[k] < q.limit for k, q in zip(keys, quotas))
            seen.update(keys)
    assert {i: r["allowed"] for i, r in got.items()} == want and not any(r["late"] for r in got.values())


def test_listener_reports_batches(spark, parts, tmp_path):
    import time

    seen = []
    listener = jobs.BatchProgress(lambda batch, rows: seen.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        jobs.start_progress(inputs.layout_of(arriving(spark, parts, "documents")), str(tmp_path), availableNow=True).awaitTermination()
        for _ in range(50):
            if sum(rows for _, rows in seen) >= 200:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(rows for _, rows in seen) == 200 and len(seen) >= 4


def test_over_limit_periods(spark, parts, tmp_path):
    """Every arrival counts, and open periods are reported too."""
    one = arriving(spark, parts, "events").select("event_id", F.lit("all").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.start_over_limit(one, TRANSLATE_QUOTAS[1], str(tmp_path)).awaitTermination()
    got = jobs.read_over_limit(spark, str(tmp_path), TRANSLATE_QUOTAS[1])
    events = spark.read.parquet(str(parts / "events")).select(F.col("ts").cast("timestamp").alias("ts"))
    days = events.groupBy(F.date_trunc("day", "ts").alias("period")).agg(F.count(F.lit(1)).alias("n")).where("n > 20")
    assert days.count() > 5 and same(got.select("period", "n"), days)




def test_answers_go_straight_to_the_folders_of_the_memory(spark, tmp_path, monkeypatch):
    from folioflow.sources import keyed

    labels, write = [], keyed.materialise
    monkeypatch.setattr(keyed, "materialise", lambda df, label: labels.append(label) or write(df, label))
    folder = str(tmp_path / "memory")
    schema = "doc_id BIGINT, text STRING"
    for part, texts in enumerate([[f"text {i}" for i in range(1500)], [f"text {i}" for i in range(1000, 2600)]]):
        spark.createDataFrame(list(enumerate(texts)), schema).write.parquet(str(tmp_path / "in" / f"part-{part}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.start_translation(stream, lambda ts: [t.upper() for t in ts], "English", "Spanish", 100, folder).awaitTermination()
    rows = {r.translated: r.copies for r in jobs.read_memory(spark, folder).collect()}
    assert rows == {f"TEXT {i}": 2 if 1000 <= i < 1500 else 1 for i in range(2600)}
    assert labels == []
    files = [p.parent for p in (tmp_path / "memory" / "memory").rglob("*.parquet")]
    assert len(files) <= 2 * len(set(files)), "answers and copies, a file of each in a folder"
