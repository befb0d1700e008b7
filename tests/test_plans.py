"""Plans, not results: what shuffles, what is broadcast, and what reaches the scan."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioflow.config import TRANSLATE_QUOTAS, TranslationConfig
from folioflow.operators import admission, assembly, edits, quota, reports
from folioflow.operators import layout as lay
from folioflow.operators import translation as tr
from folioflow.operators.shared import attach, materialise, spread
from folioflow.plans import inputs
from folioflow.plans.corpus import translate_pages
from folioflow.schemas import DOCUMENTS, LAYOUT

CONFIG = TranslationConfig("English", "Spanish")


@pytest.fixture(scope="module")
def layout(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "t")
    inputs.layout(spark, sf_dir).write.parquet(path)
    return spark.read.schema(LAYOUT).parquet(path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange SinglePartition") + plan(df).count("Exchange RoundRobin")


@pytest.mark.parametrize("job", [
    lay.spans_of, lay.text_blocks, lay.blank_pages, lay.page_counts, reports.page_progress,
    lambda df: lay.routed_blocks(lay.text_blocks(df), [1]),
    lambda df: lay.block_batches(lay.text_blocks(df), 10),
    lambda df: translate_pages(df, CONFIG, column=inputs.stand_in),
    lambda df: tr.chunks_of(lay.text_blocks(df), 1000, lay.BLOCK_KEY),
    lambda df: edits.edit_plan(edits.translated_blocks(lay.text_blocks(df), CONFIG, inputs.stand_in), CONFIG, ["helvetica"]),
])
def test_narrow_jobs_do_not_shuffle(layout, job):
    found = plan(job(layout))
    assert "Exchange" not in found and "Join" not in found
    assert "PythonUDF" not in found and "InPandas" not in found


def test_admission_does_not_shuffle(spark, sf_dir):
    jobs = inputs.admission_jobs(inputs.table(spark, sf_dir, "pages"))
    assert "Exchange" not in plan(admission.with_verdict(jobs, inputs.JOB_RULES))


def test_documents_take_one_shuffle(layout):
    assert shuffles(assembly.documents_of(assembly.translated_pages(layout, CONFIG, inputs.stand_in))) == 1
    assert shuffles(lay.fold_spans(lay.spans_of(layout))) == 1


def test_generators_do_not_repeat_their_input(layout):
    found = lay.text_blocks(layout)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(line.strip(" +-:").startswith("Filter") and "array_join" in line for line in found.split("\n"))


def test_progress_reads_two_numbers_per_page(layout):
    assert "ReadSchema: struct<doc_id:bigint,page_num:int,n_pages:int>" in plan(reports.page_progress(layout))


def test_answers_come_back_without_the_chunk_texts(spark, sf_dir):
    docs = spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")
    done = tr.translate_once(tr.chunks_of(docs, 1000, ["doc_id"]), inputs.stand_in_batch, "English", "Spanish")
    found = plan(done)
    assert "ReadSchema: struct<doc_id:bigint,chunk_no:int,chunk_key:string>" in found
    assert "InPandas" not in found, "answers are read from disk"


def test_only_the_table_of_heavy_keys_is_broadcast_by_hint(spark):
    facts = materialise(spark.range(5_000).select("id", (F.col("id") % 7).cast("string").alias("k")), "facts")
    lookup = materialise(facts.groupBy("k").agg(F.count(F.lit(1)).alias("copies")), "lookup")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = attach(facts, lookup, "k", "copies")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count("SortMergeJoin") == 1 and found.count("BroadcastHashJoin") == 2


def test_quota_limits_rows_before_the_shuffle(spark, sf_dir):
    events = quota.arrivals(inputs.table(spark, sf_dir, "events"), "event_type")
    found = plan(quota.admitted(events, TRANSLATE_QUOTAS))
    assert found.count("WindowGroupLimit") >= 3
    assert found.rindex("Partial") > found.index("Exchange hashpartitioning")
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in found


def test_only_small_inputs_are_spread(spark):
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 50)
    assert spread(many) is many
