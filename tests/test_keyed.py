from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.operators.shared import scratch
from folioflow.sources.keyed import MARKER, KeyedTable
from folioflow.streaming.jobs import MEMORY


def table(spark, path, **settings):
    return KeyedTable(spark, str(path), MEMORY, "chunk_key", add=["copies"], **settings)


def rows(spark, first, last, text="a", status="translated"):
    return spark.range(first, last).select(
        F.sha2(F.col("id").cast("string"), 256).alias("chunk_key"), F.lit(1).cast("bigint").alias("copies"),
        F.lit(text).cast("string").alias("translated"), F.lit(status).cast("string").alias("status"))


def bytes_below(folders):
    return sum(f.stat().st_size for folder in folders for f in Path(folder).rglob("*.parquet"))


def test_what_a_batch_reads_follows_the_batch(spark, tmp_path):
    """Ten batches of 2,000 new keys; each then asks for 20 keys, old and new."""
    memory = table(spark, tmp_path, rows_per_folder=8, most_digits=3, fan_in=4)
    read, size = [], []
    for n in range(10):
        memory.write(rows(spark, n * 2_000, (n + 1) * 2_000), n)
        asked = rows(spark, n * 2_000 - 10, n * 2_000 + 10).select("chunk_key")
        assert memory.lookup(asked).count() == (10 if n == 0 else 20)
        read.append(bytes_below(memory.folders_of(asked)))
        size.append(bytes_below([s[4] for s in memory.segments()]))
    assert size[9] > 4 * size[0]
    assert read[9] < 0.1 * size[9] and max(read) < 8 * min(read)
    assert len(memory.segments()) < 10 and memory.read().count() == 20_000


def test_newest_answer_counts_and_copies_add_up(spark, tmp_path):
    memory = table(spark, tmp_path, fan_in=2, keep=0)
    memory.write(rows(spark, 0, 4, "old"), 0)
    memory.write(rows(spark, 2, 6, "new"), 1)
    memory.write(rows(spark, 0, 1, None, None), 2)
    for _ in range(2):
        got = {(r["translated"], r["copies"]): r["n"] for r in memory.read().groupBy("translated", "copies").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == {("old", 2): 1, ("old", 1): 1, ("new", 2): 2, ("new", 1): 2}
        memory.write(rows(spark, 0, 0), 3)
    assert max(s[0] for s in memory.segments()) > 0, "segments were merged"


def test_a_batch_is_written_once_and_broken_writes_do_not_count(spark, tmp_path):
    memory = table(spark, tmp_path)
    memory.write(rows(spark, 0, 5), 0)
    memory.write(rows(spark, 0, 50), 0)
    assert memory.read().count() == 5 and memory.holds(0) and not memory.holds(1)
    rows(spark, 5, 9).withColumn("batch_id", F.lit(1)).write.parquet(f"{tmp_path}/t0-1-1-d0")
    assert memory.read().count() == 5 and not memory.holds(1)
    memory.write(rows(spark, 5, 7), 1)
    assert memory.read().count() == 7


def test_a_merge_that_broke_off_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    memory = table(spark, tmp_path, fan_in=3, keep=0)
    write = memory._write

    def fails(frame, tier, first, last):
        if tier:
            frame.write.parquet(f"{tmp_path}/t{tier}-{first}-{last}-d0")  # no marker
            raise OSError("lost")
        write(frame, tier, first, last)

    monkeypatch.setattr(memory, "_write", fails)
    for n in range(2):
        memory.write(rows(spark, n, n + 2), n)
    with pytest.raises(OSError):
        memory.write(rows(spark, 2, 4), 2)
    monkeypatch.undo()
    assert memory.holds(2) and memory.read().agg(F.sum("copies")).first()[0] == 6
    memory.write(rows(spark, 0, 0), 3)
    assert memory.read().agg(F.sum("copies")).first()[0] == 6
    assert [s[:3] for s in memory.segments()][-1] == (1, 0, 3) or any(s[0] == 1 for s in memory.segments())
    memory.write(rows(spark, 0, 0), 4)
    left = [p for p in tmp_path.iterdir() if p.is_dir()]
    assert all((p / MARKER).exists() for p in left)


def test_null_and_unknown_keys(spark, tmp_path):
    memory = table(spark, tmp_path, rows_per_folder=1)
    keys = spark.createDataFrame([(None,), ("nobody",)], "chunk_key STRING")
    assert memory.lookup(keys).count() == 0 and memory.folders_of(keys) == []
    memory.write(rows(spark, 0, 100), 0)
    assert memory.lookup(keys).count() == 0 and len(memory.folders_of(keys)) <= 1


def test_scratch_tables_go_also_after_a_failure(spark):
    from folioflow.operators.shared import exists, materialise

    paths = []
    with pytest.raises(RuntimeError), scratch(spark):
        made = materialise(spark.range(3), "mine")
        paths.append(made.inputFiles()[0])
        raise RuntimeError
    assert not exists(spark, paths[0])
    kept = materialise(spark.range(3), "kept")
    assert exists(spark, kept.inputFiles()[0])


def test_folders_of_a_segment_are_written_by_several_tasks(spark, tmp_path):
    """Small rows in many folders: merged by bytes, one task would write all files."""
    memory = table(spark, tmp_path, rows_per_folder=8, most_digits=2)
    memory.write(rows(spark, 0, 2_000), 0)
    n = memory.digits_for(2_000)
    memory.write(memory.dealt(rows(spark, 2_000, 4_000), 2_000), 1, 2_000)
    for batch in (0, 1):
        files = list((tmp_path / f"t0-{batch}-{batch}-d{n}").rglob("part-*.parquet"))
        assert len({f.parent for f in files}) == len(files) == 256, "a folder is one file"
        assert len({f.name.split("-")[1] for f in files}) >= spark.sparkContext.defaultParallelism
    assert memory.read().count() == 4_000


def test_no_python_worker_for_an_empty_lookup(spark, tmp_path):
    found = table(spark, tmp_path).lookup(rows(spark, 0, 9).select("chunk_key"))
    assert found.count() == 0 and "LocalTableScan <empty>" in found._jdf.queryExecution().toString()
