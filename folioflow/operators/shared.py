"""Helpers that keep jobs whole and even on a cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
    return spark.sparkContext.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """The store a path belongs to, and the path as that store knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write on the way are removed at the end of the block, also after a failure.

    Whatever depends on them has to be written within the block.
    """
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            delete(spark, path)


def run_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    made = _scratch.get()
    if made is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts the lineage and survives the loss of executors.

    Used for results that are expensive or not repeatable, such as answers of a translator.
    """
    spark = df.sparkSession
    target = run_folder(spark, label)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that the optimiser knows to be empty: joins with it fall away, and no Python worker starts for it."""
    return spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has cores.

    Large inputs have far more splits than cores and are left as they are. Rows are the same
    either way; the number of splits is known once the scan is planned.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def attach(facts: DataFrame, lookup: DataFrame, key: str, weight: str, share: int | None = None) -> DataFrame:
    """Left join on ``key`` that stays even when one key carries a large part of ``facts``.

    ``lookup`` has one row per key and must be a written table; ``weight`` is the number
    of fact rows with that key. A key with more than 1/``share`` of all fact rows is split
    into pieces of at most that size. Fewer than ``share`` keys can be that heavy, so the
    table of splits that is broadcast has fewer than ``share`` rows of (key, number). By
    default a piece is at most a quarter of an even shuffle partition.
    """
    if share is None:
        share = max(1000, 4 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = lookup.agg(F.sum(weight)).scalar()
    heavy = lookup.where(F.col(weight) * share > total).select(
        key, F.ceil(F.col(weight) * share / total).cast("int").alias("pieces")
    )
    pieces = F.coalesce("pieces", F.lit(1))
    # hash of the row, not rand(): a task that is run again must give the same rows
    row_hash = F.xxhash64(*[F.col(c) for c in facts.columns])
    left = (
        facts.join(F.broadcast(heavy), key, "left")
        .withColumn("piece", F.pmod(row_hash, pieces.cast("bigint")).cast("int"))
        .drop("pieces")
    )
    right = (
        lookup.join(F.broadcast(heavy), key, "left")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .drop("pieces", weight)
    )
    return left.join(right, [key, "piece"], "left").drop("piece")
