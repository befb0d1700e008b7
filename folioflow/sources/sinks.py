"""Result tables, event lines and dataset compaction."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.text import strip
from folioflow.operators.reports import with_sizes
from folioflow.operators.shared import delete, exists, file_system
from folioflow.schemas import PROGRESS_EVENT

log = logging.getLogger(__name__)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = file_system(spark, old)
    if not fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"could not rename {old} to {new}")


def write_translated(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """One folder per target language. Every task writes its own files: no shuffle, so a
    language that makes up most of the corpus is written by all tasks."""
    if overwrite and exists(df.sparkSession, path):
        log.warning("overwriting %s", path)
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("target_lang").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines; fields that are null are left out."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines back to rows; blank lines are skipped, an unfinished last line is read."""
    return spark.read.schema(PROGRESS_EVENT).json(path)


BLOCK_FRAGMENTS = 1000  # fragments whose ends are looked at together


def lines_of(fragments: DataFrame) -> DataFrame:
    """``stream, seq, line_no, line``: the lines of ``fragments(stream, seq, data)``, wherever they were cut.

    ``data`` are bytes, cut at any of them, also within a character. A line belongs to the fragment it
    begins in. What a fragment holds behind its last line end is the beginning of a line; the next
    fragment of the stream with a line end has its end, those between its middle. Which fragment that
    is comes from two small scans, within blocks of ``BLOCK_FRAGMENTS`` numbers and over the blocks of a
    stream, so neither a stream's bytes nor all its fragments meet in one task; pieces then meet by
    line. A fragment that comes twice is read once, blank lines are left out, and an unfinished last
    line is read. Numbers need not be without gaps; fragments without stream or number are left out.
    """
    known = fragments.where("stream IS NOT NULL AND seq IS NOT NULL")
    once = known.groupBy("stream", "seq").agg(F.min("data").alias("data"))
    # bytes as characters: nothing is lost where a cut lies within a character
    pieces = F.split(F.decode(F.coalesce("data", F.lit(b"")), "ISO-8859-1"), "\n", -1)
    cut = once.select("stream", "seq", F.floor(F.col("seq") / BLOCK_FRAGMENTS).alias("block"), pieces.alias("pieces"))
    ending = F.when(F.size("pieces") > 1, F.col("seq"))
    ends = cut.select("stream", "seq", "block", ending.alias("ending"))
    within = Window.partitionBy("stream", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ends.groupBy("stream", "block").agg(F.max("ending").alias("last"), F.min("seq").alias("first"))
    far = blocks.select("stream", "block", F.max("last").over(over).alias("far"), F.min("first").over(Window.partitionBy("stream")).alias("begin"))
    near = ends.withColumn("near", F.max("ending").over(within)).join(far, ["stream", "block"])
    opened = near.select("stream", "seq", F.coalesce("near", "far").alias("open"), "begin")
    each = cut.join(opened, ["stream", "seq"]).select(
        "stream", "seq", "open", "begin", (F.size("pieces") - 1).alias("last"), F.posexplode("pieces").alias("at", "piece"))
    inner = (F.col("at") > 0) & (F.col("at") < F.col("last"))
    whole = each.where(inner).select("stream", "seq", F.col("at").alias("line_no"), F.col("piece").alias("line"))
    # a first piece ends the line that is open, or the stream's first one; the last of several begins a line
    ends_line = F.col("at") == 0
    parts = each.where(~inner).select(
        "stream", F.when(ends_line, F.coalesce("open", "begin")).otherwise(F.col("seq")).alias("owner"),
        (ends_line & F.col("open").isNull()).alias("first"), F.when(~ends_line, F.col("at")).alias("no"), F.col("seq").alias("part"), "piece")
    joined = parts.groupBy("stream", "owner", "first").agg(
        F.coalesce(F.max("no"), F.lit(0)).alias("line_no"),
        F.array_join(F.array_sort(F.collect_list(F.struct("part", "piece")))["piece"], "").alias("line"))
    rest = joined.select("stream", F.col("owner").alias("seq"), "line_no", "line")
    lines = whole.unionByName(rest).withColumn("line", strip(F.decode(F.encode("line", "ISO-8859-1"), "UTF-8")))
    return lines.where("line <> ''")


def events_of(fragments: DataFrame) -> DataFrame:
    """Events of fragments, one row per line, with the place where the line begins."""
    return lines_of(fragments).select("stream", "seq", "line_no", F.from_json("line", PROGRESS_EVENT).alias("e")).select("stream", "seq", "line_no", "e.*")


def dataset_bytes(spark: SparkSession, path: str) -> int:
    """Size of a dataset from its file listing; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def compacted_path(path: str, suffix: str = "_compressed") -> str:
    folder, slash, name = path.rstrip("/").rpartition("/")
    stem, dot, extension = name.rpartition(".")
    return folder + slash + (f"{stem}{suffix}{dot}{extension}" if stem else f"{name}{suffix}")


def _partition_columns(df: DataFrame) -> list[str]:
    """Columns a dataset keeps in its folder names."""
    plan = df._jdf.queryExecution().analyzed()
    return list(plan.relation().partitionSchema().fieldNames())


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """All files of a Parquet dataset with the union of their columns; folder names stay as they are."""
    setting = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "false")  # 007 must not become 7
        return spark.read.option("mergeSchema", "true").parquet(path)
    finally:
        spark.conf.set(setting, before)


def compact_dataset(
    spark: SparkSession, path: str, target: str | None = None, replace: bool = False, codec: str = "zstd",
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Rewrite a Parquet dataset with a stronger codec into fewer files and report the sizes.

    Columns of all files and partition folders are kept. With ``replace`` the copy takes the
    place of the original by two renames, once its rows are counted; where one of them fails, the
    original is put back. It is deleted last. If the driver dies between the two, the original is
    at ``….old`` and nothing at its path: the next run puts it back before it starts.
    """
    old = compacted_path(path, ".old")
    if replace and not exists(spark, path) and exists(spark, old):
        log.warning("%s was left by a run that broke off", old)
        _rename(spark, old, path)
    before = dataset_bytes(spark, path)
    out = compacted_path(path, ".tmp") if replace else target or compacted_path(path)
    source = _whole(spark, path)
    folders = _partition_columns(source)
    if folders:
        # even parts: a folder that holds most of the rows is written by many tasks
        even = source.hint("rebalance", *folders)
    else:
        even = source.coalesce(max(1, -(-before // file_bytes)))
    try:
        even.write.mode("overwrite").option("compression", codec).partitionBy(*folders).parquet(out)
        copied, kept = _whole(spark, out).count(), source.count()
        if copied != kept:
            raise OSError(f"the copy has {copied} rows, the original {kept}")
    except Exception:
        if replace and exists(spark, out):
            delete(spark, out)
        raise
    after = dataset_bytes(spark, out)
    if replace:
        if exists(spark, old):  # a run that broke off before its last step
            delete(spark, old)
        _rename(spark, path, old)
        try:
            _rename(spark, out, path)
        except Exception:
            _rename(spark, old, path)
            delete(spark, out)
            raise
        delete(spark, old)
        out = path
    sizes = spark.range(1).select(
        F.lit(out).alias("path"), F.lit(before).cast("bigint").alias("in_bytes"), F.lit(after).cast("bigint").alias("out_bytes")
    )
    return with_sizes(sizes)
