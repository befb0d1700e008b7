"""What the operators of this subpackage share: table access, tokens, hashes, compact arrays."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word rules: space and U+0009 to U+000D. bytes.split() uses the same set.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """``ARRAY<STRING>`` of the maximal runs without white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def fold(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; a null id counts as the text ``""``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def lowered_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lowered words of all texts, one after the other, and where each text begins.

    n different words share a hash with odds of n * n / 2**65.
    """
    split = [lowered_words(t) for t in texts]
    starts = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(ws) for ws in split], out=starts[1:])
    hashes = np.empty(int(starts[-1]), np.uint64)
    for ws, at in zip(split, starts.tolist()):
        hashes[at:at + len(ws)] = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    return hashes, starts


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k:k + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


_kept: dict[str, dict] = {}


def kept(owner: str, key, make: Callable):
    """A value that the tasks of a worker share, made at first use, until other work comes to that worker."""
    mine = _kept.setdefault(owner, {})
    if key not in mine:
        mine[key] = make()
    return mine[key]


def make_room(owner: str) -> None:
    """Drop what work of other owners left in this worker: workers live on from job to job."""
    others = [o for o in _kept if o != owner]
    for other in others:
        del _kept[other]
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Hand memory that is free within this worker to the system: workers wait for other jobs, or beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others do so by themselves
    if trim is not None:
        trim(0)


BATCH_ROWS = 1_000


def in_arrow(rows: DataFrame, work, schema) -> DataFrame:
    """``rows.mapInArrow(work, schema)`` in batches of at most ``BATCH_ROWS`` rows.

    Spark bounds a batch by rows only, and both sides hold whole batches of texts: the session's setting
    is lowered, never raised. Before ``work`` a worker drops what work of other modules has ``kept``, after it
    the worker gives back what is free.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    owner = work.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        try:
            yield from work(batches)
        finally:
            give_back()

    return rows.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int, weight: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has at most ``rows`` rows and about ``most`` bytes of ``weight``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(weight)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for at, size in enumerate(sizes.tolist()):
            if at > start and (at - start >= rows or held + size > most):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


FILTER_BITS = 24  # power of two: a filter has 2 MB, whatever goes into it
MOST_FILTER_BITS = 26


def filter_bits(seeds: int) -> int | None:
    """Bits of a filter that lets through about one key in sixteen beside its seeds; None beyond 8 MB."""
    bits = max(16, (16 * seeds).bit_length())
    return bits if bits <= MOST_FILTER_BITS else None


def seed_filter(seeds: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of the low bits of ``seeds(seed BIGINT)``: at most ``2**bits / 64`` pairs of numbers reach the driver.

    Sorts out most of what is not among the seeds and nothing that is; a full bitmap sorts out less.
    """
    slot = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    words = seeds.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(seed & 63 AS INT))")).alias("mask")
    ).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def in_filter(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` may be among a filter's seeds."""
    slot = keys & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """A compact form of an integer array: its bytes regrouped by significance and compressed."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize
    return zlib.compress(values.view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpacked(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    flat = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).view(dtype).ravel()
