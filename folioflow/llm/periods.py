"""Periodic runs of words: stretches that repeat a pattern of q words at least three times.

A run is a stretch of at least ``max(LEAST, 3 * q)`` words with smallest period *q* that no
neighbouring word extends. Collapsing a text keeps the first *q* words of every run.

Scale tiles: the periods ``[2**k, 2**(k+1))`` of octave *k* are looked for in tiles of three steps of
``D = 2**(k+1)`` words around the boundaries 0, D, 2D, …: from one step before to two steps behind.
A run of the octave has a boundary at least *q* words before its end. For each period, Z-functions of
the tile's two sides say how far the words left and right of the boundary repeat at that distance, at
most one step each way; what they give is a fragment of a run, or a whole one.

1. A scan of the texts finds *evidence*: equal stretches of ``max(16, D)`` words whose next occurrence
   lies at a distance of the octave. Every place of a run is covered by its evidence, so tiles whose
   boundary has none hold no run and are not made. Texts without evidence are finished here.
2. Tiles are rows (strips of neighbouring ones, to hold the words they share once), dealt evenly to
   all tasks whatever document they come from, and solved independently.
3. Fragments meet by (document, period) and are stitched where they touch. Fragments of a period that
   is a multiple of a smaller one were left out by their tile.
4. Runs meet the texts that had evidence, which alone are shuffled.

Words are compared by 64-bit hashes within a document. Defined results: null and empty texts have no
words and no run; rows equal in id and text are worked on once and all get the result; rows of one id
with different texts are documents of their own. Empty tables give empty results. Other columns,
whatever they are called, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.llm.common import in_arrow, mix, slices
from folioflow.operators.shared import attach, materialise

LEAST = 24  # words of a run, at least
TIMES = 3  # repeats of its period, at least
GRAM = 16  # words of the shortest evidence
STRIP = 1 << 14  # words from which on a strip of tiles is cut
SLICE_ROWS, SLICE_BYTES = 2_000, 4 << 20  # texts scanned at once

# Which of its own words stands at each place of a text of n words, or None for the text as it is.
Order = Callable[["int | None", int], "np.ndarray | None"]

def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()
SCANNED = _struct(
    doc_id=_LONG, key=_STRING, collapsed=_STRING, text=_STRING, octave=_INT, n=_LONG, base=_LONG, boundary=_LONG, n_tiles=_INT, words=T.BinaryType())
FRAGMENTS = _struct(key=_STRING, period=_LONG, lo=_LONG, hi=_LONG)
DIGESTS = _struct(
    key=_STRING, copies=_LONG, n_runs=_LONG, start=_LONG, length=_LONG, period=_LONG, exponent_milli=_LONG, runs_sha256=_STRING, collapsed_sha256=_STRING)
NOTHING = hashlib.sha256(b"").hexdigest()


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of the query's contract: a tenth of the ids repeat a stretch up to the end of the text."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    order = np.arange(n)
    order[start:] = start + (order[start:] - start) % period
    return order


def _words(text: str | None, order: np.ndarray | None) -> list[bytes]:
    found = text.encode("utf-8", "surrogatepass").split() if text else []
    return found if order is None else [found[i] for i in order.tolist()]


def evidence(hashes: np.ndarray, starts: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per octave the places where equal stretches begin whose next occurrence is a period of it away.

    ``hashes`` are the words of several documents; document *d* has ``hashes[starts[d]:starts[d + 1]]``.
    A stretch has ``max(GRAM, 2**(k+1))`` words.
    """
    total = len(hashes)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    end, most = starts[1:][owner], (sizes // TIMES)[owner]
    grams, width = mix(hashes + mix(owner.astype(np.uint64) + np.uint64(1))), 1

    def doubled(at: np.ndarray, grams: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(total, np.uint64)
        out[at] = mix(grams[at] * np.uint64(0x9E3779B97F4A7C15) + grams[at + width])
        return out

    while width < GRAM:
        at = np.arange(max(total - width, 0))
        grams, width = doubled(at, grams, width), width * 2
    places = np.flatnonzero(np.arange(total) + width <= end)
    found: list[tuple[int, np.ndarray]] = []
    octaves = range(width.bit_length() - 1)
    while len(places):
        order = np.argsort(grams[places], kind="stable")
        here, there = places[order[:-1]], places[order[1:]]
        same = (grams[here] == grams[there]) & (owner[here] == owner[there])
        here, there = here[same], there[same]
        for k in octaves:
            far = there - here
            hit = (far >= 1 << k) & (far < 2 << k) & (far <= most[here])
            if hit.any():
                found.append((k, np.sort(here[hit])))
        recurring = np.zeros(total + 1, bool)
        recurring[here] = recurring[there] = True
        at = np.flatnonzero(recurring)
        at = at[at + 2 * width <= end[at]]
        places = at[recurring[at + width]]
        grams, width = doubled(places, grams, width), width * 2
        octaves = range(width.bit_length() - 2, width.bit_length() - 1)
    return found


def strips_of(places: np.ndarray, octave: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """``base, end, boundary, n_tiles`` of the tiles of a document that have evidence at ``places``."""
    step = 2 << octave
    width = max(GRAM, step)
    cuts = np.flatnonzero(np.diff(places) > width) + 1
    for group in np.split(places, cuts):
        first, last = -(-int(group[0]) // step), (int(group[-1]) + width - 1) // step
        per = max(1, STRIP // step)
        for at in range(first, last + 1, per):
            tiles = min(per, last + 1 - at)
            yield max((at - 1) * step, 0), min((at + tiles + 1) * step, n), at * step, tiles


def z_values(s: list, most: int) -> list[int]:
    """For the places up to ``most``: how many items from there on equal those from the beginning on."""
    n = len(s)
    z = [0] * min(most + 1, n)
    left = right = 0
    for i in range(1, len(z)):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def primitive(word: list) -> bool:
    """Whether a word is no repetition of a shorter one."""
    n, rest, p = len(word), len(word), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if word[n // p:] == word[:-(n // p)]:
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def solve(words: list, base: int, n: int, octave: int, boundary: int, n_tiles: int) -> dict[int, list[list[int]]]:
    """Fragments ``period → [[lo, hi], …]`` of a strip: places whose word stands again a period later.

    Kept are fragments that reach the end of their tile and whole ones of the length of a run.
    """
    step = 2 << octave
    out: dict[int, list[list[int]]] = {}
    for c in range(boundary, boundary + n_tiles * step, step):
        at, first = c - base, max(c - step, 0) - base
        far = min(step - 1, n - c, n // TIMES)
        if far < 1 << octave:
            continue
        behind = z_values(words[at:at + 2 * step], far)
        before = at - first
        sides = words[first:at][::-1] + [None] + words[first:at + far][::-1]
        ahead = z_values(sides, before + 1 + far - (1 << octave))
        for q in range(1 << octave, far + 1):
            right = min(behind[q], step) if q < len(behind) else 0
            left = ahead[before + 1 + far - q]
            cut = right == step or (left == step and c > step)
            if not (cut or left + right >= max(LEAST, TIMES * q) - q) or left + right == 0:
                continue
            lo, hi = c - left, c + right
            if not primitive(words[lo - base:lo - base + q]):
                continue
            known = out.setdefault(q, [])
            if known and lo <= known[-1][1]:
                known[-1][1] = max(known[-1][1], hi)
            else:
                known.append([lo, hi])
    return out


def scan(batches: Iterator[pa.RecordBatch], order: Order) -> Iterator[pa.RecordBatch]:
    """Finished texts, texts with evidence, and their strips, as rows of ``SCANNED``."""
    schema = to_arrow_schema(SCANNED)
    for batch in slices(batches, SLICE_ROWS, "text", SLICE_BYTES):
        ids, keys, texts = (batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))
        plain, hashed = [], []
        for doc_id, text in zip(ids, texts):
            found = _words(text, None)
            places = order(doc_id, len(found))
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
            hashed.append(own if places is None else own[places])
            ordered = found if places is None else [found[i] for i in places.tolist()]
            plain.append(hashlib.sha256(b" ".join(ordered)).hexdigest())
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(h) for h in hashed], out=starts[1:])
        rows, marked = [], set()
        for octave, places in evidence(np.concatenate(hashed), starts):
            owners = np.searchsorted(starts, places, "right") - 1
            for group in np.split(np.arange(len(places)), np.flatnonzero(np.diff(owners)) + 1):
                doc = int(owners[group[0]])
                n = len(hashed[doc])
                marked.add(doc)
                for base, end, boundary, tiles in strips_of(places[group] - starts[doc], octave, n):
                    rows.append({"key": keys[doc], "octave": octave, "n": n, "base": base, "boundary": boundary, "n_tiles": tiles,
                                 "words": hashed[doc][base:end].tobytes()})
                    if len(rows) * STRIP > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
        for doc, (doc_id, key) in enumerate(zip(ids, keys)):
            rest = {"text": texts[doc]} if doc in marked else {"collapsed": plain[doc]}
            rows.append({"doc_id": doc_id, "key": key, **rest})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def fragments(strips: DataFrame) -> DataFrame:
    """``key, period, lo, hi`` of all strips."""
    out = to_arrow_schema(FRAGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                words = np.frombuffer(row["words"], np.uint64).tolist()
                found = solve(words, row["base"], row["n"], row["octave"], row["boundary"], row["n_tiles"])
                rows = [(row["key"], q, lo, hi) for q, each in found.items() for lo, hi in each]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return in_arrow(strips.select("key", "octave", "n", "base", "boundary", "n_tiles", "words"), run, FRAGMENTS)


def stitched(found: DataFrame) -> DataFrame:
    """``key, start, length, period``: fragments of a document and period joined where they touch."""
    by = Window.partitionBy("key", "period").orderBy("lo", "hi")
    reached = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("lo") > reached).cast("int"), F.lit(1))
    numbered = found.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("key", "period", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") + F.col("period") - F.col("start")
    return runs.select("key", "start", length.alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def digest(text: str | None, order: np.ndarray | None, runs: list[tuple[int, int, int]]) -> tuple:
    """Count, best run, hash of the runs and of the collapsed text; ``runs`` are (start, period, length) in order."""
    words = _words(text, order)
    if runs:
        steps = np.zeros(len(words) + 1, np.int64)
        for start, period, length in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        words = [w for w, covered in zip(words, np.cumsum(steps[:-1]).tolist()) if not covered]
    listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    best: tuple = (None, None, None, None)
    if runs:
        s, q, n = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]))
        best = (s, n, q, 1000 * n // q)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def runs_of(documents: DataFrame, order: Order = lambda doc_id, n: None) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` per row.

    ``start`` to ``exponent_milli`` are those of the run with the greatest length per period (of equal
    ones the first, then the one of the smallest period). ``order`` may rearrange a text's words.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.hex(F.xxhash64("text")))
    scanned = in_arrow(documents.select("doc_id", "text", key.alias("key")), lambda batches: scan(batches, order), SCANNED)
    scanned = materialise(scanned, "scanned")
    strips = scanned.where("octave IS NOT NULL")
    # dealt in turn, not by key: solving costs far more than reading, and one document may have most of the tiles
    dealt = strips.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = stitched(fragments(dealt))
    listed = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    marked = scanned.where("octave IS NULL AND collapsed IS NULL")
    texts = marked.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    out = to_arrow_schema(DIGESTS)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS, "text", SLICE_BYTES):
            rows = []
            for row in batch.to_pylist():
                found = [(r["start"], r["period"], r["length"]) for r in row["runs"] or []]
                n = len(_words(row["text"], None))
                rows.append((row["key"], row["copies"], *digest(row["text"], order(row["doc_id"], n), found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    digests = materialise(in_arrow(texts.join(listed, "key", "left"), finish, DIGESTS), "digests")
    worked = attach(marked.select("doc_id", "key"), digests, "key", "copies").drop("key")
    none = F.lit(None).cast("bigint")
    plain = scanned.where("collapsed IS NOT NULL").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_runs"), *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.lit(NOTHING).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
    return plain.unionByName(worked)
