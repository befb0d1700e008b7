"""Best-fit packing by length patterns.

Texts are tokenised and cut into pieces of at most ``limit`` tokens. The histogram of piece
lengths (``limit`` numbers, whatever the corpus) goes to the driver, which fits repeat counts of
patterns of one to three lengths that fill a sequence exactly: a non-negative least squares
problem. Counts are rounded and bound by what is there, and what is left is packed best-fit,
longest first. Pieces then find their place by their rank among pieces
of the same length; ranks are dealt out per (length, bucket), so a length that many pieces share
is never ordered in one task.

Defined results:

* null or empty text: one piece, the closing id alone; every text ends with id 0;
* a text of more than ``limit`` ids is cut into pieces of ``limit``, the last one may be shorter;
* pieces of equal length are interchangeable: which takes which place is decided by bucket,
  id and piece number;
* repeated rows are packed as often as they come; null ids are packed like any other;
* empty table: no rows; extra columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import in_arrow, kept, slices
from folioflow.operators.shared import materialise

LIMIT = 2048
PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
CACHED_WORDS = 500_000  # memory of a worker, not of the result
KEPT_WORDS = 200_000  # of these, between tasks: the ones met first, so the frequent ones
MAX_STEPS = 20_000
SETTLED = 1e-5  # the fit ends when no step gains that share of the histogram
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)  # of the fitted repeats
ROWS_PER_BUCKET = 20_000
MARKS = bytes(set(range(0x21, 0x7F)) - set(b"'") - set(range(0x30, 0x3A)) - set(range(0x41, 0x5B)) - set(range(0x61, 0x7B)))


class Tokens:
    """Ids of whole texts as bytes, word by word.

    No rule of the vocabulary looks across ASCII white space, so a word has the same ids in
    every text, and words are kept for reuse, A-Z in lower case as the normaliser has them. Plain
    Latin words go to the model without normaliser: their letters are a unit of their own, which
    is kept as a word too, and so are the marks that close them. Only an apostrophe may begin a unit
    with letters in it, so it is none of these ``MARKS``.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        named = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.names = {code: named(chr(code))[0][0] for code in range(0x80, 0x100)}
        self.words: dict[bytes, bytes] = {}

    def _unit(self, name: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(name)]).tobytes()

    def learn(self, new: set[bytes]) -> None:
        words, unit, names = self.words, self._unit, self.names
        other = []
        for word in new:
            core = word.rstrip(MARKS)
            if core.isascii():
                if core and not core.isalpha():
                    other.append(word)
                    continue
                low = core.lower()
                ids = words.get(low)
                if ids is None:
                    ids = words[low] = unit(low.decode())  # its letters are the bytes' own names
            else:
                text = core.decode("utf-8", "surrogatepass")
                # below U+0100 lower case is one letter for one and composed already
                if not text.isalpha() or max(text) >= "Ā":
                    other.append(word)
                    continue
                text = text.lower()
                low = text.encode()
                ids = words.get(low)
                if ids is None:
                    ids = words[low] = unit(text.translate(names))
            if len(core) < len(word):
                marks = word[len(core):]
                tail = words.get(marks)
                if tail is None:
                    tail = words[marks] = unit(marks.decode())
                ids += tail
            words[word] = ids
        for at in range(0, len(other), 2000):
            part = other[at:at + 2000]
            done = self.whole.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)
            for word, got in zip(part, done, strict=True):
                words[word] = array("I", got.ids).tobytes()

    def forget(self) -> None:
        """Keep the words that were met first."""
        self.words = dict(islice(self.words.items(), KEPT_WORDS))

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        split = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass") if text else b""
            # marks of the vocabulary such as <|endoftext|> are found before anything is put in lower case
            split.append((data if b"<|" in data else data.lower()).split())
        wanted: set[bytes] = set()
        for ws in split:
            wanted.update(ws)
        new = wanted.difference(self.words)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.forget()
            new = wanted.difference(self.words)
        if new:
            self.learn(new)
        for ws in split:
            yield b"".join(map(self.words.__getitem__, ws))


def tokens(path: str) -> Tokens:
    return kept(__name__, path, lambda: Tokens(path))


def token_pieces(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``PIECES`` of every row of ``documents(doc_id, text)``; ``path`` names the vocabulary file."""
    width = 4 * limit
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokens(path)
        try:
            for batch in slices(batches, 1000, "text", 1 << 22):
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), model.ids(batch.column(1).to_pylist()), strict=True):
                    ids += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), width)):
                        part = ids[at:at + width]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        finally:
            # the worker lives on and may serve other jobs: most words of a task are its own
            model.forget()

    return in_arrow(documents.select("doc_id", F.col("text").cast("string").alias("text")), cut, PIECES)


def patterns(limit: int) -> np.ndarray:
    """All ways to fill ``limit`` with one, two or three lengths, padded with 0; shorter patterns first."""
    rows = [np.array([[limit, 0, 0]])]
    half = np.arange(1, limit // 2 + 1)
    rows.append(np.stack([limit - half, half, 0 * half], 1))
    for small in range(1, limit // 3 + 1):
        middle = np.arange(small, (limit - small) // 2 + 1)
        rows.append(np.stack([limit - small - middle, middle, np.full_like(middle, small)], 1))
    return np.concatenate(rows).astype(np.int64)


def fit_repeats(histogram: np.ndarray, limit: int, max_steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their non-negative repeat counts: least squares against the histogram.

    Coordinate descent that always moves the pattern whose move gains most, which keeps the
    solution sparse. ``histogram[n]`` is the number of pieces of length n.
    """
    usable = patterns(limit)
    # a pattern without any piece of one of its lengths can only be 0
    have = np.concatenate([[True], histogram[1:] > 0])
    usable = usable[have[usable].all(axis=1)]
    n = len(usable)
    repeats = np.zeros(n)
    if not n:
        return usable, repeats
    # occurrences of a length in a pattern
    square = np.zeros(n)
    for a in range(3):
        for b in range(3):
            square += (usable[:, a] == usable[:, b]) & (usable[:, a] > 0)
    rest = histogram.astype(float).copy()
    rest[0] = 0.0
    least = max(0.5, SETTLED * float(np.linalg.norm(rest)))
    order = np.argsort(usable.ravel(), kind="stable")
    bounds = np.searchsorted(usable.ravel()[order], np.arange(limit + 2))
    scale = np.sqrt(square)
    gain = rest[usable].sum(axis=1) / scale
    used: list[int] = []
    for _ in range(max_steps):
        best = int(np.argmax(gain))
        if used:
            back = used[int(np.argmin(gain[used]))]
            if -gain[back] > gain[best]:
                best = back
        step = max(gain[best] / scale[best], -repeats[best])
        if abs(step) * scale[best] < least:
            break
        if not repeats[best]:
            used.append(best)
        repeats[best] += step
        if not repeats[best]:
            used.remove(best)
        for length in set(usable[best].tolist()) - {0}:
            times = int((usable[best] == length).sum())
            touched = order[bounds[length]:bounds[length + 1]] // 3
            np.subtract.at(gain, touched, times * step / scale[touched])
    return usable, repeats


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest sequence with room; ``[(lengths, repeats)]``.

    Works on counts, so its cost follows the number of lengths, not of pieces.
    """
    spaces: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    open_: list[int] = []  # spaces in use, ascending

    def put(space: int, contents: tuple[int, ...], count: int) -> None:
        if count:
            if space not in spaces:
                spaces[space] = []
                bisect.insort(open_, space)
            spaces[space].append((contents, count))

    for length in sorted((x for x, c in counts.items() if c > 0), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(open_, length)
            if at < len(open_):
                space = open_[at]
                contents, count = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space], open_[at]
                fresh = False
            else:
                space, contents, count, fresh = limit, (), left, True
            each = space // length
            full = min(count, left // each)
            put(space - each * length, contents + (length,) * each, full)
            left -= full * each
            rest = count - full
            if left and left < each and rest:
                put(space - left * length, contents + (length,) * left, 1)
                left, rest = 0, rest - 1
            if not fresh:
                put(space, contents, rest)
    return [x for group in spaces.values() for x in group]


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """``[(lengths, repeats)]`` that holds every piece once.

    Fitted repeats are rounded at several shares of them, the rest is packed best-fit, and the
    plan with the fewest sequences is taken: where counts are small, patterns that use up the
    short pieces leave a rest that packs badly.
    """
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    usable, repeats = fit_repeats(counts, limit)
    plans = [_rounded(counts.copy(), usable, share * repeats, limit) for share in SHARES]
    return min(plans, key=lambda planned: sum(r for _, r in planned))


def _rounded(counts: np.ndarray, usable: np.ndarray, repeats: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    done = []
    # most repeated first; rounding and what is still there keep every pattern possible
    for p in np.argsort(-repeats, kind="stable"):
        if repeats[p] < 0.5:
            break
        parts = Counter(x for x in usable[p].tolist() if x)
        times = min(int(repeats[p] + 0.5), *(int(counts[x]) // k for x, k in parts.items()))
        if times:
            done.append((tuple(x for x in usable[p].tolist() if x), times))
            for x, k in parts.items():
                counts[x] -= times * k
    return done + best_fit({x: int(c) for x, c in enumerate(counts) if c and x}, limit)


def runs_of(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, count, first sequence, offset)``: places in the order of ranks."""
    used: Counter = Counter()
    runs, sequence = [], 0
    for lengths, repeats in planned:
        offset = 0
        for length in lengths:
            runs.append((length, used[length], repeats, sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return runs


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces(doc_id, piece, length, …)`` with ``sequence_id`` and ``offset``.

    ``pieces`` must be a written table: it is read for the histogram and again for the places.
    The table of places that is broadcast has a row per length and pattern position: its size
    depends on ``limit``, not on the corpus.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = max(64, total // ROWS_PER_BUCKET)
    salted = pieces.withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    )
    cells = salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialise(cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = runs_of(plan(histogram, limit))
    # pieces of a cell that fall into a run: cells and runs meet per length, then pieces per cell
    # as Arrow: rows of Python objects would start workers of another kind on the executors, beside those there are
    names = ["length", "_first", "_count", "_sequence", "offset"]
    places = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*(runs or [(0, 0, 0, 0, 0)]))], names))
    spans = F.broadcast(places.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("_first", "_count", "_sequence", "offset"))).alias("_runs")))
    cut = (
        cells.join(spans, "length")
        .withColumn("_runs", F.filter("_runs", lambda r: (r["_first"] < F.col("_before") + F.col("_n"))
                                      & (r["_first"] + r["_count"] > F.col("_before"))))
        .select("length", "_bucket", "_before", "_runs")
    )
    ranked = salted.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    )
    placed = ranked.join(cut, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    run = F.filter("_runs", lambda r: (r["_first"] <= F.col("_rank")) & (F.col("_rank") < r["_first"] + r["_count"]))[0]
    return placed.withColumn("_run", run).select(
        *pieces.columns,
        (F.col("_run._sequence") + F.col("_rank") - F.col("_run._first")).alias("sequence_id"),
        F.col("_run.offset").alias("offset"),
    )
