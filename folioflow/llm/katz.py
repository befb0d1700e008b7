"""Katz backoff language model, counted, stored and evaluated in blocks.

``P(w | c) = d(r) r / Z(c)`` for an n-gram counted r times, with Good-Turing discounts d for
r <= ``DISCOUNTED``; otherwise ``alpha(c) P(w | shorter c)``. ``alpha`` is the mass the discounts
left over, divided by the mass that the shorter model gives to words not seen after c, so every
distribution sums to one exactly. The shortest model keeps mass for one class of unknown words.

The corpus is cut once into written blocks of about ``BLOCK_TOKENS`` tokens. For every order the
blocks send their distinct n-grams with local counts to buckets, where counts are added up and
answered; a block that has the answers of all shorter orders can compute, token by token, the
probabilities that the next order backs off to. Each n-gram crosses the network once per block
and order, however often it occurs: contexts as their rank within the bucket that counted them, words
by frequency, both as differences of ascending numbers; answers name n-grams by rank within the bucket. A context of more than a quarter of a bucket
is split over several buckets by the following word; fewer than four times as many contexts as there
are buckets can be that frequent, and a row of sums of each is added on the driver. Counts are kept
as tables partitioned by kind.

Defined results:

* null or empty text: the end token alone; a text's first word follows a start symbol that is
  never predicted;
* no training rows: ``train_tokens`` 0 and all probabilities those of an unknown word, 1;
* Good-Turing estimates that are no proper discounts (small or regular counts): half a count is
  taken off; a context without discounted words keeps one count for unseen ones;
* repeated rows: counted and scored as often as they come, one row each; null ids are scored like
  any other; empty table: no rows; extra columns are not read; whole texts are read.

Words are known by 64-bit hashes (n words coincide with odds of n * n / 2**65); n-grams are
known by exact ids of their words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import hashed_words, mix, slices
from folioflow.operators.shared import materialise, run_folder

ORDER = 2
DISCOUNTED = 5
BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_000_000
HOT = 4  # a context of more than that part of a bucket is split
END = np.uint64(0x2545F4914F6CDD1D)  # hash of the end token
START = -1  # id of the start symbol
ANSWERS = "kind STRING, block BIGINT, bucket INT, payload ARRAY<BINARY>, context BIGINT, sums ARRAY<DOUBLE>"


def packed(values: np.ndarray) -> bytes:
    """An integer or float array, its bytes by significance, each significance with a code of its own.

    Planes of different kinds do not share a code, so that messages of a few thousand numbers stay
    as compact as those of millions.
    """
    values = np.ascontiguousarray(values).ravel()
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    held, parts = 0, []
    for i, plane in enumerate(planes):
        if plane.any():
            held |= 1 << i
            code = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_RLE)
            parts.append(code.compress(plane.tobytes()) + code.flush())
    sizes = np.array([len(values), *map(len, parts)], np.uint32)
    return b"".join([bytes([held]), sizes.tobytes(), *parts])


def unpacked(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    held = [i for i in range(dtype.itemsize) if data[0] >> i & 1]
    at = 1 + 4 * (1 + len(held))
    n, *sizes = np.frombuffer(data, np.uint32, 1 + len(held), 1).tolist()
    out = np.zeros((n, dtype.itemsize), np.uint8)
    for i, size in zip(held, sizes):
        out[:, i] = np.frombuffer(zlib.decompress(data[at:at + size], -15), np.uint8)
        at += size
    return out.view(dtype).ravel()


# --- blocks ------------------------------------------------------------------------------------


def blocks(documents: DataFrame, train: Column) -> DataFrame:
    """``block, n_tokens, payload``: texts as places in their block's ascending list of word hashes.

    Every text ends with the end token.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, []

        def emit() -> pa.RecordBatch:
            nonlocal number, held
            ids = [x for part in held for x in part[0]]
            lengths = np.concatenate([p[1] for p in held])
            kinds, places = np.unique(np.concatenate([p[2] for p in held]), return_inverse=True)
            flags = np.concatenate([p[3] for p in held])
            block = (TaskContext.get().partitionId() << 32) + number
            number, held = number + 1, []
            # a missing id travels as a flag beside its number
            known = np.array([x is not None for x in ids], np.uint8)
            payload = [
                packed(np.array([x or 0 for x in ids], np.int64)), packed(known), packed(lengths.astype(np.int64)),
                packed(flags.astype(np.uint8)), packed(kinds), packed(places.astype(np.uint32)),
            ]
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([len(places)], pa.int64()), pa.array([payload], pa.list_(pa.binary())),
            ], ["block", "n_tokens", "payload"])

        tokens = 0
        for batch in slices(batches, 1000, "text", 1 << 22):
            hashes, starts = hashed_words(batch.column(1).to_pylist())
            flat = np.insert(hashes, starts[1:], END)
            flags = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            held.append((batch.column(0).to_pylist(), np.diff(starts) + 1, flat, flags))
            tokens += len(flat)
            if tokens >= BLOCK_TOKENS:
                yield emit()
                tokens = 0
        if held:
            yield emit()

    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train")
    )
    return rows.mapInArrow(run, "block BIGINT, n_tokens BIGINT, payload ARRAY<BINARY>")


class Block:
    """A block's texts, token by token."""

    def __init__(self, payload: list[bytes]) -> None:
        self.ids, self.known, self.lengths = (unpacked(p, t) for p, t in zip(payload, (np.int64, np.uint8, np.int64)))
        self.train = unpacked(payload[3], np.uint8).astype(bool)
        self.kinds, self.places = unpacked(payload[4], np.uint64), unpacked(payload[5], np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.learnt = np.repeat(self.train, self.lengths)


# --- model numbers -------------------------------------------------------------------------------


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """``d(0..DISCOUNTED)``; ``of_counts[r]`` is the number of n-grams counted r times, r up to DISCOUNTED + 1."""
    out = np.ones(DISCOUNTED + 1)
    n = of_counts.astype(float)
    tail = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        d = 0.0
        if n[r] and tail < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``d(r) r`` of counts."""
    return counts * np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0)


class Level:
    """What the driver knows of an order: counts of counts, and the contexts that are very frequent.

    ``hot_sums`` has their whole sums ``[count, shorter mass, n_1 … n_DISCOUNTED]``, ``hot_next`` the
    n-grams of this order that are frequent as contexts of the next one, with the number of buckets
    each is split over; both as ascending ids and what belongs to them.
    """

    def __init__(self, of_counts: np.ndarray, total: int, hot_sums: dict[int, np.ndarray]) -> None:
        self.d, self.total = discounts(of_counts), total
        self.hot_sums = _ascending(hot_sums, (0, 2 + DISCOUNTED))
        self.hot_next = _ascending({}, (0,))


def _ascending(known: dict, empty: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(sorted(known), np.int64)
    return ids, np.array([known[i] for i in ids.tolist()]) if known else np.zeros(empty)


def _found(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``ids`` that the table knows, and what belongs to them."""
    known, values = table
    if not len(known):
        return np.zeros(0, np.int64), values[:0]
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    hit = np.flatnonzero(known[at] == ids)
    return hit, values[at[hit]]


def word_probabilities(counts: np.ndarray, level: Level, mass: float) -> np.ndarray:
    """Shortest model; ``mass`` is the sum of discounted counts of all words."""
    if not level.total:
        return np.ones(len(counts))
    total = level.total if mass < level.total else level.total + 1
    return np.where(counts > 0, discounted(counts, level.d) / total, 1 - mass / total)


def conditional(
    counts: np.ndarray, shorter: np.ndarray, sums: np.ndarray, level: Level
) -> np.ndarray:
    """Probabilities of n-grams; ``sums`` has a row of context sums for each of them."""
    total, lower = sums[:, 0], sums[:, 1]
    taken = sums[:, 2:] @ (np.arange(1, DISCOUNTED + 1) * (1 - level.d[1:]))
    kept = np.where(taken > 0, total, total + 1)  # the divisor
    left = np.where(taken > 0, taken, 1.0) / np.maximum(kept, 1)
    alpha = left / np.maximum(1 - lower, 1e-12)
    unseen = np.where(total > 0, alpha * shorter, shorter)
    return np.where(counts > 0, discounted(counts, level.d) / np.maximum(kept, 1), unseen)


# --- orders of a block -----------------------------------------------------------------------------


class Order:
    """Distinct n-grams of one order in a block, in the order in which they were asked for."""

    def __init__(self, context: np.ndarray, word: np.ndarray, place: np.ndarray, buckets: np.ndarray) -> None:
        self.context, self.word, self.place, self.buckets = context, word, place, buckets


def bucket_of(context: np.ndarray, word: np.ndarray, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The bucket that counted the context, or for frequent contexts one of several behind it."""
    spread = context % buckets
    own, pieces = _found(context, hot)
    spread[own] += (mix(word[own].view(np.uint64)) % pieces.astype(np.uint64)).astype(np.int64)
    return spread % buckets


def evaluated(block: Block, answers: dict[int, dict[int, list[bytes]]], levels: list[Level], mass: float, buckets: int):
    """A block as far as orders are answered: ``(word counts, probability of each token, grams, shorter)``.

    Recurses from words to the longest answered order; a token without an n-gram of some order
    keeps its probability of the order before. ``grams`` are the distinct n-grams of the next
    order, to be asked for, and ``shorter`` what each of them backs off to.
    """
    order = np.argsort(block.kinds % np.uint64(buckets), kind="stable")
    counts, ids, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), 0
    for bucket in sorted(answers[1]):
        c, g = (unpacked(x, np.int64) for x in answers[1][bucket])
        counts[order[at:at + len(c)]], ids[order[at:at + len(c)]] = c, g * buckets + bucket
        at += len(c)
    p = word_probabilities(counts, levels[0], mass)[block.places]
    words = ids[block.places]
    grams_before, usable = words, np.ones(len(words), bool)
    for k in range(2, len(levels) + 2):
        # id of the n-gram before each token; the start symbol before the first word
        before = np.concatenate([[START], grams_before[:-1]])
        before[block.starts] = START
        kinds, _, inverse = _distinct(np.stack([before[usable], words[usable]], 1))
        where = bucket_of(kinds[:, 0], kinds[:, 1], buckets, levels[k - 2].hot_next)
        by = np.lexsort((kinds[:, 1], kinds[:, 0], where))
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        place = np.full(len(words), -1, np.int64)
        place[usable] = back[inverse]
        grams = Order(kinds[by, 0], kinds[by, 1], place, where[by])
        shorter = np.zeros(len(by))
        shorter[place[usable]] = p[usable]
        if k not in answers:
            return counts, p, grams, shorter
        c, g, sums = _answered(grams, answers[k], levels[k - 1], buckets)
        p = p.copy()
        p[usable] = conditional(c, shorter, sums, levels[k - 1])[place[usable]]
        grams_before = np.full(len(words), START, np.int64)
        grams_before[usable] = g[place[usable]]
        usable = np.concatenate([[False], usable[:-1]])
        usable[block.starts] = False
    return counts, p, None, None


def _distinct(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((pair[:, 1], pair[:, 0]))
    ordered = pair[by]
    new = np.ones(len(by), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    inverse = np.empty(len(by), np.int64)
    inverse[by] = np.cumsum(new) - 1
    return ordered[new], by[new], inverse


def _answered(
    grams: Order, answers: dict[int, list[bytes]], level: Level, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, ids and context sums of a block's n-grams."""
    n = len(grams.context)
    counts, ids = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sums = np.zeros((n, 2 + DISCOUNTED))
    bounds = np.flatnonzero(np.concatenate([[True], grams.buckets[1:] != grams.buckets[:-1], [True]])) if n else [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        c, g, *context = answers[int(grams.buckets[a])]
        counts[a:b], own = unpacked(c, np.int64), unpacked(g, np.int64)
        if len(own):
            ids[a:b] = own * buckets + grams.buckets[a]
        new = np.ones(b - a, bool)
        new[1:] = grams.context[a + 1:b] != grams.context[a:b - 1]
        which = np.cumsum(new) - 1
        own = np.zeros((which[-1] + 1, 2 + DISCOUNTED))
        own[:, 0] = unpacked(context[0], np.int64)
        own[:, 2] = unpacked(context[1], np.uint8)  # seen words only need to know that something is taken off
        open_ = np.bincount(which, counts[a:b] == 0) > 0
        own[open_, 1] = unpacked(context[2], np.float64)
        own[open_, 2:] = unpacked(context[3], np.int64).reshape(-1, DISCOUNTED)
        sums[a:b] = own[which]
    hit, whole = _found(grams.context, level.hot_sums)
    sums[hit] = whole
    return counts, ids, sums


# --- buckets -----------------------------------------------------------------------------------------


def _row(kind: str, block: int, bucket: int, payload: list[bytes] | None, context: int | None = None, sums=None) -> tuple:
    return kind, block, bucket, payload, context, sums


def _table(rows: list[tuple]) -> pa.Table:
    types = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.list_(pa.float64()))
    names = ("kind", "block", "bucket", "payload", "context", "sums")
    columns = zip(*rows) if rows else [[]] * 6
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, columns, types)})


def _of_counts(totals: np.ndarray) -> np.ndarray:
    """``[distinct, total, n_1 … n_{DISCOUNTED+1}]`` of positive counts."""
    small = np.bincount(np.minimum(totals, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:DISCOUNTED + 2]
    return np.concatenate([[(totals > 0).sum(), totals.sum()], small]).astype(float)


def _count_words(group: pa.Table, buckets: int) -> pa.Table:
    bucket = group.column("bucket")[0].as_py()
    parts = group.column("payload").to_pylist()
    keys = [unpacked(p[0], np.uint64) for p in parts]
    kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(which, np.concatenate([unpacked(p[1], np.int64) for p in parts]), len(kinds)).astype(np.int64)
    ids = np.empty(len(kinds), np.int64)
    ids[np.argsort(-totals, kind="stable")] = np.arange(len(kinds)) * buckets + bucket  # frequent words have small numbers
    rows, at = [], 0
    for block, key in zip(group.column("block").to_pylist(), keys):
        own = which[at:at + len(key)]
        at += len(key)
        rows.append(_row("answer", block, bucket, [packed(totals[own]), packed(ids[own] // buckets)]))
    seen = totals > 0
    rows.append(_row("model", 0, bucket, [packed(kinds[seen]), packed(ids[seen]), packed(totals[seen])]))
    rows.append(_row("sums", 0, bucket, None, None, _of_counts(totals).tolist()))
    return _table(rows)


def _count_grams(group: pa.Table, buckets: int, hot: tuple[np.ndarray, np.ndarray], last: bool, words_model=None) -> pa.Table:
    bucket = group.column("bucket")[0].as_py()
    parts = group.column("payload").to_pylist()
    contexts, words, counts, lower = [], [], [], []
    for p in parts:
        context, word = _opened(p, bucket, buckets)
        contexts.append(context)
        words.append(word)
        counts.append(unpacked(p[2], np.int64))
        lower.append(_lower_read(p[3:], word, words_model))
    pair = np.stack([np.concatenate(contexts), np.concatenate(words)], 1)
    kinds, first, which = _distinct(pair)
    totals = np.bincount(which, np.concatenate(counts), len(kinds)).astype(np.int64)
    shorter = np.concatenate(lower)[first]
    # ids are contexts of the next order; the longest n-grams need none
    ids = np.arange(0 if last else len(kinds), dtype=np.int64) * buckets + bucket
    # sums by context
    new = np.ones(len(kinds), bool)
    new[1:] = kinds[1:, 0] != kinds[:-1, 0]
    of = np.cumsum(new) - 1
    n = int(of[-1]) + 1 if len(of) else 0
    seen = totals > 0
    total = np.bincount(of, totals, n).astype(np.int64)
    mass = np.bincount(of[seen], shorter[seen], n)
    small = np.zeros((n, DISCOUNTED), np.int64)
    for r in range(1, DISCOUNTED + 1):
        small[:, r - 1] = np.bincount(of[totals == r], minlength=n)
    rows, at = [], 0
    for block, word in zip(group.column("block").to_pylist(), words):
        own = which[at:at + len(word)]
        at += len(word)
        head = np.concatenate([[True], of[own][1:] != of[own][:-1]])
        context = of[own][head]
        # what a context leaves over is asked for only where one of its words was not seen
        open_ = np.bincount(np.cumsum(head) - 1, totals[own] == 0) > 0
        rows.append(_row("answer", block, bucket, [
            packed(totals[own]), packed(ids if last else ids[own] // buckets), packed(total[context]),
            packed((small[context].sum(axis=1) > 0).astype(np.uint8)),
            packed(mass[context[open_]]), packed(small[context[open_]].ravel()),
        ]))
    rows.append(_row("model", 0, bucket, [
        packed(kinds[seen, 0]), packed(kinds[seen, 1]), packed(ids if last else ids[seen]), packed(totals[seen]),
    ]))
    rows.append(_row("sums", 0, bucket, None, None, _of_counts(totals).tolist()))
    for i in _found(kinds[new, 0], hot)[0].tolist():
        gram = int(kinds[new, 0][i])
        rows.append(_row("hot", 0, bucket, None, gram, [float(total[i]), float(mass[i]), *small[i].astype(float).tolist()]))
    return _table(rows)


# --- jobs ------------------------------------------------------------------------------------------------


class Katz:
    """Counts and scores all rows of one table; ``train`` says which rows are counted."""

    def __init__(self, documents: DataFrame, train: Column, order: int = ORDER) -> None:
        self.spark: SparkSession = documents.sparkSession
        self.order = order
        folder = run_folder(self.spark, "blocks")
        # bucketed by block: the answers come to the blocks, the blocks stay where they are
        self.name = f"katz_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        (
            blocks(documents, train).write.format("parquet").option("path", folder)
            .bucketBy(parts, "block").sortBy("block").saveAsTable(self.name)
        )
        self.blocks = self.spark.table(self.name)
        tokens = self.blocks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
        self.buckets = max(1, -(-tokens // BUCKET_TOKENS))
        self.tables: dict[int, str] = {}
        self.levels: list[Level] = []
        self.mass = 0.0
        self.distinct = 0
        try:
            for k in range(1, order + 1):
                self._count(k)
        except Exception:
            self.close()
            raise

    def _kind(self, k: int, kind: str) -> DataFrame:
        return self.spark.read.schema(ANSWERS).parquet(self.tables[k]).where(F.col("kind") == kind)

    def _with_answers(self, run, schema: str) -> DataFrame:
        """``run`` over each block and the answers it has so far."""
        answers = None
        for k in self.tables:
            part = self._kind(k, "answer").select("block", F.lit(k).alias("order"), "bucket", "payload")
            answers = part if answers is None else answers.unionByName(part)
        return self.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    def _count(self, k: int) -> None:
        buckets, levels, mass = self.buckets, list(self.levels), self.mass
        request = "bucket INT, block BIGINT, payload ARRAY<BINARY>"
        if k == 1:
            def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        yield _word_requests(name, Block(payload), buckets)

            asked = self.blocks.select("block", "payload").mapInArrow(ask, request)
            done = asked.groupBy("bucket").applyInArrow(lambda g: _count_words(g, buckets), ANSWERS)
            hot = _ascending({}, (0,))
        else:
            hot = levels[-1].hot_next

            def ask_grams(left: pa.Table, right: pa.Table) -> pa.Table:
                if not left.num_rows:
                    return _requests([])
                block = Block(left.column("payload")[0].as_py())
                counts, _, grams, shorter = evaluated(block, _by_order(right), levels, mass, buckets)
                tally = None
                if k == 2:
                    tally = np.zeros(len(grams.word), np.int64)
                    tally[grams.place] = counts[block.places]
                return _gram_requests(left.column("block")[0].as_py(), block, grams, shorter, tally, buckets)

            asked = self._with_answers(ask_grams, request)
            last, words_model = k == self.order, (levels[0], mass) if k == 2 else None
            done = asked.groupBy("bucket").applyInArrow(lambda g: _count_grams(g, buckets, hot, last, words_model), ANSWERS)
        folder = run_folder(self.spark, f"ngrams-{k}")
        done.write.partitionBy("kind").parquet(folder)
        self.tables[k] = folder
        self._learn(k, hot)

    def _learn(self, k: int, hot: tuple[np.ndarray, np.ndarray]) -> None:
        """Sums of an order: a few numbers per order and per very frequent context."""
        found: dict[str, dict] = {"sums": {}, "hot": {}}
        for kind in found if len(hot[0]) else ("sums",):
            each = self._kind(k, kind).select("context", F.posexplode("sums").alias("place", "v"))
            for row in each.groupBy("context", "place").agg(F.sum("v").alias("v")).collect():
                found[kind].setdefault(row["context"], {})[row["place"]] = row["v"]
        sums = found["sums"].get(None, {})
        values = np.array([sums.get(i, 0.0) for i in range(DISCOUNTED + 3)])
        of_counts = np.concatenate([[0], values[2:]])
        total = int(values[1])
        whole = {c: np.array([x.get(i, 0.0) for i in range(DISCOUNTED + 2)]) for c, x in found["hot"].items()}
        level = Level(of_counts, total, whole)
        self.levels.append(level)
        if k == 1:
            self.distinct = int(values[0])
            # r d(r) n_r for small r, and the whole of the rest
            small = of_counts[1:DISCOUNTED + 1] * np.arange(1, DISCOUNTED + 1)
            self.mass = float(total - (small * (1 - level.d[1:])).sum())
        if k < self.order:
            level.hot_next = self._frequent(k, total)

    def _frequent(self, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of at least a quarter of a bucket, and over how many buckets to split them."""
        buckets = self.buckets
        least = max(total / (HOT * buckets), 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for payload in batch.column(0).to_pylist():
                    ids, counts = unpacked(payload[-2], np.int64), unpacked(payload[-1], np.int64)
                    often = counts >= least
                    yield pa.RecordBatch.from_arrays([pa.array(ids[often]), pa.array(counts[often])], ["id", "n"])

        rows = self._kind(k, "model").select("payload").mapInArrow(run, "id BIGINT, n BIGINT").collect()
        out = {r["id"]: max(2, int(2 * buckets * r["n"] / total)) for r in rows}
        if k == 1:
            # as many texts may start as there are; a start may be frequent too
            out[START] = max(2, buckets // 8)
        return _ascending(out if buckets > 1 else {}, (0,))

    def scores(self) -> DataFrame:
        """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
        buckets, levels, mass, distinct = self.buckets, list(self.levels), self.mass, self.distinct
        total = levels[0].total

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _scored(None, None, None, None, total)
            block = Block(left.column("payload")[0].as_py())
            counts, p, _, _ = evaluated(block, _by_order(right), levels, mass, buckets)
            c = counts[block.places]
            base = np.log10(c + 1) - np.log10(total + distinct + 1)
            return _scored(block, c > 0, base, np.log10(p), total)

        return self._with_answers(run, SCORES)

    def close(self) -> None:
        """Forget the table of blocks; its files belong to the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


SCORES = "doc_id BIGINT, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, score DOUBLE"


def _scored(block: Block | None, known, base, logs, total: int) -> pa.Table:
    n = 0 if block is None else len(block.ids)
    add = (lambda x: np.add.reduceat(x, block.starts)) if n else (lambda x: np.zeros(0))
    return pa.table({
        "doc_id": pa.array(block.ids if n else [], pa.int64(), mask=block.known == 0 if n else None),
        "n_tokens": pa.array(block.lengths if n else [], pa.int64()),
        "n_known": pa.array(add(known.astype(np.int64)) if n else [], pa.int64()),
        "train_tokens": pa.array(np.full(n, total), pa.int64()),
        "base_score": pa.array(add(base) if n else [], pa.float64()),
        "score": pa.array(add(logs) if n else [], pa.float64()),
    })


def _by_order(answers: pa.Table) -> dict[int, dict[int, list[bytes]]]:
    out: dict[int, dict[int, list[bytes]]] = {}
    for k, bucket, payload in zip(*(answers.column(c).to_pylist() for c in ("order", "bucket", "payload"))):
        out.setdefault(k, {})[bucket] = payload
    return out


def _requests(rows: list[tuple[int, int, list[bytes]]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.table({
        "bucket": pa.array(columns[0], pa.int32()), "block": pa.array(columns[1], pa.int64()),
        "payload": pa.array(columns[2], pa.list_(pa.binary())),
    })


def _word_requests(name: int, block: Block, buckets: int) -> pa.RecordBatch:
    counts = np.bincount(block.places[block.learnt], minlength=len(block.kinds)).astype(np.int64)
    where = (block.kinds % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        if len(part):
            rows.append((int(where[part[0]]), name, [packed(block.kinds[part]), packed(counts[part])]))
    return _requests(rows).combine_chunks().to_batches()[0]


def _closed(context: np.ndarray, word: np.ndarray, bucket: int, buckets: int) -> list[bytes]:
    """Ascending pairs as differences: ranks of the contexts in their own bucket, how far that is, runs, words."""
    heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    rank, own = np.divmod(context[heads], buckets)
    steps = word.copy()
    steps[1:] -= word[:-1]
    steps[heads] = word[heads]
    runs = np.diff(np.concatenate([heads, [len(context)]]))
    return [packed(np.stack([np.diff(rank, prepend=-1), (bucket - own) % buckets, runs])), packed(steps)]


def _opened(payload: list[bytes], bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    steps, away, runs = unpacked(payload[0], np.int64).reshape(3, -1)
    context = (np.cumsum(steps) - 1) * buckets + (bucket - away) % buckets
    words = np.cumsum(unpacked(payload[1], np.int64))
    heads = np.cumsum(runs) - runs
    # a run's first word stands whole: what the runs before it came to is taken off
    before = np.concatenate([[0], words])[heads]
    return np.repeat(context, runs), words - np.repeat(before, runs)


def _lower_sent(words: np.ndarray, shorter: np.ndarray, tally: np.ndarray | None) -> list[bytes]:
    """What a message's n-grams back off to: for pairs, the counts of its distinct words, which fall nearly evenly with their ids."""
    if tally is None:
        values, which = np.unique(shorter, return_inverse=True)
        return [packed(values), packed(which.astype(np.uint32))]
    steps = np.diff(tally[np.unique(words, return_index=True)[1]], prepend=0)
    return [packed((steps << 1) ^ (steps >> 63))]  # the sign as the lowest bit


def _lower_read(payload: list[bytes], words: np.ndarray, words_model: tuple[Level, float] | None) -> np.ndarray:
    if words_model is None:
        return unpacked(payload[0], np.float64)[unpacked(payload[1], np.uint32)]
    folded = unpacked(payload[0], np.int64)
    tally = np.cumsum((folded >> 1) ^ -(folded & 1))
    return word_probabilities(tally, *words_model)[np.unique(words, return_inverse=True)[1]]


def _gram_requests(name: int, block: Block, grams: Order, shorter: np.ndarray, tally: np.ndarray | None, buckets: int) -> pa.Table:
    place = grams.place
    counted = np.bincount(place[block.learnt & (place >= 0)], minlength=len(grams.context)).astype(np.int64)
    rows = []
    bounds = np.flatnonzero(np.concatenate([[True], grams.buckets[1:] != grams.buckets[:-1], [True]])) if len(grams.context) else [0]
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows.append((int(grams.buckets[a]), name, [
            *_closed(grams.context[a:b], grams.word[a:b], int(grams.buckets[a]), buckets), packed(counted[a:b]),
            *_lower_sent(grams.word[a:b], shorter[a:b], None if tally is None else tally[a:b]),
        ]))
    return _requests(rows)


def score(documents: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """Scores of all ``documents(doc_id, text)``, written, by a model of the rows where ``train`` holds."""
    model = Katz(documents, train, order)
    try:
        return materialise(model.scores(), "scores")
    finally:
        model.close()
