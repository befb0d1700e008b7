"""Benchmark decontamination by greedy string tiling.

Runs of ``least`` shared words (seeds) lead from documents to benchmark items; each pair is then
tiled: the longest run of words that both still have free is marked, again and again, found by
running Karp-Rabin. The share of an item's words that end up in tiles is its coverage. As tiles
may lie anywhere in either text, a passage whose sentences were reordered is covered as well.

Documents are read once and narrowly: a task keeps only the stretches of a text whose seeds may
occur in the benchmark, judged by a bitmap of ``FILTER_BITS`` bits (a fixed 2 MB, whatever the
benchmark; a full bitmap keeps more but loses nothing). Seeds then meet in an ordinary join, and
only pairs that shared seeds could cover far enough are tiled.

Defined results:

* null or empty texts: no pairs; items of fewer than ``least`` words are ordinary phrases and
  match nothing;
* ties between equally long matches: the earlier place in the item, then in the document;
* repeated documents or items (same id and text): one row per pair of ids, its largest coverage;
* null ids: pairs are given with the null id; empty tables: no rows; extra columns are not read;
* long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import hashed_words, in_arrow, in_filter, seed_filter, shingles, slices
from folioflow.operators.shared import materialise

LEAST = 5  # words of a seed, and of the shortest tile
COVERAGE = 0.5
FIRST_LENGTH = 20  # where the search begins

PAIRS = "doc_id BIGINT, item_id BIGINT, n_tokens BIGINT, matched BIGINT, n_tiles BIGINT, longest BIGINT"


def _prefix(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers of a rolling hash modulo 2**64."""
    base = np.uint64(0x5851F42D4C957F2D)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens), base)]), dtype=np.uint64)
    # sum of token * base**-place is a prefix sum; compared after scaling by place
    inverse = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
    shrink = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(tokens) - 1, 0), inverse)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * shrink[:len(tokens)], dtype=np.uint64)])
    return sums, powers


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(length, place in item, place in text)`` of the tiles, in the order they were marked."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    found: list[tuple[int, int, int]] = []
    (sums_i, powers_i), (sums_t, powers_t) = _prefix(item), _prefix(text)

    def windows(sums, powers, free, length):
        n = len(free) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        places = np.flatnonzero(taken[length:] == taken[:n])
        return places, (sums[places + length] - sums[places]) * powers[places]

    def scan(length: int) -> tuple[int, list[tuple[int, int, int]]]:
        at_i, hash_i = windows(sums_i, powers_i, free_item, length)
        at_t, hash_t = windows(sums_t, powers_t, free_text, length)
        both = np.intersect1d(hash_i, hash_t)
        if not len(both):
            return 0, []
        by_hash: dict[int, list[int]] = {}
        for h, p in zip(hash_i.tolist(), at_i.tolist()):
            by_hash.setdefault(h, []).append(p)
        hits, longest = [], 0
        inside = np.isin(hash_t, both)
        for h, t in zip(hash_t[inside].tolist(), at_t[inside].tolist()):
            for p in by_hash[h]:
                if p and t and item[p - 1] == text[t - 1] and free_item[p - 1] and free_text[t - 1]:
                    continue  # part of a match that begins earlier
                size = 0
                most = min(len(item) - p, len(text) - t)
                while size < most and item[p + size] == text[t + size] and free_item[p + size] and free_text[t + size]:
                    size += 1
                if size >= length:
                    hits.append((size, p, t))
                    longest = max(longest, size)
        return longest, hits

    length = max(FIRST_LENGTH, least)
    while True:
        longest, hits = scan(length)
        if longest > 2 * length:
            length = longest
            continue
        queue = sorted(hits, key=lambda x: (-x[0], x[1], x[2]))
        while queue:
            size, p, t = queue.pop(0)
            blocked = np.flatnonzero(~(free_item[p:p + size] & free_text[t:t + size]))
            if len(blocked):
                # what is still free of it is a shorter match
                edges = [-1, *blocked.tolist(), size]
                for a, b in zip(edges, edges[1:]):
                    if b - a - 1 >= length:
                        queue.append((b - a - 1, p + a + 1, t + a + 1))
                queue.sort(key=lambda x: (-x[0], x[1], x[2]))
                continue
            free_item[p:p + size] = False
            free_text[t:t + size] = False
            found.append((size, p, t))
        if length == least:
            return found
        length = max(least, length // 2)


def items_of(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """``item_id, tokens ARRAY<BIGINT>`` of items long enough to match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "text", 1 << 22):
            hashes, starts = hashed_words(batch.column(1).to_pylist())
            tokens = [hashes[a:b].view(np.int64) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["item_id", "tokens"]
            )

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id BIGINT, tokens ARRAY<BIGINT>").where(F.size("tokens") >= least)


def seeds_of(items: DataFrame, least: int = LEAST) -> DataFrame:
    """``seed, item_id, tokens_hash, place`` for every run of ``least`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, seeds, places = [], [], [], []
            for item, key, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = shingles(np.array(tokens, np.int64).view(np.uint64), least).view(np.int64)
                ids += [item] * len(found)
                keys += [key] * len(found)
                seeds.append(found)
                places.append(np.arange(len(found), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(seeds) if seeds else [], pa.int64()), pa.array(ids, pa.int64()),
                pa.array(keys, pa.int64()), pa.array(np.concatenate(places) if places else [], pa.int32()),
            ], ["seed", "item_id", "item_key", "place"])

    return items.select("item_id", "item_key", "tokens").mapInArrow(
        run, "seed BIGINT, item_id BIGINT, item_key BIGINT, place INT"
    )


def stretches(documents: DataFrame, bitmap: np.ndarray, least: int = LEAST) -> DataFrame:
    """``doc_id, tokens, seeds`` of documents with possible seeds.

    ``tokens`` are the word hashes of all stretches that possible seeds cover, 0 between two
    stretches; ``seeds`` are the distinct possible seeds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "text", 1 << 22):
            hashes, starts = hashed_words(batch.column(1).to_pylist())
            keys = shingles(hashes, least)
            at = np.flatnonzero(in_filter(bitmap, keys))
            owner = np.searchsorted(starts, at, "right") - 1
            at, owner = at[at + least <= starts[owner + 1]], owner[at + least <= starts[owner + 1]]
            ids = batch.column(0).to_pylist()
            rows = ([], [], [])
            if len(at):
                for doc in np.unique(owner).tolist():
                    own = at[owner == doc] if len(at) < 1000 else at[np.searchsorted(owner, doc):np.searchsorted(owner, doc, "right")]
                    parts = []
                    for run_ in np.split(own, np.flatnonzero(np.diff(own) > least) + 1):
                        parts += [hashes[run_[0]:run_[-1] + least], np.zeros(1, np.uint64)]
                    rows[0].append(ids[doc])
                    rows[1].append(np.concatenate(parts[:-1]).view(np.int64))
                    rows[2].append(np.unique(keys[own]).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], longs), pa.array(rows[2], longs)],
                ["doc_id", "tokens", "seeds"],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id BIGINT, tokens ARRAY<BIGINT>, seeds ARRAY<BIGINT>")


def _tiled(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                item = batch.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                text = batch.column(3)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                found = tile(item, text, least)
                rows.append((
                    batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(item),
                    sum(x[0] for x in found), len(found), max((x[0] for x in found), default=0),
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)],
                ["doc_id", "item_id", "n_tokens", "matched", "n_tiles", "longest"],
            )

    return run


def contaminated(
    documents: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = COVERAGE
) -> DataFrame:
    """Pairs of ``documents(doc_id, text)`` and ``benchmark(item_id, text)`` at or above the threshold.

    Columns: ``doc_id, item_id, n_tokens, matched, n_tiles, longest, coverage``; tokens and
    tiles of the item.
    """
    # content keys, so that rows that share an id are kept apart and null ids join
    items = materialise(items_of(benchmark, least).withColumn("item_key", F.xxhash64("item_id", "tokens")), "items")
    seeds = materialise(seeds_of(items.dropDuplicates(["item_key"]), least), "seeds")
    docs = stretches(documents, seed_filter(seeds), least).withColumn("doc_key", F.xxhash64("doc_id", "tokens"))
    docs = materialise(docs, "stretches")
    # words of an item that shared seeds reach: the most that tiles can cover
    shared = (
        docs.select("doc_key", F.explode("seeds").alias("seed")).distinct()
        .join(seeds.select("seed", "item_key", "place"), "seed")
        .groupBy("doc_key", "item_key").agg(F.sort_array(F.collect_set("place")).alias("places"))
    )
    reach = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(least), F.coalesce(F.get("places", i + 1) - p, F.lit(least)))),
        F.lit(0), lambda acc, n: acc + n,
    )
    sides = items.dropDuplicates(["item_key"]).select("item_key", "item_id", F.col("tokens").alias("item_tokens"))
    pairs = (
        shared.select("doc_key", "item_key", reach.alias("reach"))
        .join(sides, "item_key").where(F.col("reach") >= F.size("item_tokens") * threshold)
        .join(docs.dropDuplicates(["doc_key"]).select("doc_key", "doc_id", F.col("tokens").alias("doc_tokens")), "doc_key")
    )
    tiled = pairs.select("doc_id", "item_id", "item_tokens", "doc_tokens").mapInArrow(_tiled(least), PAIRS)
    best = tiled.withColumn("coverage", F.col("matched") / F.col("n_tokens")).where(F.col("coverage") >= threshold)
    columns = ["n_tokens", "matched", "n_tiles", "longest", "coverage"]
    return best.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("coverage", "matched", "n_tokens", "n_tiles", "longest")).alias("b")
    ).select("doc_id", "item_id", *[F.col(f"b.{c}").alias(c) for c in columns])
