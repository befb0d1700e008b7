"""Near duplicates: MinHash bands propose, odd sketches screen, full shingle sets decide.

Every text becomes a set of hashed word shingles, ``SAMPLES`` MinHash values of it in bands of
``ROWS``, and an odd sketch: each (sample, value) flips one of ``SKETCH_BITS`` bits, so the bits
in which two sketches differ tell how many samples differ. A link at the threshold of 0.8 is
missed by all bands with odds of 1e-10, and turned away by the sketch, which asks for an estimate
of ``SCREEN`` only, with odds of about 1e-8.

Texts with equal sets are one class from the start. Classes that share a band are tied to that
band's smallest id (a star, never all pairs), and the components of these ties are closed: links
only lie within them. A component is compared in blocks of bounded size. One of many blocks first
compares everybody with their band's smallest id; a large group of near copies of one text is
then mostly connected in one linear step. Blocks only look at pairs that are not connected yet,
and give back a spanning forest of the links they find, not the links.

Defined results:

* a text of fewer words than a shingle: its whole word sequence is its only shingle;
* null, empty and blank texts: an empty set, linked with nothing;
* similarity of exactly the threshold: linked; component id: the smallest id reachable;
* rows that share an id are one document, linked through any of them (``n_shingles``: the largest);
  rows without id are one document without links, ``component_id`` null, kept;
* empty table: no rows; whole texts are read; extra columns are not.

Shingles are known by 64-bit hashes (two of n shingles of one comparison coincide with odds of
n * n / 2**65), sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import filter_bits, hashed_words, in_arrow, in_filter, mix, seed_filter, shingles, slices
from folioflow.llm.graph import EDGES, components
from folioflow.operators.shared import materialise

ROWS, BANDS = 3, 32
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
SCREEN = 0.5
PERCENT = 80
BLOCK = 8000  # classes compared with each other in one task
BLOCK_SHINGLES = 4_000_000  # and their shingles: a task sorts those of two blocks in place

_seeds = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = (_seeds[:SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SHIFTS = (_seeds[SAMPLES:] >> np.uint64(32)).astype(np.uint32)


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Ascending distinct shingles of a sequence of word hashes."""
    if 0 < len(hashes) < width:
        return shingles(hashes, len(hashes))
    return np.unique(shingles(hashes, width))


def samples(shingle: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    low = (shingle >> np.uint64(32)).astype(np.uint32) ^ shingle.astype(np.uint32)
    least = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 8192):
        values = low[None, at:at + 8192] * FACTORS[:, None] + SHIFTS[:, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key + rows[:, k] + np.uint64(0x9E3779B97F4A7C15))
    return key


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    place = mix(least.astype(np.uint64) + (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32)))
    parity = np.bincount((place % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def most_different(similarity: float = SCREEN) -> int:
    """Differing sketch bits to expect at a similarity."""
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - similarity))))


def _ids(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands`` per row; the last two null for empty sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "text", 1 << 22):
            hashes, starts = hashed_words(batch.column(1).to_pylist())
            sizes, keys, banded = [], [], []
            for a, b in zip(starts.tolist(), starts[1:].tolist()):
                s = shingle_set(hashes[a:b], width)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), banded.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                banded.append(bands(samples(s)).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                pa.array(banded, pa.list_(pa.int64())),
            ], ["doc_id", "n_shingles", "set_key", "bands"])

    return in_arrow(_ids(documents), run, "doc_id BIGINT, n_shingles BIGINT, set_key BINARY, bands ARRAY<BIGINT>")


def _possible(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows that may be among ``groups(doc_id)``, by a filter of their size: most other texts are not shuffled.

    Beyond some four million candidates there is no filter; the join alone then sorts out.
    """
    key = F.xxhash64("doc_id")
    bits = filter_bits(groups.count())
    if bits is None:
        return _ids(documents).where("doc_id IS NOT NULL")
    bitmap = seed_filter(groups.select(key.alias("seed")), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.select([0, 1]).filter(pa.array(in_filter(bitmap, keys)))

    return in_arrow(_ids(documents).where("doc_id IS NOT NULL").withColumn("_key", key), run, "doc_id BIGINT, text STRING")


def sets_of(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, root, shingles, sketch`` per row of ``documents(doc_id, text, root)`` with a set that is not
    empty; 64-bit numbers as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000, "text", 1 << 22):
            hashes, starts = hashed_words(batch.column(1).to_pylist())
            sets = [shingle_set(hashes[a:b], width) for a, b in zip(starts, starts[1:])]
            sketches = [odd_sketch(samples(s)).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sketches, pa.binary()),
            ], ["doc_id", "root", "shingles", "sketch"])

    return in_arrow(_ids(documents, "root"), run, "doc_id BIGINT, root BIGINT, shingles BINARY, sketch BINARY").where("sketch IS NOT NULL")


def linked(sets: list[np.ndarray], sketches: np.ndarray, sides: np.ndarray, known: np.ndarray, percent: int) -> np.ndarray:
    """Smallest member number each member is connected to.

    Members of different sides are compared (of side 0 alone if there is one), unless they are
    connected already; ``known`` numbers what is. Exact: sketches turn away pairs that are far
    from the threshold, the others' sets are counted.
    """
    n = len(sets)
    _, first, label = np.unique(known, return_index=True, return_inverse=True)
    label = first[label]
    sizes = np.array([len(s) for s in sets])
    # sorted in place, and numbers of half the width beside it: nothing else of that size is held
    flat = np.concatenate(sets)
    flat.sort()
    kinds = flat[np.concatenate([[True], flat[1:] != flat[:-1]])]
    del flat
    ids = [np.searchsorted(kinds, s).astype(np.uint32) for s in sets]
    flag = np.zeros(len(kinds), bool)
    del kinds
    limit = most_different()
    single = not sides.any()
    for i in range(n - 1):
        near = label[i + 1:] != label[i]
        if not single:
            near &= sides[i + 1:] != sides[i]
        # a large share of the union needs sizes that are close
        near &= 100 * np.minimum(sizes[i + 1:], sizes[i]) >= percent * np.maximum(sizes[i + 1:], sizes[i])
        rest = np.flatnonzero(near) + i + 1
        if len(rest):
            rest = rest[np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1) <= limit]
        if not len(rest):
            continue
        flag[ids[i]] = True
        for part in np.array_split(rest, int(sizes[rest].sum()) // 2_000_000 + 1):
            hits = flag[np.concatenate([ids[j] for j in part])]
            both = np.add.reduceat(hits.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            met = part[100 * both >= percent * (sizes[part] + sizes[i] - both)]
            if len(met):
                joined = np.unique(np.append(label[met], label[i]))
                label[np.isin(label, joined)] = joined[0]
        flag[ids[i]] = False
    return label


def _numbers(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The 64-bit numbers of each row of a binary column, without a copy."""
    out = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1].tolist() if len(chunk) else [0]
        data = chunk.buffers()[2]
        out += [np.frombuffer(data, np.uint64, (b - a) // 8, a) for a, b in zip(ends, ends[1:])]
    return out


def _compare(percent: int):
    """Every member of a group that is connected to a smaller one, and the smallest one."""
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        every, wide = _numbers(group.column("shingles")), _numbers(group.column("sketch"))
        sets = [every[i] for i in order.tolist()]
        label = linked(sets, np.stack(wide)[order], group.column("side").to_numpy()[order], group.column("known").to_numpy()[order], percent)
        found = ids[label]
        # members of several rows may have several labels: all of them are kept
        return pa.table({"u": pa.array(ids[found != ids]), "v": pa.array(found[found != ids])})

    return run


def _similar(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, limit = [], most_different()
            for a, b, p, q in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if np.bitwise_count(np.frombuffer(p, np.uint64) ^ np.frombuffer(q, np.uint64)).sum() > limit:
                    keep.append(False)
                    continue
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["u", "v"])

    return run


def links(documents: DataFrame, reps: DataFrame, width: int, percent: int, block: int = BLOCK) -> tuple[DataFrame, bool]:
    """``u, v``: trees of the links between classes, and whether they are of depth one already.

    ``reps(doc_id, bands)`` has the smallest document of every class, ``documents`` their texts.
    """
    keyed = reps.select("doc_id", F.explode("bands").alias("band"))
    pivots = keyed.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last")
    stars = materialise(
        keyed.join(pivots.drop("last"), "band").where("doc_id <> pivot").select("doc_id", "pivot").distinct(), "stars"
    )
    found = components(stars.select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")))
    groups = found.select(F.col("node").alias("doc_id"), "root").unionByName(found.select(F.col("root").alias("doc_id"), "root").distinct())
    # the texts of candidates only
    groups = materialise(groups, "groups")
    # dealt by id before they meet, as a large join does anyway: one task would else keep two Python workers busy
    texts = _possible(documents, groups).repartition("doc_id")
    sets = materialise(sets_of(texts.join(groups, "doc_id"), width), "sets")
    sizes = sets.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum(F.length("shingles") / 8).alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / block, F.least(F.col("members").cast("double"), F.col("shingles") / BLOCK_SHINGLES)))
    large = materialise(sizes.select("root", blocks.cast("int").alias("blocks")).where("blocks > 1"), "large")
    alone = [F.lit(0).alias("side"), F.col("doc_id").alias("known")]
    if not large.take(1):
        whole = sets.select("root", "doc_id", "shingles", "sketch", *alone)
        return whole.groupBy("root").applyInArrow(_compare(percent), EDGES), True
    small = sets.join(large.select("root"), "root", "left_anti").select("root", "doc_id", "shingles", "sketch", *alone)
    compared = small.groupBy("root").applyInArrow(_compare(percent), EDGES)
    wide = materialise(sets.join(large, "root"), "wide")
    ties = materialise(_star_links(stars, wide, percent), "ties")
    joined = components(ties).select(F.col("node").alias("doc_id"), F.col("root").alias("known"))
    labelled = wide.join(joined, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id"))
    apart = (
        labelled.groupBy("root").agg(F.min("known").alias("a"), F.max("known").alias("b"))
        .where("a < b").select("root")
    )
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("bigint")).cast("int")
    tasks = labelled.join(apart, "root", "left_semi").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select(
        "root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "doc_id", "shingles", "sketch", "known",
    )
    across = tasks.groupBy("root", "a", "b").applyInArrow(_compare(percent), EDGES)
    return compared.unionByName(ties).unionByName(across), False


def _star_links(stars: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Links between members of large components and the smallest ids of their bands.

    The set of a band's smallest id is dealt out in as many pieces as its component has blocks.
    """
    mine = wide.select("doc_id", F.col("shingles").alias("mine"), F.col("sketch").alias("my_sketch"), F.pmod(
        F.xxhash64("doc_id"), F.col("blocks").cast("bigint")).cast("int").alias("piece"))
    centres = stars.select("pivot").distinct().join(wide.withColumnRenamed("doc_id", "pivot"), "pivot").select(
        "pivot", F.col("shingles").alias("theirs"), F.col("sketch").alias("their_sketch"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("piece"))
    pairs = stars.join(mine, "doc_id").join(centres, ["pivot", "piece"])
    return in_arrow(pairs.select("doc_id", "pivot", "mine", "theirs", "my_sketch", "their_sketch"), _similar(percent), EDGES)


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document of ``documents(doc_id, text)``."""
    signed = materialise(signatures(documents, width), "signatures")
    owned = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = materialise(
        owned.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes"
    )
    ties, finished = links(documents, classes.select(F.col("rep").alias("doc_id"), "bands"), width, percent, block)
    # a document with several texts ties their classes
    several = materialise(
        owned.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b"), "several"
    )
    if several.take(1):
        texts = owned.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_key").join(classes, "set_key")
        ties, finished = ties.unionByName(texts.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))), False
    found = ties.select(F.col("u").alias("node"), F.col("v").alias("root")) if finished else components(ties)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("root", "rep").alias("component"))
    # one row of the right side per class: a class with very many copies is split as a skewed join
    rows = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    done = rows.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return done.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
