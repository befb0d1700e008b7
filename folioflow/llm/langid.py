"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product of its letters'
vectors, each rotated by its place (bind and permute); a text is the sum of its n-grams (bundle);
a language is the sum of the n-grams of its training texts. A text belongs to the language
whose prototype has the largest cosine with it.

Letter vectors are drawn from the code point and ``SEED`` alone, so no table of letters is kept
and every task, run and machine draws the same ones. The driver receives one vector per language
(``DIMENSIONS`` numbers); ``MAX_LANGUAGES`` bounds what travels to the tasks and is checked.

Defined results:

* null text or text without a letter: ``und`` with score 0;
* texts with letters but no language learnt: ``und`` with score 0;
* ties between languages: the name that sorts first;
* whole texts are read, in pieces when they are long; repeated rows are predicted alike, one row
  each; null ids are predicted like any other, and count as the text ``""`` in the fold;
* null languages are never learnt; empty table: no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import in_arrow, slices

DIMENSIONS = 1024
ORDER = 3
SEED = 1
MAX_LANGUAGES = 4096
UNKNOWN = "und"
FLOOR = 0.2  # cosine from which on a text speaks one of the languages; texts of sf0.1 with that evidence have 0.28 at least
EVIDENCE = 64  # distinct n-grams from which on a low cosine says something
ROWS = 512
BYTES = 1 << 21
KINDS = 2048  # n-gram vectors held at a time
PIECE = 1 << 18  # code points counted at a time
BITS = np.uint64(21)  # of a code point


@lru_cache(1 << 14)
def letter_vector(code: int, place: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of a letter, rotated ``place`` times."""
    drawn = np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8)
    return np.roll(2 * drawn - 1, place)


def ngram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS, order: int = ORDER) -> np.ndarray:
    """One row per n-gram: the product of its letters' rotated vectors."""
    low = np.uint64((1 << 21) - 1)
    out = np.ones((len(grams), dimensions), np.int8)
    for place in range(order):
        codes = (grams >> (BITS * np.uint64(place))) & low
        kinds, which = np.unique(codes, return_inverse=True)
        out *= np.stack([letter_vector(int(c), place, dimensions) for c in kinds])[which]
    return out


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            table[code] = ord(char.lower()[0])
    return table


def gram_counts(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of letter n-grams: ``text, gram, count`` and whether a text has a letter.

    A run of letters is framed by word ends (code 0). N-grams never span two words.
    """
    rows, grams, counts = [], [], []
    lettered = np.zeros(len(texts), bool)
    space = np.zeros(1, np.uint32)
    owner, codes = [], []

    def flush() -> None:
        if not codes:
            return
        flat, who = np.concatenate(codes), np.concatenate(owner)
        keep = np.ones(len(flat), bool)
        # one end between words
        keep[1:] = (flat[1:] > 0) | (flat[:-1] > 0) | (who[1:] != who[:-1])
        flat, who = flat[keep].astype(np.uint64), who[keep]
        n = len(flat) - order + 1
        if n > 0:
            key = np.zeros(n, np.uint64)
            fits = np.ones(n, bool)
            for place in range(order):
                part = flat[place:place + n]
                key |= part << (BITS * np.uint64(place))
                if 0 < place < order - 1:
                    fits &= part > 0
            # a middle letter within one text; ends only at the borders
            fits &= who[:n] == who[order - 1:]
            kinds, which = np.unique(key[fits], return_inverse=True)
            cell = who[:n][fits].astype(np.int64) * len(kinds) + which
            cells, times = np.unique(cell, return_counts=True)
            rows.append(cells // len(kinds))
            grams.append(kinds[cells % len(kinds)])
            counts.append(times)
        codes.clear()
        owner.clear()

    held = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = _letters()[points]
        lettered[i] = found.any()
        framed = np.concatenate([space, found, space])
        if len(framed) > PIECE:
            flush()
            held = 0
            for at in range(0, len(framed), PIECE):
                part = framed[max(0, at - order + 1):at + PIECE]
                codes.append(part)
                owner.append(np.full(len(part), i, np.int32))
                flush()
            continue
        codes.append(framed)
        owner.append(np.full(len(framed), i, np.int32))
        held += len(framed)
        if held > PIECE:
            flush()
            held = 0
    flush()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), lettered
    return np.concatenate(rows), np.concatenate(grams), np.concatenate(counts), lettered


def bundled(
    n: int, rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, dimensions: int = DIMENSIONS, order: int = ORDER
) -> np.ndarray:
    """``n`` sums of n-gram vectors: ``counts`` of ``grams`` by ``rows``."""
    out = np.zeros((n, dimensions), np.float32)
    if len(grams):
        kinds, which = np.unique(grams, return_inverse=True)
        for at in range(0, len(kinds), KINDS):
            inside = (which >= at) & (which < at + KINDS)
            block = ngram_vectors(kinds[at:at + KINDS], dimensions, order).astype(np.float32)
            weights = np.zeros((n, len(block)), np.float32)
            np.add.at(weights, (rows[inside], which[inside] - at), counts[inside])
            out += weights @ block
    return out


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bundle per language and task."""
    sums: dict[str, np.ndarray] = {}
    for batch in slices(batches, ROWS, "text", BYTES):
        names, which = np.unique(np.array(batch.column(1).to_pylist(), str), return_inverse=True)
        rows, grams, counts, _ = gram_counts(batch.column(0).to_pylist())
        for name, part in zip(names.tolist(), bundled(len(names), which[rows], grams, counts), strict=True):
            sums[name] = sums.get(name, 0) + part.astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
        ["lang", "bundle"],
    )


def learn(documents: DataFrame, max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Unit prototypes of all languages in ``documents(text, lang)``."""
    rows = documents.where(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    parts = in_arrow(rows, _bundles, "lang STRING, bundle ARRAY<DOUBLE>")
    # sums by place, so that what meets is numbers, not vectors of every task
    total = parts.select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    whole = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("bundle"))
    found = whole.select("lang", F.transform("bundle", lambda b: b["x"]).alias("bundle")).take(max_languages + 1)
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    out = {}
    for row in sorted(found, key=lambda r: r["lang"]):
        vector = np.array(row["bundle"])
        norm = np.linalg.norm(vector)
        if norm > 0:
            out[row["lang"]] = (vector / norm).astype(np.float32)
    return out


def _judged(texts: list[str | None], names: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, scores and distinct n-grams of texts; ``names`` has ``UNKNOWN`` after the names of the matrix' rows."""
    rows, grams, counts, lettered = gram_counts(texts)
    kinds = np.bincount(rows, minlength=len(texts))
    vectors = bundled(len(texts), rows, grams, counts)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    np.divide(vectors, norm, out=vectors, where=norm > 0)
    if not len(matrix):
        return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), kinds
    cosine = np.round(vectors @ matrix.T, 5)  # names decide between equals
    best = np.where(lettered, cosine.argmax(axis=1), len(matrix))
    return names[best], np.where(lettered, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0), kinds


def _arrays(prototypes: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    names = np.array([*prototypes, UNKNOWN], object)
    return names, np.stack(list(prototypes.values())) if prototypes else np.zeros((0, DIMENSIONS), np.float32)


def predict(documents: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score`` per row; the score is the cosine, 0 where it is negative."""
    names, matrix = _arrays(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS, "text", BYTES):
            found, score, _ = _judged(batch.column(1).to_pylist(), names, matrix)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(texts, run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def recognised(documents: DataFrame, prototypes: dict[str, np.ndarray], least: float = FLOOR, evidence: int = EVIDENCE) -> DataFrame:
    """The rows of ``documents`` whose language is known; all columns, no shuffle.

    Left out are texts without letters, and those of at least ``evidence`` distinct n-grams whose cosine
    with every prototype stays below ``least``: noise, and languages that were not learnt. Shorter texts
    say too little to be rejected.
    """
    names, matrix = _arrays(prototypes)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS, "text", BYTES):
            found, score, kinds = _judged(batch.column(at).to_pylist(), names, matrix)
            yield batch.filter(pa.array((found != UNKNOWN) & ((score >= least) | (kinds < evidence)), pa.bool_()))

    return in_arrow(documents, run, documents.schema)


def identify(documents: DataFrame, train: Column) -> DataFrame:
    """Learn from the rows of ``documents(doc_id, text, lang)`` where ``train`` holds, predict all."""
    return predict(documents, learn(documents.where(train)))
