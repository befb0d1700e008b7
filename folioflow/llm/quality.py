"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that the risk sees: with class prior ``p`` the
non-negative unbiased risk is ``p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-))`` under the logistic
loss. It is minimised over all documents: every step is one pass over a small written table of
binned text measurements whose sums (a few hundred numbers) go to the driver. Nothing is sampled.

The model is additive: every measurement has ``BINS`` bins at quantiles over all texts, and each
bin a weight. The class prior is estimated as the share of positives among the labelled rows.

Defined results:

* null or empty texts: measured as 0 throughout and scored like any other;
* no positives, or an empty table: every weight stays 0 and the score is the prior;
* no labelled rows: the prior is ``DEFAULT_PRIOR``; a label given twice counts by its largest value;
* null ids never meet a label but are scored; repeated rows are scored alike, one row each;
* a score of exactly the threshold is predicted 1; whole texts are read; extra columns are not.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import hashed_words, shingles, slices
from folioflow.operators.shared import materialise

BINS = 16
STEPS = 30
RATE = 0.5
RIDGE = 1e-4
THRESHOLD = 0.3
DEFAULT_PRIOR = 0.5
SYMBOLS, MARKS, STOPS = "#*$%&|<>", "!?", ".,;:"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "mark", "stop", "rest")
MEASURES = (
    *(f"share_{c}" for c in CLASSES), "upper_of_letters", "log_words", "word_bytes", "longest_word", "distinct_words",
    "same_as_before", "repeated_windows", "same_lines", "words_per_line",
)


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, len(CLASSES) - 1, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            table[code] = 1 if kind in ("Lu", "Lt") else 0
        elif kind == "Nd":
            table[code] = 2
        elif kind[0] == "Z" or code in (9, 10, 11, 12, 13):
            table[code] = 3
    for group, place in ((SYMBOLS, 4), (MARKS, 5), (STOPS, 6)):
        table[[ord(c) for c in group]] = place
    return table


def _per_text(n: int, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Number of different keys per owner; ``owner`` ascends."""
    if not len(keys):
        return np.zeros(n)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    first = np.ones(len(k), bool)
    first[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    return np.bincount(o[first], minlength=n).astype(float)


def measure(texts: list[str | None]) -> np.ndarray:
    """``MEASURES`` of each text, one row per text."""
    n = len(texts)
    out = np.zeros((n, len(MEASURES)))
    for i, text in enumerate(texts):
        if text:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            out[i, :len(CLASSES)] = np.bincount(_classes()[points], minlength=len(CLASSES)) / len(points)
            lines = [x for x in text.split("\n") if x.strip()]
            out[i, -2] = 1 - len(set(lines)) / len(lines) if lines else 0.0
            out[i, -1] = len(lines)
    hashes, starts = hashed_words(texts)
    count = np.diff(starts)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    letters = out[:, 0] + out[:, 1]
    k = len(CLASSES)
    out[:, k] = np.divide(out[:, 1], letters, out=np.zeros(n), where=letters > 0)
    out[:, k + 1] = np.log1p(count)
    for i, text in enumerate(texts):
        if count[i]:
            sizes = list(map(len, text.split()))
            out[i, k + 2] = sum(sizes) / max(len(sizes), 1)
            out[i, k + 3] = np.log1p(max(sizes, default=0))
    out[:, k + 4] = np.where(count > 0, _per_text(n, owner, hashes) / some, 1.0)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, k + 5] = np.bincount(owner[same], minlength=n) / some
    windows = shingles(hashes, 3)
    inside = owner[:len(windows)] == owner[2:] if len(windows) else np.zeros(0, bool)
    holder = owner[:len(windows)][inside]
    held = np.bincount(holder, minlength=n)
    distinct = _per_text(n, holder, windows[inside])
    out[:, k + 6] = np.where(held > 0, 1 - distinct / np.maximum(held, 1), 0.0)
    out[:, -1] = np.where(out[:, -1] > 0, np.log1p(count / np.maximum(out[:, -1], 1)), 0.0)
    return out


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, x ARRAY<FLOAT>`` per row of ``documents(doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500, "text", 1 << 21):
            x = measure(batch.column(1).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"]
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id BIGINT, x ARRAY<FLOAT>")


def bin_edges(table: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Quantiles over all rows, per measurement, without repetition."""
    shares = [i / bins for i in range(1, bins)]
    row = table.agg(*[
        F.percentile_approx(F.col("x")[j], shares, 1000).alias(f"q{j}") for j in range(len(MEASURES))
    ]).first()
    return [np.unique(np.array(row[f"q{j}"] or [], np.float32)) for j in range(len(MEASURES))]


def binned(x: np.ndarray, edges: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Number of the weight of each measurement of each row."""
    out = np.empty(x.shape, np.int64)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j], "right") + j * bins
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(MEASURES))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -50, 50)))


class Model:
    """Bins, weights (the last one is the bias) and the class prior."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, prior: float) -> None:
        self.edges, self.weights, self.prior = edges, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[binned(x, self.edges)].sum(axis=1) + self.weights[-1])


def sums(table: DataFrame, edges: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Risks, counts and gradients over ``table(x, positive)``, in one pass; rows of
    (positives as +, positives as -, unlabelled as -): ``[count, risk, gradient…]``."""
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, size + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            at = binned(_matrix(batch.column(0)), edges)
            f = weights[at].sum(axis=1) + weights[-1]
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for k, (rows, sign) in enumerate(((trusted, 1), (trusted, -1), (np.ones(len(f), bool), -1))):
                slope = -sign * _sigmoid(-sign * f[rows])
                total[k, 0] += rows.sum()
                total[k, 1] += np.logaddexp(0, -sign * f[rows]).sum()
                total[k, 2:-1] += np.bincount(at[rows].ravel(), np.repeat(slope, at.shape[1]), minlength=size - 1)
                total[k, -1] += slope.sum()
        places = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total.ravel())], ["place", "v"])

    parts = table.select("x", "positive").mapInArrow(run, "place INT, v DOUBLE")
    out = np.zeros(3 * (size + 2))
    for row in parts.groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[row["place"]] = row["v"]
    return out.reshape(3, size + 2)


def minimise(table: DataFrame, edges: list[np.ndarray], prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of the least non-negative risk: full gradients with adaptive steps."""
    weights = np.zeros(len(MEASURES) * BINS + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        (n_pos, risk, up), (_, risk_neg, down), (n_all, risk_all, all_down) = (
            (s[0], s[1], s[2:]) for s in sums(table, edges, weights)
        )
        if not n_pos:
            break
        negative = risk_all / n_all - prior * risk_neg / n_pos
        down = all_down / n_all - prior * down / n_pos
        # where the estimated negative risk falls below 0, step back from it
        gradient = prior * up / n_pos + down if negative >= 0 else -down
        gradient[:-1] += RIDGE * weights[:-1]
        first = 0.8 * first + 0.2 * gradient
        second = 0.95 * second + 0.05 * gradient**2
        slope = (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-6)
        weights -= RATE * (1 - (step - 1) / steps) * slope
    return weights


def fit(table: DataFrame, labels: DataFrame, steps: int = STEPS) -> Model:
    """Learn from ``table(doc_id, x)``, all of it unlabelled text, and ``labels(doc_id, label)``."""
    known = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = known.agg(F.avg(F.col("label").cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    prior = DEFAULT_PRIOR if not share["n"] else min(max(share["p"], 0.05), 0.95)
    edges = bin_edges(table)
    trusted = known.where("label = 1").select("doc_id", F.lit(True).alias("positive"))
    marked = table.join(trusted, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    return Model(edges, minimise(materialise(marked, "marked"), edges, prior, steps), prior)


def predict(table: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` per row of ``table(doc_id, x)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
            ], ["doc_id", "score", "predicted"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id BIGINT, score DOUBLE, predicted INT")


def classify(documents: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """Scores of all ``documents(doc_id, text)``; ``train`` says which rows of ``labels`` may be learnt."""
    table = materialise(measured(documents), "measures")
    return predict(table, fit(table, labels.where(train)))
