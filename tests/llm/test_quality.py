import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import quality


def corpus(n=400, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(["re", "an", "the", "io"], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.75
        if not good:
            kind = rng.randrange(3)
            words = [w + "###" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else words[:3] * 20
        rows.append((i, " ".join(words).capitalize() + "."))
        if rng.random() < 0.5:
            labels.append((i, int(good)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    more = [(9000, None), (9001, ""), (None, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows + more], "doc_id BIGINT, text STRING, x STRING").repartition(4)
    known = spark.createDataFrame(labels + [labels[0], (8888, 1), (None, 1), (5, None)], "doc_id BIGINT, label INT")
    got = quality.classify(docs, known, F.col("doc_id") % 5 != 0).collect()
    assert len(got) == len(rows) + len(more)
    score = {r["doc_id"]: r["score"] for r in got}
    assert all(0 <= s <= 1 for s in score.values()) and all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(score[i], y) for i, y in labels if i % 5 == 0]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.3) == bool(y) for s, y in held]) > 0.8


def test_sums_are_those_of_the_risk(spark):
    rng = np.random.default_rng(1)
    x = rng.random((50, len(quality.MEASURES))).astype(np.float32)
    positive = rng.random(50) < 0.4
    table = spark.createDataFrame([(a.tolist(), bool(p)) for a, p in zip(x, positive)], "x ARRAY<FLOAT>, positive BOOLEAN")
    edges = [np.array([0.3, 0.6], np.float32)] * len(quality.MEASURES)
    weights = rng.normal(size=len(quality.MEASURES) * quality.BINS + 1)
    got = quality.sums(table, edges, weights)

    def risk(w, rows, sign):
        f = w[quality.binned(x[rows], edges)].sum(axis=1) + w[-1]
        return np.logaddexp(0, -sign * f).sum()

    for k, (rows, sign) in enumerate(((positive, 1), (positive, -1), (np.ones(50, bool), -1))):
        assert got[k, 0] == rows.sum() and np.isclose(got[k, 1], risk(weights, rows, sign))
        for place in (0, 1, 2, quality.BINS, len(weights) - 1):
            moved = weights.copy()
            moved[place] += 1e-5
            assert np.isclose(got[k, 2 + place], (risk(moved, rows, sign) - risk(weights, rows, sign)) / 1e-5, atol=1e-3)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id BIGINT, text STRING")
    none = spark.createDataFrame([], "doc_id BIGINT, label INT")
    assert {r["score"] for r in quality.classify(docs, none, F.lit(True)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), none, F.lit(True)).count() == 0


def test_measures_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["a b c a b c", None, "", "One line.\nOne line.\n\nx", "é" * 50, "w " * 30]
    together = quality.measure(texts)
    assert all(np.allclose(quality.measure([t])[0], row) for t, row in zip(texts, together))
