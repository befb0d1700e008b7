import random

import pytest

from folioflow.llm import neardup
from folioflow.llm.graph import components
from folioflow.operators.shared import materialise


def shingle_set(text, width):
    ws = (text or "").encode().lower().split()
    if not ws:
        return frozenset()
    if len(ws) < width:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i:i + width]) for i in range(len(ws) - width + 1))


def brute(rows, width, percent=80):
    sets = [(i, shingle_set(t, width)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(sets[a][0]), root(sets[b][0])))
                parent[q] = p
    size = {}
    for i, s in sets:
        size[i] = max(size.get(i, 0), len(s))
    return {i: (size[i], root(i)) for i in parent}


def texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choices(vocab, k=rng.randint(30, 120)) for _ in range(12)]
    for b in base:
        for _ in range(9):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(c) // 25))):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            rows.append(" ".join(c))
    rows += [" ".join(rng.choices(vocab, k=60)) for _ in range(30)]
    # a chain whose ends are far apart, and a group of ring members around a centre
    chain = rng.choices(vocab, k=100)
    for k in range(12):
        rows.append(" ".join(chain))
        chain[8 * k] = f"new{k}"
    rows += [rows[0]] * 40 + [rows[0].upper()] + ["", " ", None, "one", "One", "two words", "a b c", "A b  c", "a b d"]
    rng.shuffle(rows)
    out = [(1000 + 7 * i, t) for i, t in enumerate(rows)]
    return out + [out[0], (out[5][0], out[60][1]), (None, rows[0]), (None, None)]


@pytest.mark.parametrize(("width", "block", "repeats"), [(4, 1000, True), (4, 1000, False), (5, 7, True), (5, 7, False)])
def test_components_match_brute_force(spark, width, block, repeats):
    rows = texts() if repeats else [*dict(texts()[:-4]).items(), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id BIGINT, text STRING, band STRING, root INT")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, width, block=block).collect()}
    assert got.pop(None)["kept"] is True
    want = brute(rows, width)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert neardup.near_duplicates(docs).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, i) for i in range(501, 560)] + [(7, 7), (60, 61), (900, 800)]
    df = spark.createDataFrame(edges, "u BIGINT, v BIGINT")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 1 for i in range(2, 62)}, **{i: 500 for i in range(501, 560)}, 900: 800}


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        common = int(4000 * 2 * share / (1 + share))
        y = np.concatenate([x[:common], rng.integers(0, 1 << 63, 4000 - common, dtype=np.uint64)])
        diff = int(np.bitwise_count(neardup.odd_sketch(neardup.samples(x)) ^ neardup.odd_sketch(neardup.samples(y))).sum())
        assert abs(diff - neardup.most_different(share)) < 45


def test_texts_of_candidates_are_dealt_before_their_sets_are_made(spark, monkeypatch):
    """Two Python nodes in one stage would keep two workers per core."""
    plans = {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return materialise(df, label)

    monkeypatch.setattr(neardup, "materialise", seen)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "of its own kind")], "doc_id BIGINT, text STRING")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
    lines = plans["sets"].splitlines()
    above, below = (i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert any("Exchange hashpartitioning" in line for line in lines[above:below])
