import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from folioflow.llm import periods


def by_definition(words):
    """All runs ``(start, period, length)``: every maximal stretch of every period, smallest period tried first."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            stretch = words[start:start + length]
            smaller = any(all(stretch[j] == stretch[j + d] for j in range(length - d)) for d in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                out.append((start, q, length))
    return sorted(out)


def row_by_definition(doc_id, text):
    words = (text or "").encode().split()
    order = periods.looped(doc_id, len(words))
    words = words if order is None else [words[i] for i in order]
    runs = by_definition(words)
    dropped = {i for s, q, n in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
    best = (None,) * 4
    if runs:
        s, q, n = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]))
        best = (s, n, q, 1000 * n // q)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def results(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id BIGINT, text STRING, key STRING, n INT")
    return sorted(map(tuple, periods.runs_of(docs, periods.looped).collect()), key=repr)


def texts(seed, n):
    """Words of few kinds, with stretches of all periods, nested, touching, and at both ends."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < rng.choice([5, 60, 300]):
            kind = rng.random()
            unit = [rng.choice("abcdefgh"[:rng.randint(1, 8)]) for _ in range(rng.choice([1, 1, 2, 3, 4, 7, 8, 13, 31, 40]))]
            words += unit * rng.choice([1, 2, 3, 5, 24]) + unit[:rng.randint(0, len(unit))] if kind < 0.6 else unit * 3
            if kind > 0.8:
                words = words * 3
        out.append(" ".join(words[:700]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_are_those_of_the_definition(spark, seed):
    rows = list(enumerate(texts(seed, 40)))
    assert results(spark, rows) == sorted((row_by_definition(*r) for r in rows), key=repr)


def test_given_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, " ".join(t.split()[:1500])) for i, t in rows if t]
    assert results(spark, short) == sorted((row_by_definition(*r) for r in short), key=repr)


def test_nulls_blanks_repeats_and_one_id_with_two_texts(spark):
    loop = "a b c " * 20
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, loop), (None, loop), (4, loop), (4, loop), (4, loop + "d"), (5, "é x\x0by " * 30), (None, None)]
    got = results(spark, rows)
    assert got == sorted((row_by_definition(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) >= 6
    assert results(spark, []) == []


def test_long_texts_are_cut_into_strips(spark, monkeypatch):
    rng = np.random.default_rng(5)
    body = [f"w{i}" for i in rng.integers(0, 5_000, 60_000)]
    unit = [f"u{i}" for i in rng.integers(0, 900, 7_001)]
    words = body[:20_000] + unit * 5 + ["z"] * 50_000 + body[20_000:]
    got = results(spark, [(8, " ".join(words))])[0]
    order = periods.looped(8, len(words))
    assert order is None and got[1] == 2
    assert got[2:6] == (20_000 + 35_005, 50_000, 1, 50_000_000)
    runs = f"20000,35005,7001\n{55_005},50000,1\n"
    assert got[6] == hashlib.sha256(runs.encode()).hexdigest()
    kept = body[:20_000] + unit + ["z"] + body[20_000:]
    assert got[7] == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_tiles_are_made_only_where_stretches_recur():
    hashes = np.arange(1000, dtype=np.uint64)
    assert periods.evidence(hashes, np.array([0, 400, 1000])) == []
    twice = np.concatenate([np.arange(100), np.arange(100)]).astype(np.uint64)
    assert periods.evidence(twice, np.array([0, 200])) == [], "a distance beyond a third of the text is no period"
    assert len(periods.evidence(np.tile(np.arange(10), 10).astype(np.uint64), np.array([0, 100]))) == 1


def test_order_of_the_contract():
    doc_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    g, n = zlib.crc32(str(doc_id).encode()) // 10, 137
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    assert periods.looped(doc_id, n).tolist() == [i if i < a else a + (i - a) % p for i in range(n)]
    assert periods.looped(None, 5) is None and periods.looped(doc_id, 0) is None
