import random

import numpy as np
import pytest

from folioflow.llm import decontam


def brute_tiles(item, text, least):
    """Greedy string tiling by comparing all places."""
    free_i, free_t = [True] * len(item), [True] * len(text)
    total = 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and free_i[p + k] and free_t[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, t)
        k, p, t = best
        if k < least:
            return total
        for x in range(k):
            free_i[p + x] = free_t[t + x] = False
        total += k


@pytest.mark.parametrize("seed", range(6))
def test_tiles_cover_what_greedy_tiling_covers(seed):
    rng = random.Random(seed)
    item = [rng.randint(1, 9) for _ in range(60)]
    text = []
    for _ in range(5):
        a = rng.randrange(50)
        text += item[a:a + rng.randint(3, 30)] + [rng.randint(10, 20) for _ in range(rng.randint(0, 5))]
    found = decontam.tile(np.array(item, np.uint64), np.array(text, np.uint64), 4)
    places = [p + k for n, p, _ in found for k in range(n)]
    spots = [t + k for n, _, t in found for k in range(n)]
    assert len(set(places)) == len(places) and len(set(spots)) == len(spots)
    assert all(item[p + k] == text[t + k] for n, p, t in found for k in range(n)) and all(n >= 4 for n, *_ in found)
    assert sum(n for n, *_ in found) == brute_tiles(item, text, 4)


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly box five jugs of liquor near a frozen lake"


def documents():
    ws = ITEM.split()
    parts = [ws[i:i + 7] for i in range(0, 21, 7)]
    return [
        (1, ITEM), (2, "before " * 30 + ITEM.upper() + " after" * 30), (3, " ".join(sum(reversed(parts), []))),
        (4, " ".join(ws[:6]) + " nothing else here"), (5, " ".join(ws[::-1])), (6, None), (7, ""), (8, "plain prose " * 50),
        (9, " filler ".join(" ".join(p) for p in parts)), (None, ITEM), (1, ITEM),
    ]


def test_copies_and_reordered_passages_are_caught(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in documents()], "doc_id BIGINT, text STRING, seed STRING, reach INT")
    items = [(10, ITEM), (11, "too short item"), (12, None), (13, "another item that no document holds at all in any order")]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id BIGINT, text STRING, doc_id INT")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs, bench).collect()}
    assert {i for i, _ in got} == {1, 2, 3, 9, None} and {j for _, j in got} == {10}
    assert got[(2, 10)]["coverage"] == 1.0 and got[(2, 10)]["n_tiles"] == 1
    assert got[(3, 10)]["n_tiles"] == 3 and got[(3, 10)]["coverage"] >= 0.9


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(documents(), "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(10, ITEM)], "item_id BIGINT, text STRING")
    items = decontam.items_of(bench).withColumn("item_key", decontam.F.lit(1).cast("bigint"))
    small = decontam.seed_filter(decontam.seeds_of(items), bits=6)
    assert small.shape == (1,)
    monkeypatch.setattr(decontam, "seed_filter", lambda seeds, bits=0: np.full(1 << 10, 2**64 - 1, np.uint64))
    got = {r["doc_id"] for r in decontam.contaminated(docs, bench).collect()}
    assert got == {1, 2, 3, 9, None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontam.contaminated(docs, bench).count() == 0
