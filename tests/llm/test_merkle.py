import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.llm import merkle
from folioflow.llm.common import fold

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, tree STRING, leaf INT"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root of a list of digests, and for each of them the siblings left and right on every level."""
    steps = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for at in range(0, len(nodes), 16):
            run = nodes[at:at + 16]
            for i in range(len(run)):
                for leaf_no in below[at + i]:
                    steps[leaf_no].append((run[:i], run[i + 1:]))
        below = [sum(below[at:at + 16], []) for at in range(0, len(nodes), 16)]
        nodes = [sha("".join(nodes[at:at + 16])) for at in range(0, len(nodes), 16)]
    return nodes[0], steps


def by_definition(rows):
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        lowered = text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        hit = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
        first = leaf(doc_id, source, lang, n_chars, text)
        sources.setdefault(source, []).append((doc_id, first, leaf(doc_id, source, lang, n_chars, lowered) if hit else first))
    ordered = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in ordered:
        sources[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    trees = {s: climb([d[1] for d in sources[s]]) for s in ordered}
    if not ordered:
        return []
    root, over = climb([trees[s][0] for s in ordered])
    out = []
    for s, upper in zip(ordered, over):
        for (doc_id, first, presented), own in zip(sources[s], trees[s][1]):
            d = presented
            for left, right in own + upper:
                d = sha("".join([*left, d, *right]))
            proof = sha("".join(x for left, right in own + upper for x in left + right))
            out.append((doc_id, first, trees[s][0], root, proof, d, d == root))
    return sorted(out, key=repr)


def results(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    return sorted(map(tuple, merkle.manifest(docs, fold(F.col("doc_id"), 5) == 0).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [300, 16, 1, 257, 2], [1] * 40])
def test_proofs_are_those_of_the_definition(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6), f"Text {i} Ä", rng.choice(["en", None]), None if s == 0 else f"s{s:x}é", i)
            for s, n in enumerate(sizes) for i in range(n)]
    got = results(spark, rows)
    assert got == by_definition(rows)
    assert len(rows) < 30 or {r[-1] for r in got} == {True, False}


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (None, "B", None, None, None), (5, "A", "en", "", 1), (5, "A", "en", "", 1), (5, "B", "en", "", 1),
            (0, "", "", "-", 0), (-3, "x" * 100_000, "de", "z", 9)] + [(7, "Same", "en", "Z", 4)] * 40
    assert results(spark, rows) == by_definition(rows)
    assert results(spark, []) == []


def test_intervals_and_siblings(spark):
    rows = spark.range(600).select(F.lit("k").alias("tree"), F.col("id").alias("order"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    placed = merkle.ranked(rows, "tree", ["order"])
    assert placed.where("rank <> order OR n <> 600").count() == 0
    levels = merkle.tree(placed, "tree", "leaf", ["order"])
    assert [level.count() for level in levels] == [38, 3, 1]
    top = levels[-1].first()
    assert (top["lo"], top["hi"], [(c["lo"], c["hi"]) for c in top["children"]]) == (0, 600, [(0, 256), (256, 512), (512, 600)])
    assert [x.count() for x in merkle.roots(levels)] == [0, 0, 1]
