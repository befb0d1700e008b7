import math
import random
import re
from collections import Counter

import pytest

from folioflow.llm import rules

TEXTS = [
    None, "", " \t\n", "one", "a b c a b c", "x " * 500, "line one\nline two\nline one\n \n\nline one", "# * $ %&|<> é😀 word\x0bword",
    "a b c d e a b c x a b c", " nbsp em", "w" * 5000, "\n".join(["same line here"] * 300), "a a a a",
]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def base(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return (
        len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    made = [" ".join(rng.choices("ab cd ef gh ## \n".split(" "), k=rng.randint(0, 90))) for _ in range(150)]
    return [(i, t) for i, t in enumerate(TEXTS + made)] + [(None, "no id at all"), (3, "one")]


def test_base_counts_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id BIGINT, text STRING, n_words INT").repartition(3)
    got = rules.judge(rules.measures(docs, [0.0] * 64)).collect()
    have = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    assert have == Counter((i, *base(t)) for i, t in rows)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed) and r["score"] == 0


def test_scores_are_mean_log_ratios(spark):
    good = [(i, f"good text about w{i % 7} and w{i % 5} again") for i in range(60)]
    junk = [(100 + i, "zz## yy$$ xx%% " * 20) for i in range(30)]
    docs = spark.createDataFrame(good + junk, "doc_id BIGINT, text STRING")
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(7,), (None,)], "doc_id BIGINT")
    ratios = rules.fit(docs, trusted, buckets=512)
    got = {r["doc_id"]: r["score"] for r in rules.measures(docs, ratios).collect()}
    assert min(got[i] for i, _ in good) > 0 > -0.05 > max(got[i] for i, _ in junk)
    # by hand, from the buckets Spark gives
    grams = {r["doc_id"]: r["g"] for r in docs.select("doc_id", rules.ngram_buckets(rules.words(docs["text"]), 512).alias("g")).collect()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i < 40:
            target.update(g)
    prior = rules.PRIOR * 512
    p = {b: (raw[b] + 0.5) / (sum(raw.values()) + 256) for b in range(512)}
    want = [math.log((target[b] + prior * p[b]) / (sum(target.values()) + prior)) - math.log(p[b]) for b in range(512)]
    assert ratios == pytest.approx(want)
    assert got[3] == pytest.approx(sum(want[b] for b in grams[3]) / len(grams[3]))


def test_without_trusted_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 60)], "doc_id BIGINT, text STRING")
    none = spark.createDataFrame([], "doc_id BIGINT")
    assert set(rules.fit(docs, none, 64)) == {0.0}
    assert rules.judge(rules.measures(docs.limit(0), rules.fit(docs.limit(0), none, 64))).count() == 0


def test_learning_from_many_trusted_rows_is_bounded(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('w', id % 9, ' v', id % 4) AS text")
    few = rules.fit(docs, docs.select("doc_id"), buckets=64, most=100)
    assert max(abs(x) for x in few) < 0.5
