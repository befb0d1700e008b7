import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import katz


class Brute:
    """The model from its formulas, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.count = [Counter() for _ in range(order + 1)]
        for t in texts:
            ws = ["<s>", *t.lower().split(), "</s>"]
            for i in range(1, len(ws)):
                self.count[1][(ws[i],)] += 1
                for k in range(2, order + 1):
                    if i - k + 1 >= 0:
                        self.count[k][tuple(ws[i - k + 1:i + 1])] += 1
        self.d = [None] + [self.discounts(Counter(self.count[k].values())) for k in range(1, order + 1)]
        self.followers = defaultdict(dict)
        for k in range(1, order + 1):
            for g, c in self.count[k].items():
                self.followers[g[:-1]][g[-1]] = c

    @staticmethod
    def discounts(n):
        out = {}
        tail = 6 * n[6] / n[1] if n[1] else 1.0
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def p(self, word, context):
        own = self.followers.get(context, {})
        d = self.d[len(context) + 1]
        if context and not own:
            return self.p(word, context[1:])
        if not own:
            return 1.0
        total = sum(own.values())
        mass = sum(c * d.get(c, 1.0) for c in own.values())
        if not any(c <= 5 for c in own.values()):
            total += 1
        if word in own:
            return own[word] * d.get(own[word], 1.0) / total
        left = 1 - mass / total
        if not context:
            return left
        return left / (1 - sum(self.p(w, context[1:]) for w in own)) * self.p(word, context[1:])

    def score(self, text):
        ws = ["<s>", *text.lower().split(), "</s>"]
        return sum(math.log10(self.p(ws[i], tuple(ws[max(0, i - self.order + 1):i]))) for i in range(1, len(ws)))


def corpus(n=220, seed=4):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize(("order", "hot"), [(1, 200), (2, 200), (2, 3), (3, 40)])
def test_scores_match_formulas(spark, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 700)
    monkeypatch.setattr(katz, "HOT", hot)
    rows = [*corpus(), (900, None), (901, ""), (902, "never seen words v1 v2"), (None, "V1 v2"), (5, "v1 v1 v1"), (3, corpus()[3][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id BIGINT, text STRING, block STRING").repartition(3)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    got = katz.score(docs, train, order).collect()
    assert len(got) == len(rows)
    learnt = [t or "" for i, t in rows if (i or 0) % 3 != 1]
    model = Brute(learnt, order)
    n, v = sum(model.count[1].values()), len(model.count[1])
    want = Counter()
    for i, t in rows:
        ws = [*(t or "").lower().split(), "</s>"]
        base = sum(math.log10((model.count[1][(w,)] + 1) / (n + v + 1)) for w in ws)
        want[(i, len(ws), sum(model.count[1][(w,)] > 0 for w in ws), n, round(base, 6), round(model.score(t or ""), 6))] += 1
    have = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    assert have == want


def test_distributions_sum_to_one():
    model = Brute([t for _, t in corpus(60)], 3)
    words = {w for (w,) in model.count[1]} | {"<unknown>"}
    for context in [(), ("v0",), ("v3",), ("<s>",), ("v0", "v1"), ("nothing",)]:
        assert abs(sum(model.p(w, context) for w in words) - 1) < 1e-9


def test_without_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: r for r in katz.score(docs, F.lit(False)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["score"] == 0 and got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0
    assert got[2]["base_score"] == 0
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert katz.score(empty, F.lit(True)).count() == 0
