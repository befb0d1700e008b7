import random

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import langid

SYLLABLES = {"aa": ["ba", "ki", "lo"], "bb": ["tsch", "rö", "um"], "cc": ["ção", "nh", "es"]}


def corpus(n=90, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


def brute_vector(text):
    """Bundle of bound, rotated letter vectors, gram by gram."""
    out = np.zeros(langid.DIMENSIONS)
    framed = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text} ")
    for word in framed.split():
        letters = [0, *map(ord, word), 0]
        for i in range(len(letters) - 2):
            out += np.prod([langid.letter_vector(c, k).astype(int) for k, c in enumerate(letters[i:i + 3])], axis=0)
    return out


def test_vectors_match_their_definition():
    texts = [None, "", "12 !?", "Ab ab, ÀÉ zß", "x", "日本 語のテキスト", "one two " * 50]
    rows, grams, counts, lettered = langid.gram_counts(texts)
    got = langid.bundled(len(texts), rows, grams, counts)
    for vector, text in zip(got, texts):
        assert np.array_equal(vector, brute_vector(text or "").astype(np.float32))
    assert lettered.tolist() == [False, False, False, True, True, True, True]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(t for _, t, _ in corpus(40))
    whole = langid.gram_counts([text, "tail"])
    monkeypatch.setattr(langid, "PIECE", 97)
    pieces = langid.gram_counts([text, "tail"])

    def total(found):
        return {(r, g): counts for (r, g), counts in _sum(found).items()}

    assert total(whole) == total(pieces)


def _sum(found):
    out = {}
    for r, g, c in zip(*found[:3]):
        out[(int(r), int(g))] = out.get((int(r), int(g)), 0) + int(c)
    return out


def test_held_out_languages_are_found(spark):
    extra = [(900, None, "aa"), (901, "123 !", "bb"), (902, "baki lo", None), (None, "tschrö um", "bb"), (3, corpus()[3][1], "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in corpus() + extra], "doc_id BIGINT, text STRING, lang STRING, score STRING")
    held_out = F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == 2
    got = langid.identify(docs.repartition(3), ~held_out).collect()
    assert len(got) == len(corpus()) + len(extra)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang in corpus() if i % 4 == 2)
    assert (by_id[900]["lang_pred"], by_id[900]["score"]) == ("und", 0.0) == (by_id[901]["lang_pred"], by_id[901]["score"])
    assert by_id[902]["lang_pred"] == "aa" and by_id[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = langid.recognised(docs, langid.learn(docs)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(r["doc_id"]) for r in got if r["lang_pred"] != "und")


def test_nothing_learnt_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id BIGINT, text STRING, lang STRING")
    assert langid.identify(docs, F.lit(True)).first()["lang_pred"] == "und"
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0
