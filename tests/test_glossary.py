from __future__ import annotations

import random
import re

from folioflow.operators import glossary


def replaced(text, terms):
    """By definition: at every word the longest term that fits, then on behind it."""
    if text is None:
        return None, 0
    spans = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
    out, at, i, n = "", 0, 0, 0
    while i < len(spans):
        for size in range(min(glossary.MOST_WORDS, len(spans) - i), 0, -1):
            part = spans[i:i + size]
            blank = all(text[a[1]:b[0]].isspace() for a, b in zip(part, part[1:]))
            phrase = " ".join(w for *_, w in part)
            if blank and phrase in terms:
                out += text[at:part[0][0]] + terms[phrase]
                at, i, n = part[-1][1], i + size - 1, n + 1
                break
        i += 1
    return out + text[at:], n


def answers(spark, texts, pairs):
    df = spark.createDataFrame([(i, 0, t, "x") for i, t in enumerate(texts)], "doc_id INT, chunk_no INT, text STRING, phrase STRING")
    known = spark.createDataFrame(pairs, "term STRING, translation STRING")
    return [(r["answer"], r["n_terms"]) for r in glossary.apply_glossary(df, known, ["doc_id", "chunk_no"]).orderBy("doc_id").collect()]


def test_overlaps_case_and_what_stands_between(spark):
    terms = {"new york": "NY", "york city": "YC", "new york city hall": "NYCH", "city": "C", "é a": "<&>", "a": "[a]"}
    texts = ["New  York City", "new york city HALL!", "new, york city", "NEW\nYORK", "newyork city", "É a a-a", "", None, "city", "  a  ", "no term", "new york city ha"]
    got = answers(spark, texts, list(terms.items()))
    assert got == [replaced(t, terms) for t in texts]
    assert got[0][0] == "NY C" and got[1][0] == "NYCH!" and got[2][0] == "new, YC"


def test_random_texts_and_terms(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "dd", "E"]
    terms = {" ".join(rng.choices(["a", "b", "c", "dd", "e"], k=rng.randrange(1, 5))): f"<{i}>" for i in range(40)}
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "\n", "-"]) for _ in range(rng.randrange(60))) for _ in range(80)] + ["a b " * 100] * 50
    assert answers(spark, texts, list(terms.items())) == [replaced(t, terms) for t in texts]


def test_terms_that_are_left_out_and_empty_tables(spark):
    pairs = [("x", "2"), ("X ", "1"), ("", "e"), (None, "n"), ("y", None), ("...", "p"), ("w " * 9, "long")]
    assert answers(spark, ["x y w w w w w w w w w"], pairs) == [("1 y w w w w w w w w w", 1)]
    assert answers(spark, ["x"], []) == [("x", 0)] and answers(spark, [], pairs) == []


def test_large_glossaries_are_left_to_the_join(spark, monkeypatch):
    terms = {"a b": "<1>", "b c": "<2>", "c": "<3>", "a b c d": "<4>", "é": "<5>"}
    texts = ["a b c d", "A  b-c d", "b c a b", "É, c", "d", "", " ", "a b\tc d c", "-a b-"]
    monkeypatch.setattr(glossary, "MOST_TERMS", len(terms))
    small = answers(spark, texts, list(terms.items()))
    monkeypatch.setattr(glossary, "MOST_TERMS", len(terms) - 1)
    assert small == answers(spark, texts, list(terms.items())) == [replaced(t, terms) for t in texts]


def test_only_stretches_that_may_be_terms_are_made(spark):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([("a x a b y c d",)], "text STRING").select(
        glossary._stretches(glossary._pieces(F.col("text")), [1, 2], ["x y", "a b", "c e", "q"]).alias("s")).first()["s"]
    assert [(s["at"], s["n"], s["phrase"]) for s in made] == [(2, 2, "a b")]
