from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.config import Quota, TranslationConfig
from folioflow.functions import text as tx
from folioflow.functions.chunking import chunk_text, fold_tokens
from folioflow.sources.sinks import compacted_path


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, v STRING")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_white_space_is_pythons():
    import sys

    assert set(tx.WHITESPACE) == {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()}


def test_strip_and_words(spark):
    rows = ["  a b ", "\t\xa0x　", "a \x85b\x1cc", "é😀\n", " " * 5, ""]
    assert values(spark, rows, tx.strip) == [r.strip() for r in rows]
    filled = [r for r in rows if r.strip()]
    assert values(spark, filled, tx.words) == [r.split() for r in filled]


def test_names_are_pathlibs(spark):
    from pathlib import PurePosixPath as Path

    names = ["a.pdf", "a.b.pdf", "noext", ".hidden", ".hidden.pdf", "a..pdf", "..pdf", "x/y.pdf", "x.y/z", "x/.h", "é 1.PDF", "d/e/f.tar.gz"]
    got = values(spark, names, lambda c: tx.suffixed_name(c, "_translated"))
    assert got == [str(Path(n).with_stem(Path(n).stem + "_translated")) for n in names]
    got = values(spark, names + ["q/"], tx.download_name)
    assert got == [Path(n).stem + "_translated.pdf" for n in names + ["q/"]]


def test_names(spark):
    names = ["a.pdf", "a.b.pdf", "noext", ".hidden", "", None]
    assert values(spark, names, lambda c: tx.suffixed_name(c, "_translated")) == [
        "a_translated.pdf", "a.b_translated.pdf", "noext_translated", ".hidden_translated", "_translated", None,
    ]
    assert values(spark, names, tx.download_name) == [
        "a_translated.pdf", "a.b_translated.pdf", "noext_translated.pdf", ".hidden_translated.pdf",
        "document_translated.pdf", "document_translated.pdf",
    ]
    assert compacted_path("/x/y.z/in.parquet") == "/x/y.z/in_compressed.parquet"
    assert compacted_path("/x/in") == "/x/in_compressed"


def test_percent_rounds_half_to_even(spark):
    cases = [(k, n) for n in (0, 1, 3, 7, 8, 16, 40, 200) for k in range(1, max(n, 1) + 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, k INT, n INT")
    got = [r[0] for r in df.orderBy("i").select(tx.percent(F.col("k"), F.col("n"))).collect()]
    assert got == [min(round(k / n * 100), 100) if n else 0 for k, n in cases]


def test_sizes_guard_zero(spark):
    row = spark.range(1).select(
        tx.reduction(F.lit(0), F.lit(0)).alias("none"), tx.reduction(F.lit(200), F.lit(50)).alias("some"),
        tx.megabytes(F.lit(1048576)).alias("mb"),
    ).first()
    assert row == (None, 75.0, 1.0)


@pytest.mark.parametrize("bad", [
    dict(source_lang=" "), dict(target_lang=""), dict(source_lang=None), dict(batch_size=0), dict(max_chunk_size=99),
])
def test_config_is_validated(bad):
    with pytest.raises(ValueError):
        TranslationConfig(**{"source_lang": "English", "target_lang": "Spanish", **bad})


def test_config_defaults():
    config = TranslationConfig("English", "English")
    assert (config.batch_size, config.max_chunk_size, config.skip_pages, config.preserve_layout) == (10, 1000, (), True)
    with pytest.raises(ValueError):
        Quota("week", 1)


# --- chunker -------------------------------------------------------------------------------


def expected_chunks(text: str, size: int) -> list[str]:
    """The rules as a list of tokens and a queue of open words."""
    if len(text) <= size:
        return [text]
    tokens: list[tuple[str | None, bool]] = []
    sentence = ""
    for i, c in enumerate(text + "|"):
        if c == "|" or (c == " " and i and text[i - 1] in ".!?"):
            if len(sentence) <= size:
                tokens.append((sentence, False))
            else:
                tokens += [(w, n == 0) for n, w in enumerate(sentence.split())] or [(None, True)]
            sentence = ""
        else:
            sentence += c
    groups: list[list[str]] = [[]]
    for token, fresh in tokens:
        used = sum(len(t) + 1 for t in groups[-1])
        if fresh or (token is not None and used + len(token) > size):
            groups.append([])
        if token is not None:
            groups[-1].append(token)
    return [" ".join(g).strip() for g in groups if g]


EDGES = [
    "", " " * 150, "a" * 100, "a" * 101, " " * 101, ". " + "b" * 120, "a|b" * 60, ". " * 80, "x\ny " * 60,
    "é😀" * 60, "a " * 50 + ". " + " " * 130 + ". z", "q" * 40 + ". " + " " * 130 + "|" + "z" * 40,
    "word\t\xa0 x" * 30, "|" * 120, "! |? " * 40, "a. . . b" * 30, "s. " * 33 + "t", "u. " * 34, "v" * 99 + ". w",
    "w" * 99 + "|" + "x" * 99, "long word " + "y" * 150 + " tail. Next one. " + "z" * 101,
]


@pytest.mark.parametrize("size", [100, 120])
def test_chunk_edges(spark, size):
    assert values(spark, EDGES, lambda c: chunk_text(c, size)) == [expected_chunks(e, size) for e in EDGES]


def test_fold_agrees_with_the_expression(spark):
    rng = random.Random(7)
    rows = [
        "".join(rng.choices(["a", "bc", " ", ". ", "! ", "? ", "|", "\n", "😀", "w" * 30], k=rng.randint(40, 300)))
        for _ in range(300)
    ]
    long_rows = [r for r in rows if len(r) > 100]
    want = [expected_chunks(r, 100) for r in long_rows]
    assert values(spark, long_rows, lambda c: chunk_text(c, 100)) == want
    assert values(spark, long_rows, lambda c: fold_tokens(c, 100)) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?|\n\t", max_size=400), min_size=20, max_size=60))
def test_chunk_properties(spark, rows):
    got = values(spark, rows, lambda c: chunk_text(c, 100))
    for text, chunks in zip(rows, got):
        assert chunks == expected_chunks(text, 100)
        if len(text) > 100:
            assert " ".join(chunks).split() == text.replace("|", " ").split()
        assert all(len(c) <= 100 or " " not in c for c in chunks)


def test_long_sentences_in_the_middle_and_marks_in_the_text(spark):
    rng = random.Random(11)
    pieces = ["short one. ", "ok! ", "w" * 30 + " ", "", "|", " " * 120 + ". ", "many plain words without an end " * 6 + ". ", "z" * 150 + " "]
    rows = ["".join(rng.choices(pieces, k=rng.randint(5, 40))) for _ in range(120)]
    rows += [r.replace("ok!", "o\x01k\x02!") for r in rows[:40]]
    want = [expected_chunks(r, 100) for r in rows]
    assert values(spark, rows, lambda c: chunk_text(c, 100)) == want


def test_cost_is_linear_with_long_sentences(spark):
    import time

    text = "a plain sentence of some words. " * 60_000 + "word without end " * 100
    df = spark.createDataFrame([(text,), (text[:1_900_000],)], "t STRING").repartition(1)

    def seconds(rows):
        start = time.perf_counter()
        rows.select(F.size(chunk_text(F.col("t"), 1000)).alias("n")).collect()
        return time.perf_counter() - start

    seconds(df)
    plain, with_long = seconds(df.where(F.length("t") == 1_900_000)), seconds(df.where(F.length("t") > 1_900_000))
    assert with_long < 4 * plain + 2
