import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioflow.llm import common, packing
from folioflow.operators.shared import materialise

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", "  ", "a", "it's the Dog's 12,345 ｆｏｏ é́ nb sp İstanbul ΣΑΣ.", "x<|endoftext|>y <|startoftext|>", "\x1ca\x1db \x85 z",
    "Straße, ÉCOLE. ªº µm don't!! ###", "word " * 700, "long" * 900, "tail, of the word. " * 300,
]


def brute(tokenizer, text, limit):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    return [
        (at // limit, at, len(ids[at:at + limit]), zlib.crc32(np.array(ids[at:at + limit], "<u4").tobytes()))
        for at in range(0, len(ids), limit)
    ]


@pytest.mark.parametrize("limit", [64, 2048])
def test_pieces_match_the_tokenizer_and_fill_sequences(spark, limit):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS * 3)] + [(2, "again", "y", 2), (None, "no id", None, None), (1, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, piece STRING, length INT")
    placed = packing.pack(materialise(packing.token_pieces(docs, PATH, limit), "pieces"), limit).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((i, *p) for i, t, *_ in rows for p in brute(tokenizer, t, limit))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed) == want
    sequences = defaultdict(list)
    for r in placed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= limit
    total = sum(r["length"] for r in placed)
    assert len(sequences) <= -(-total // limit) * 1.1 + 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert packing.pack(materialise(packing.token_pieces(docs, PATH), "pieces")).count() == 0


def test_words_are_learnt_again_after_they_are_let_go(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    model, whole = packing.Tokens(PATH), Tokenizer.from_file(PATH)
    texts = ["one two three four five six seven", "eight nine ten one two", "one", None, "zwölf größe x.y"]
    for batch in (texts, texts[::-1]):
        got = [np.frombuffer(b, np.uint32).tolist() for b in model.ids(batch)]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in batch]


def test_plans_hold_every_piece_and_are_nearly_full():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1, 513, 5000), np.minimum(rng.geometric(0.01, 3000), 512), np.full(900, 300), np.array([512] * 5 + [1])):
        histogram = Counter(sizes.tolist())
        planned = packing.plan(histogram, 512)
        back = Counter()
        for lengths, repeats in planned:
            assert sum(lengths) <= 512
            for x in lengths:
                back[x] += repeats
        assert back == histogram
        used = sum(r for _, r in planned)
        assert used <= max(1.02 * -(-int(sizes.sum()) // 512) + 1, sum(r for _, r in packing.best_fit(histogram, 512)) * 1.01)


def test_fit_is_a_least_squares_solution():
    histogram = np.zeros(65, np.int64)
    histogram[[10, 22, 32, 40, 24, 64]] = [30, 60, 80, 25, 25, 7]
    found, repeats = packing.fit_repeats(histogram, 64)
    used = np.zeros(65)
    for p, r in zip(found, repeats):
        for x in p:
            used[x] += r
    assert (repeats >= 0).all()
    assert ((used - histogram)[1:] ** 2).sum() < 0.2 * (histogram[1:] ** 2).sum()


def test_words_in_any_case_are_kept_once_and_marks_of_the_vocabulary_as_written():
    model, whole = packing.Tokens(PATH), Tokenizer.from_file(PATH)
    texts = ["Dog dog DOG, dog,", "École école ÉCOLE. ß ẞ ŸŸ", "A$$$ a$$$ x<|ENDOFTEXT|>Y X<|endoftext|>y", "ÇPA!! don't DON'T 'S K å"]
    got = [np.frombuffer(b, np.uint32).tolist() for b in model.ids(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert {w for w in model.words if b"dog" in w.lower()} == {b"dog", b"dog,"}


def test_words_closed_by_runs_of_marks_go_to_the_model_unit_by_unit(monkeypatch):
    texts = ["again&&& Größe.## word... ### _-_ end)\"", "öl$$$ a<|> b|. don't' x'.s y.'s 1, a.b ＡＢ. größe\u0308! <|endoftext|>..."]
    model, whole = packing.Tokens(PATH), Tokenizer.from_file(PATH)
    sent = []

    class Counted:
        def encode_batch_fast(self, words, **more):
            sent.extend(words)
            return whole.encode_batch_fast(words, **more)

    monkeypatch.setattr(model, "whole", Counted())
    got = [np.frombuffer(b, np.uint32).tolist() for b in model.ids(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert sorted(sent) == sorted(["don't'", "x'.s", "y.'s", "1,", "a.b", "ＡＢ.", "größe\u0308!", "<|endoftext|>..."])


def test_other_work_finds_workers_without_the_vocabulary(spark):
    docs = spark.range(64).selectExpr("id AS doc_id", "concat('some words ', id) AS text").repartition(4)

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"owners": pa.array([",".join(common._kept)] * batch.num_rows)})

    assert packing.token_pieces(docs, PATH).count() == 64
    assert {r["owners"] for r in common.in_arrow(docs, look, "owners STRING").collect()} == {""}
