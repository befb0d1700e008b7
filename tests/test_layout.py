from __future__ import annotations

import pytest

from folioflow.config import TranslationConfig
from folioflow.operators import assembly, edits
from folioflow.operators import layout as lay
from folioflow.plans import corpus
from folioflow.plans.corpus import translate_blocks, translate_documents, translate_pages
from folioflow.plans.inputs import stand_in, stand_in_batch
from folioflow.schemas import LAYOUT


def span(text, x0=0.0, y0=0.0, x1=1.0, y1=1.0, font="helvetica", size=10.0):
    box = {k: float(v) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1))}
    return {"text": text, "bbox": box, "font": font, "size": float(size)}


def block(*lines, type=0):
    return {"type": type, "lines": [{"spans": list(s)} for s in lines]}


@pytest.fixture(scope="module")
def layout(spark):
    first = [
        block([span("Hello", 5, 5, 9, 9, "B", 10), span("big", 1, 6, 20, 8, "A", 12)], [span("world. ", 3, 9, 4, 30, "A", 14)]),
        block([span("picture")], type=1),
        block([span("  "), span("\t")]),
        block([span("ab")]),
        block([], [span("x1", font="Z"), span("y2", font="Y")]),
    ]
    second = [block([span("second page text")])]
    rows = [(1, 0, 3, first), (1, 1, 3, second), (1, 2, 3, [])]
    return spark.createDataFrame(rows, LAYOUT)


def test_blocks(layout):
    rows = lay.text_blocks(layout).orderBy("page_num", "block_no").collect()
    assert [(r.page_num, r.block_no, r.block_seq, r.text) for r in rows] == [
        (0, 0, 0, "Hello big world."), (0, 3, 1, "ab"), (0, 4, 2, "x1 y2"), (1, 0, 0, "second page text"),
    ]
    top = rows[0]
    assert tuple(top.rect) == (1.0, 5.0, 20.0, 30.0)
    assert (top.font, top.size, len(top.bboxes)) == ("A", 12.0, 3)
    assert rows[2].font == "Y"
    for r in rows:
        assert all(r.rect.x0 <= b.x0 and r.rect.y0 <= b.y0 and r.rect.x1 >= b.x1 and r.rect.y1 >= b.y1 for b in r.bboxes)


def test_flat_spans_fold_to_the_same_blocks(layout):
    columns = ["doc_id", "page_num", "block_no", "text", "bboxes", "rect", "font", "size"]
    nested = lay.text_blocks(layout).select(columns).collect()
    flat = lay.fold_spans(lay.spans_of(layout)).select(columns).collect()
    assert sorted(map(str, nested)) == sorted(map(str, flat))


def test_pages(layout):
    assert [tuple(r) for r in lay.blank_pages(layout).collect()] == [(1, 2)]
    assert [tuple(r) for r in lay.page_counts(layout).collect()] == [(1, 3)]
    assert sorted(r.page_num for r in lay.flagged_pages(layout, [1, 9]).where("skipped").collect()) == [1]
    assert lay.flagged_pages(layout, []).where("skipped").count() == 0


def test_routes_and_batches(layout):
    found = lay.text_blocks(layout)
    routes = {(r.page_num, r.block_no): r.route for r in lay.routed_blocks(found, [1]).collect()}
    assert routes == {(0, 0): "translate", (0, 3): "short", (0, 4): "translate", (1, 0): "skipped_page"}
    batches = {(r.page_num, r.block_no): r.batch_no for r in lay.block_batches(found, 2).collect()}
    assert batches == {(0, 0): 0, (0, 3): 0, (0, 4): 1, (1, 0): 0}


def test_document_keeps_untranslated_parts(layout):
    config = TranslationConfig("English", "Spanish", skip_pages=[1])
    pages = assembly.translated_pages(layout, config, stand_in)
    doc = assembly.documents_of(pages).first()
    service = translate_documents(layout, config, batch=stand_in_batch, max_tasks=2).first()
    assert service == doc
    assert doc.translated == "[es] Hillu bog wurld.\nab\n[es] x1 y2\nsecond page text\n"
    assert (doc.n_pages, doc.n_blocks, doc.n_chunks, doc.n_failed) == (3, 4, 2, 0)


def test_edit_plans(layout):
    config = TranslationConfig("English", "Spanish", skip_pages=[1])
    done = edits.translated_blocks(lay.text_blocks(layout), config, stand_in)
    kept = edits.edit_plan(done, config, ["A"]).orderBy("block_no").collect()
    assert [(r.block_no, r.edit_no, r.op, r.text, r.font, r.align) for r in kept] == [
        (0, 0, "redact", "[es] Hillu bog wurld.", "A", 0), (4, 0, "redact", "[es] x1 y2", "helvetica", 0),
    ]
    free = TranslationConfig("English", "Spanish", skip_pages=[1], preserve_layout=False)
    plan = edits.edit_plan(done, free, ["A"]).orderBy("block_no", "edit_no").collect()
    assert [(r.block_no, r.op) for r in plan] == [(0, "redact")] * 3 + [(0, "insert")] + [(4, "redact")] * 2 + [(4, "insert")]
    assert plan[0].text is None and (plan[0].x0, plan[1].x0, plan[3].x0) == (5.0, 1.0, 1.0)
    assert plan[3].text == "[es] Hillu bog wurld."


def test_edit_plan_from_a_service(layout):
    config = TranslationConfig("English", "Spanish", skip_pages=[1])
    blocks = lay.text_blocks(layout)
    inline = edits.edit_plan(edits.translated_blocks(blocks, config, stand_in), config, ["A"])
    answers = translate_blocks(lay.routed_blocks(blocks, config.skip_pages), config, stand_in_batch)
    joined = edits.edit_plan(edits.with_translations(blocks, answers), config, ["A"])
    assert sorted(map(str, inline.collect())) == sorted(map(str, joined.collect()))


def test_one_translator_is_needed(layout):
    config = TranslationConfig("English", "Spanish")
    with pytest.raises(ValueError):
        translate_pages(layout, config)
    with pytest.raises(ValueError):
        translate_pages(layout, config, column=stand_in, batch=stand_in_batch)


def test_an_empty_corpus_gives_empty_results(spark, layout):
    config = TranslationConfig("English", "Spanish")
    nothing = layout.where("doc_id < 0")
    for translator in ({"column": stand_in}, {"batch": stand_in_batch}):
        assert translate_documents(nothing, config, **translator).collect() == []
    without_text = layout.where("page_num = 2")
    for translator in ({"column": stand_in}, {"batch": stand_in_batch}):
        row = translate_documents(without_text, config, **translator).first()
        assert (row.translated, row.n_pages, row.n_blocks, row.n_chunks, row.n_failed) == ("", 1, 0, 0, 0)


def test_null_span_texts_and_missing_parts(spark):
    rows = [(1, 0, 1, [block([span(None), span("kept text")]), {"type": 0, "lines": []}, {"type": 0, "lines": [{"spans": []}]}])]
    layout = spark.createDataFrame(rows, LAYOUT)
    assert [r.text for r in lay.text_blocks(layout).collect()] == ["kept text"]
    assert lay.blank_pages(layout).count() == 0


def test_pages_of_a_service_are_put_together_in_one_shuffle(spark, monkeypatch):
    """Only text in pieces is written on the way; blocks of several chunks come back as by the inline job."""
    long = " ".join(f"Sentence number {i} of a long block." for i in range(20))
    rows = [(d, n, 2, [block([span(long)]), block([span("ab")]), block([span(f"words {d} {n}")]), block([span("no text")], type=1)]) for d in range(5) for n in range(2)]
    rows += [(7, None, 0, None), (8, None, None, None), (9, 0, 1, [])]
    layout = spark.createDataFrame(rows, LAYOUT)
    config = TranslationConfig("English", "Spanish", skip_pages=[1], max_chunk_size=100)
    made, write = [], corpus.materialise
    monkeypatch.setattr(corpus, "materialise", lambda df, label: made.append((label, df.columns)) or write(df, label))
    done = translate_pages(layout, config, batch=stand_in_batch)
    assert made == [("chunks", ["doc_id", "page_num", "n_pages", "block_no", "chunk_no", "text", "chunk_key"])]
    want = translate_pages(layout, config, column=stand_in).select(done.columns)
    assert sorted(map(str, done.collect())) == sorted(map(str, want.collect()))
    pieces = spark.createDataFrame([], "doc_id BIGINT, page_num INT, block_no INT, chunk_no INT, translated STRING, status STRING, page_status STRING")
    assert assembly.pages_of(pieces)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
