"""Reports and page arithmetic that have no counterpart in one of the SQL texts, or need inputs of their own."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from folioflow.operators import edits, reports
from folioflow.plans import inputs
from folioflow.sources import sinks


def audit(spark, rows, by=("g",)):
    df = spark.createDataFrame(rows, f"{by[0]} STRING, a STRING, b STRING")
    return {(r[0], r["kind"]): (r["n_pieces"], r["n_lost"], r["n_rows_with_loss"]) for r in reports.preservation_audit(df, "a", "b", list(by)).collect()}


def test_audit_counts_copies_kinds_and_rows(spark):
    got = audit(spark, [
        ("x", "1 1 2", "1 2 3"), ("x", "1 1 2", "1 1 2"), ("x", "a@b.co +1 (555) 123-4567", "a@b.co"), ("y", r"see /usr/local/lib and C:\temp\x.txt", "see /usr/local"),
        ("y", None, None), ("z", "", None), ("x", "1 1 2", "1 2 3")])
    assert got["x", "number"] == (13, 2 + 4, 3)
    assert got["x", "email"] == (1, 0, 0) and got["x", "phone"] == (1, 1, 1)
    assert got["y", "path"] == (2, 2, 1) and got["z", "number"] == (0, 0, 0)
    assert len(got) == 3 * len(reports.KEPT_KINDS)


@pytest.mark.parametrize("name", ["k", "_x", "kind_", "piece"])
def test_audit_groups_by_columns_of_any_name(spark, name):
    assert audit(spark, [("x", "1", "2")], (name,))["x", "number"] == (1, 1, 1)


def test_audit_of_a_text_of_very_many_pieces(spark):
    def seconds(n):
        start = time.monotonic()
        got = audit(spark, [("x", " ".join(map(str, range(n))), " ".join(map(str, range(1, n))))])
        assert got["x", "number"] == (n, 1, 1)
        return time.monotonic() - start

    seconds(10)
    assert seconds(200_000) < 30


def wrap(words, per_line, lines):
    """Set letter by letter: the line each letter of each word comes to."""
    per_line = max(per_line, 1)
    line, used, lost = 0, 0, 0
    for word in words:
        if used and used + 1 + len(word) > per_line:
            line, used = line + 1, 0
        used += 1 if used else 0
        for _ in word:
            if used == per_line:
                line, used = line + 1, 0
            used += 1
            lost += line >= lines
    return (line + 1, lost) if words else (0, 0)


def test_lines_are_broken_word_by_word(spark):
    rng = random.Random(2)
    rows = [(" ".join("x" * rng.choice([1, 2, 3, 5, 9, 20]) for _ in range(rng.randrange(12))), rng.randrange(-1, 12), rng.randrange(4)) for _ in range(300)]
    rows += [("", 5, 1), ("  \u2003 ", 5, 1), ("abc", 3, 1), ("abc de", 6, 1), ("abc def", 6, 1), ("abcdef", 3, 1)]
    df = spark.createDataFrame(rows, "t STRING, m INT, n INT")
    got = df.select("*", edits.wrapped(F.col("t"), F.col("m"), F.col("n")).alias("w")).select("t", "m", "n", "w.*").collect()
    assert [(r["n_lines"], r["n_lost"]) for r in got] == [wrap(t.split(), m, n) for t, m, n in rows]


def test_area_of_a_union_of_rectangles(spark):
    rng = random.Random(4)
    sets = [[(x, y, x + rng.randrange(9), y + rng.randrange(9)) for x, y in ((rng.randrange(12), rng.randrange(12)) for _ in range(k))] for k in (0, 1, 2, 3, 5, 8) * 10]
    shape = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    df = spark.createDataFrame([(i, [tuple(map(float, r)) for r in rects]) for i, rects in enumerate(sets)], f"id INT, rects {shape}")
    got = {r["id"]: r["area"] for r in df.select("id", edits.covered_area(F.col("rects")).alias("area")).collect()}
    for i, rects in enumerate(sets):
        assert got[i] == len({(x, y) for x0, y0, x1, y1 in rects for x in range(x0, x1) for y in range(y0, y1)})


def test_blocks_that_are_wiped_out_by_later_edits(spark):
    def block(text, x0, y0, x1, y1):
        return {"type": 0, "lines": [{"spans": [{"text": text, "bbox": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, "font": "f", "size": 10.0}]}]}

    blocks = [block("first text", 0.0, 0.0, 10.0, 10.0), block("ab", 5.0, 0.0, 15.0, 10.0), block("second text", 0.0, 5.0, 10.0, 15.0),
              block("third text", 5.0, 5.0, 10.0, 10.0), block("no area", 1.0, 1.0, 1.0, 9.0)]
    layout = spark.createDataFrame([{"doc_id": 1, "page_num": 0, "n_pages": 1, "blocks": blocks}], inputs.schemas.LAYOUT)
    got = {r["block_no"]: (r["n_clearing"], r["cleared"]) for r in edits.survival(layout, inputs.CONFIG).collect()}
    # the short block keeps its text, so edits before it wipe it as well
    assert got == {0: (3, 0.5), 1: (3, 0.5), 2: (2, 0.25 + 0.0), 3: (0, 0.0), 4: (0, 0.0)}


def cut_at_random(data, rng):
    places = sorted(rng.sample(range(len(data) + 1), min(len(data) + 1, rng.randrange(1, 40))))
    return [data[a:b] for a, b in zip([0, *places], [*places, len(data)])]


@pytest.mark.parametrize("block", [1000, 3])
def test_lines_of_fragments_cut_anywhere(spark, monkeypatch, block):
    monkeypatch.setattr(sinks, "BLOCK_FRAGMENTS", block)
    rng = random.Random(9)
    rows, want = [], {}
    for stream in range(30):
        events = [json.dumps({"type": "progress", "page": n, "message": "é€😀" * rng.randrange(4)}, ensure_ascii=False) for n in range(rng.randrange(7))]
        text = rng.choice(["\n", "\n\n", "\r\n"]).join(events) + rng.choice(["", "\n", "\n \n"])
        want[stream] = [json.loads(e) for e in events]
        gap = rng.choice([1, 1, 7])
        rows += [(stream, n * gap, part) for n, part in enumerate(cut_at_random(text.encode(), rng))]
    rows += rng.sample(rows, 20) + [(None, 1, b"x\ny"), (0, None, b"x\n"), (99, 5, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream INT, seq INT, data BINARY")
    got = {}
    for r in sinks.events_of(df).orderBy("stream", "seq", "line_no").collect():
        got.setdefault(r["stream"], []).append({"type": r["type"], "page": r["page"], "message": r["message"]})
    assert got == {k: v for k, v in want.items() if v}


def test_request_table_is_read_once_for_all_buckets(spark, tmp_path, monkeypatch):
    from folioflow.operators import translation as tr

    texts = spark.range(800).select(F.col("id").alias("n"), F.lit(0).alias("chunk_no"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    read = []
    ask = tr.ask
    monkeypatch.setattr(tr, "ask", lambda part, *a: read.append((len(part.inputFiles()), part.count())) or ask(part, *a))
    done = tr.translate_once(texts, lambda xs: [x.upper() for x in xs], "a", "b", per_commit=100, answers_at=str(tmp_path / "kept"))
    assert done.where("translated = upper(concat('text ', n))").count() == 800
    assert len(read) == 8 and sum(n for _, n in read) == 800
    assert max(n for _, n in read) < 200, "a bucket reads its own folder only"


def test_rollup_has_every_level_once(spark):
    df = spark.createDataFrame([("en", "a", "failed"), ("en", None, "failed"), ("de", "a", "translated")], "lang STRING, source STRING, status STRING")
    got = {(r["lang"], r["source"], r["status"], r["level"]): r["n"] for r in reports.outcome_rollup(df, ["lang", "source"]).collect()}
    assert got[None, None, None, 7] == 3 and got["en", None, None, 3] == 2 and got["en", None, None, 1] == 1 and got["en", None, "failed", 0] == 1
    assert len(got) == 3 + 3 + 2 + 1
