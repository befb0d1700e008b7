from __future__ import annotations

import base64
import json
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from folioflow.config import AdmissionRules
from folioflow.operators import admission, layout as lay, reports
from folioflow.plans import corpus, inputs
from folioflow.functions import html
from folioflow.sources import readers, sinks


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {
        "ok.pdf": b"%PDF-1.4 fine", "sub/empty.pdf": b"", "bad.pdf": b"<html>", "big.pdf": b"%PDF-" + b"x" * 100, "note.txt": b"%PDF-",
    }.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_raw_files_are_screened(spark, folder):
    sizes = {"ok.pdf": 13, "sub/empty.pdf": 0, "bad.pdf": 6, "big.pdf": 105, "note.txt": 5, "never.pdf": None}
    manifest = spark.createDataFrame([(f"file:{folder}/{n}", k) for n, k in sizes.items()], "path STRING, length BIGINT")
    rows = readers.screen_files(readers.raw_files(spark, folder), AdmissionRules(max_bytes=50), manifest).collect()
    assert {r.path.rsplit("/", 1)[1]: r.verdict for r in rows} == {
        "ok.pdf": "admitted", "empty.pdf": "empty", "bad.pdf": "magic", "big.pdf": "size",
        "note.txt": "magic", "never.pdf": "missing",
    }
    plan = readers.raw_files(spark, folder).where("length <= 50")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan


def test_decoded_pages_and_unreadable_documents(spark):
    def decoder(content: bytes):
        if not content.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        box = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
        for page in content.decode().split("\f"):
            yield [{"type": 0, "lines": [{"spans": [{"text": page, "bbox": box, "font": "f", "size": 9.0}]}]}]

    docs = spark.createDataFrame([(1, b"%PDF-one\fsecond page"), (2, b"junk")], "doc_id BIGINT, content BINARY")
    layout = readers.decode_layout(docs, decoder)
    pages = {(r.doc_id, r.page_num): r.n_pages for r in layout.collect()}
    assert pages == {(1, 0): 2, (1, 1): 2, (2, None): None}
    assert [r.text for r in lay.text_blocks(layout).orderBy("page_num").collect()] == ["%PDF-one", "second page"]
    jobs = docs.join(layout.groupBy("doc_id").agg(F.max("n_pages").alias("n_pages")), "doc_id").select(
        "doc_id", F.lit("English").alias("source_lang"), F.lit("Greek").alias("target_lang"),
        "content", F.lit("").alias("declared"), "n_pages",
    )
    rules = AdmissionRules(magic=b"", max_pages=1)
    assert {r.doc_id: r.verdict for r in admission.with_verdict(jobs, rules).collect()} == {1: "pages", 2: "unreadable"}


def test_translated_sink(spark, tmp_path, caplog):
    out = str(tmp_path / "deep" / "out")
    df = spark.createDataFrame([(1, "a", "Spanish"), (2, "b", "Greek")], "doc_id BIGINT, translated STRING, target_lang STRING")
    sinks.write_translated(df, out, overwrite=False)
    with pytest.raises(AnalysisException):
        sinks.write_translated(df, out, overwrite=False)
    with caplog.at_level("WARNING"):
        sinks.write_translated(df.where("doc_id = 2"), out)
    assert "overwriting" in caplog.text
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(2, "b", "Greek")]


def test_event_lines_round_trip(spark, tmp_path):
    payload = bytes(range(256)) * 3
    one = spark.createDataFrame([(payload, "x.y.pdf", 1, 3, 33)], "p BINARY, f STRING, page INT, total INT, percent INT")
    row = one.select(
        reports.progress_event().alias("p"), reports.done_event(F.col("f"), F.col("p")).alias("d"), reports.error_event(F.lit('no "luck"')).alias("e")
    ).first()
    assert json.loads(row.p) == {"type": "progress", "page": 1, "total": 3, "percent": 33}
    done = json.loads(row.d)
    assert (done["type"], done["filename"]) == ("done", "x.y_translated.pdf") and base64.b64decode(done["pdf_b64"]) == payload
    assert "\n" not in row.d and json.loads(row.e) == {"type": "error", "message": 'no "luck"'}
    (tmp_path / "events.json").write_text(f"{row.p}\n\n{row.d}\n{row.e}")
    back = sinks.read_events(spark, str(tmp_path / "events.json"))
    assert [r.type for r in back.collect()] == ["progress", "done", "error"]
    sinks.write_events(back, str(tmp_path / "copy"))
    lines = [line for f in (tmp_path / "copy").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(map(len, lines)) == sorted(map(len, [row.p, row.d, row.e]))


def test_compaction(spark, tmp_path):
    source = str(tmp_path / "data.parquet")
    spark.range(20_000).select("id", F.lit("same text").alias("t")).write.option("compression", "none").parquet(source)
    report = sinks.compact_dataset(spark, source).first()
    assert report.path.endswith("data_compressed.parquet") and 0 < report.out_bytes < report.in_bytes
    assert report.reduction_pct == pytest.approx((report.in_bytes - report.out_bytes) / report.in_bytes * 100)
    kept = sinks.compact_dataset(spark, source, replace=True).first()
    assert kept.path == source and sinks.dataset_bytes(spark, source) == kept.out_bytes
    assert spark.read.parquet(source).count() == 20_000
    assert sorted(p.name for p in tmp_path.iterdir()) == ["data.parquet", "data_compressed.parquet"]


def test_compaction_keeps_all_columns_and_folders(spark, tmp_path):
    plain = str(tmp_path / "evolved.parquet")
    spark.range(10).select("id", F.lit(1).alias("a")).write.parquet(plain)
    spark.range(10, 20).select("id", F.lit(2).alias("a"), F.lit("x").alias("b")).write.mode("append").parquet(plain)
    sinks.compact_dataset(spark, plain, replace=True).collect()
    rows = spark.read.parquet(plain)
    assert set(rows.columns) == {"id", "a", "b"} and rows.count() == 20 and rows.where("b = 'x'").count() == 10

    parted = str(tmp_path / "parted")
    source = spark.range(300).select("id", F.format_string("%03d", F.col("id") % 3).alias("lang"))
    source.repartition(6).write.partitionBy("lang").parquet(parted)
    before = len(list((tmp_path / "parted").rglob("*.parquet")))
    sinks.compact_dataset(spark, parted, replace=True).collect()
    assert sorted(p.name for p in (tmp_path / "parted").iterdir() if p.is_dir()) == ["lang=000", "lang=001", "lang=002"]
    assert len(list((tmp_path / "parted").rglob("*.parquet"))) < before
    assert spark.read.parquet(parted).count() == 300


def test_compaction_survives_a_failing_rename(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "data")
    spark.range(50).write.parquet(source)
    real, calls = sinks._rename, []

    def second_fails(session, old, new):
        calls.append((old, new))
        if len(calls) == 2:
            raise OSError("no")
        real(session, old, new)

    monkeypatch.setattr(sinks, "_rename", second_fails)
    with pytest.raises(OSError):
        sinks.compact_dataset(spark, source, replace=True)
    assert spark.read.parquet(source).count() == 50
    assert [p.name for p in tmp_path.iterdir()] == ["data"]


def test_documents_without_pages_stay_and_decoding_happens_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def decoder(content: bytes):
        import uuid

        (calls / uuid.uuid4().hex).write_bytes(content)
        if content == b"bad":
            raise ValueError("unreadable")
        box = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
        return [
            [{"type": 0, "lines": [{"spans": [{"text": t, "bbox": box, "font": "f", "size": 9.0}]}]}]
            for t in content.decode().split("|") if t
        ]

    rows = [(1, b"one text|another one"), (2, b"bad"), (3, b""), (4, b"a third text")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, content BINARY")
    config = inputs.TranslationConfig("English", "Spanish")
    done = corpus.translate_documents(readers.decode_layout(docs, decoder), config, batch=inputs.stand_in_batch)
    got = {r.doc_id: (r.status, r.n_pages, r.translated is None, r.n_failed) for r in done.collect()}
    assert {i: v[:3] for i, v in got.items()} == {
        1: ("translated", 2, False), 2: ("unreadable", 0, True), 3: ("no_pages", 0, True), 4: ("translated", 1, False),
    }
    assert len(list(calls.iterdir())) == 4, "each document is decoded once"
    inline = corpus.translate_documents(readers.decode_layout(docs, decoder), config, column=inputs.stand_in)
    assert {r.doc_id: (r.status, r.n_pages, r.translated is None, r.n_failed) for r in inline.collect()} == got


class PageText(HTMLParser):
    """Blocks of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.tag, self.text, self.silent = [], "#text", "", 0

    def edge(self, tag, named):
        if re.fullmatch(html.BLOCKS, tag):
            if self.text.strip():
                self.blocks.append((self.tag, " ".join(self.text.split())))
            self.tag, self.text = named, ""

    def handle_starttag(self, tag, attrs):
        self.text += " " if tag == "br" else ""
        self.silent += tag in ("script", "style")
        self.edge(tag, "#text" if tag == "hr" else tag)

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style")
        self.edge(tag, "#text")

    def handle_data(self, data):
        self.text += "" if self.silent else data


def parsed(page):
    parser = PageText()
    parser.feed(page + "<hr>")
    return parser.blocks


def test_html_blocks_take_all_text(spark, sf_dir):
    odd = {
        -1: "<p>one<p>two <b>bold</b><li>three",
        -2: "loose<div class=x>in div<h2>head</h2>after<table><tr><td>cell</table>end",
        -3: "<p>kept</p><!-- never closed <p>gone",
        -4: "<P>up<hr/>down</P><param>x</param><blockquote>q</blockquote><pre>a\n b</pre><p>cut<p cla",
        -5: "", -6: None,
        -7: "if 1 < 2 and 3 > 2 then", -8: "one<br>two<BR/>three", -9: '<p><a title="a>b" href=x>link</a> <i class=\'>\'>it</i>',
        -10: "&eacute; &#233; &copy; &mdash; &#x2014; &nbsp;x&nbsp; &lt;b&gt; &amp;amp; &#128512; &#150; &#0; &#xD800; &#1; &#99999999999999; &nosuch; &notit; &copy2 & &#; &AMP",
        -11: "<p>a = b</p><p x=1 y= 'p>q' z>c < d e</p>", -12: "<?xml v='1'?><!DOCTYPE html><p>x</p>" + "<span data=" + "'" + "y" * 50_000 + "'>z</span>",
    }
    extra = spark.createDataFrame([(k, "", v) for k, v in odd.items()], "page_id BIGINT, url STRING, html STRING")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").unionByName(extra.select("page_id", "html"))
    got = {}
    for r in readers.html_blocks(pages).orderBy("page_id", "block_no").collect():
        got.setdefault(r.page_id, []).append((r.tag, r.text))
    assert got[-1] == [("p", "one"), ("p", "two bold"), ("li", "three")]
    assert got[-2] == [("#text", "loose"), ("div", "in div"), ("h2", "head"), ("#text", "after"), ("td", "cell"), ("#text", "end")]
    assert got[-3] == [("p", "kept")] and not {-5, -6} & set(got)
    assert got[-4] == [("p", "up"), ("#text", "down"), ("#text", "x"), ("blockquote", "q"), ("pre", "a b"), ("p", "cut")]
    assert got[-7] == [("#text", "if 1 < 2 and 3 > 2 then")] and got[-8] == [("#text", "one two three")]
    assert got[-9] == [("p", "link it")]
    for n in (-7, -8, -9, -10, -11, -12):
        assert got[n] == parsed(odd[n]), n
    given = {r.page_id: r.html for r in pages.where("page_id >= 0").collect()}
    cut = re.compile(r"</?[a-zA-Z][^>]*\Z")
    assert {k: got.get(k, []) for k in given} == {k: parsed(cut.sub("", v)) for k, v in given.items()}


def test_pages_of_several_documents_leave_the_worker_together(spark, monkeypatch):
    monkeypatch.setattr(readers, "PAGES_AT_ONCE", 3)

    def decoder(content):
        if content == b"bad":
            raise ValueError
        return [[] for _ in range(len(content))]

    contents = [b"a", b"", b"bad", b"abcdef", b"ab", b"a", None]
    docs = spark.createDataFrame(list(enumerate(contents)), "doc_id BIGINT, content BINARY").coalesce(1)
    rows = readers.decode_layout(docs, decoder).select("doc_id", "page_num", "n_pages").collect()
    want = []
    for i, c in enumerate(contents):
        if c is None or c == b"bad":
            want.append((i, None, None))
        else:
            want += [(i, n, len(c)) for n in range(len(c))] or [(i, None, 0)]
    assert [tuple(r) for r in rows] == want
