import importlib.util
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from folioflow.operators.shared import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "base", "_key"]
SENTENCE = "this sentence of the ordinary text number {0} speaks of {0} things and of nothing else in particular"


def documents(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    plain = [" ".join(SENTENCE.format(f"w{i}x{k}") for k in range(6)) for i in range(8)]
    rows = [(i, t, "en") for i, t in enumerate(plain)]
    rows += [(100, plain[0].upper(), "en"), (101, plain[1] + " end", None), (102, plain[2] + " " + item, "en")]
    rows += [(103, plain[3][:200] + " mail me at jo.doe@example.com or +1 (415) 555-0134 today", "en"), (104, "", "en"), (105, None, None)]
    rows += [(106, "123 456", "en"), (None, "a row without any id that says something of its own kind today", "en"), (4, plain[4], "en")]
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1) for i, t, lang in rows], (
        "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, base STRING, _key INT"))


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialise(stage(spark, docs, sf_dir), name)
    return out


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_stages_take_effect_and_keep_the_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == COLUMNS
    assert ids(stages["language"]) == sorted([*range(8), 4, 100, 101, 102, 103, None], key=str)
    assert ids(stages["near_duplicates"]) == sorted([*range(8), 102, 103, None], key=str)
    assert ids(stages["decontamination"]) == sorted([*range(8), 103, None], key=str)
    masked = {r["doc_id"]: r for r in stages["personal_data"].collect()}
    assert set(masked) == {*range(8), 103, None}
    assert masked[103]["text"].endswith("mail me at <EMAIL> or <PHONE> today")
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    pieces = stages["packing"].collect()
    assert {r["doc_id"] for r in pieces} == set(masked) and sum(r["length"] for r in pieces) <= 2048 * len({r["sequence_id"] for r in pieces})


def test_noise_and_unknown_languages_are_rejected(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = " ".join(chr(97 + i * 7 % 26) + "qxz"[i % 3] + chr(97 + i * 11 % 26) + "wkvj"[i % 4] for i in range(400))
    other = " ".join("".join(chr(0x3041 + (i * j * 7 + j) % 80) for j in range(1, 9)) for i in range(60))
    odd = spark.createDataFrame([(-1, noise, None, "s", 1), (-2, other, None, "s", 1), (-3, "Ja.", None, "s", 1)], known.schema)
    left = corpus_pipeline.language(spark, known.unionByName(odd), sf_dir)
    assert {r["doc_id"] for r in left.where("doc_id < 0").collect()} == {-3}
    lettered = known.where("text RLIKE '\\\\p{L}'")
    assert left.where("doc_id >= 0").count() == lettered.count()


def test_different_texts_of_one_id_stay(spark, sf_dir):
    rows = [(1, SENTENCE.format("one"), "a"), (1, SENTENCE.format("two") + " with an end of its own that nothing else has", "b"),
            (1, SENTENCE.format("one"), "c"), (2, SENTENCE.format("one") + " x", "d"), (3, "something else altogether stands in this short text", "e"), (None, "no id", "f"), (None, "no id", "g")]
    got = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id BIGINT, text STRING, _place STRING")
        out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
        assert out.columns == docs.columns
        got.add(tuple(sorted((str(r["doc_id"]), r["text"], r["_place"]) for r in out.collect())))
    assert len(got) == 1
    kept = [(i, t) for i, t, _ in got.pop()]
    assert len(kept) == 5 and [i for i, _ in kept] == ["1", "1", "3", "None", "None"]


def test_empty_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    assert docs.count() == 0


def test_entry_works_without_the_optional_operators(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "folioflow.llm", "folioflow.llm.queries"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("folioflow.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    path = Path(corpus_pipeline.__file__).with_name("__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_alone", path)
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries()
    assert "translate_corpus" in names and "pipeline" not in names and not [n for n in names if n.startswith("op1_")]


def test_texts_stay_where_they_are_when_documents_are_dropped(spark):
    import corpus_pipeline
    from folioflow.operators.shared import materialise

    docs = materialise(spark.range(50).selectExpr("id AS doc_id", "concat('text ', id) AS text"), "docs")
    dropped = materialise(spark.range(0, 50, 7).selectExpr("id AS doc_id"), "dropped")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline._without(docs, dropped, "doc_id")
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(50) if i % 7]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
