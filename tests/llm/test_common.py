from types import SimpleNamespace

import pyarrow as pa

from folioflow.llm import common


def test_workers_give_back_after_their_work_what_is_free(monkeypatch):
    done = []
    conf = SimpleNamespace(get=lambda name: "1000")
    rows = SimpleNamespace(sparkSession=SimpleNamespace(conf=conf), mapInArrow=lambda run, schema: run)

    def work(batches):
        for batch in batches:
            done.append("work")
            yield batch

    run = common.in_arrow(rows, work, "id BIGINT")
    monkeypatch.setattr(common, "give_back", lambda: done.append("back"))
    batch = pa.RecordBatch.from_pydict({"id": [1]})
    assert list(run(iter([batch, batch]))) == [batch, batch]
    assert done == ["work", "work", "back"]


def test_memory_can_be_given_back_anywhere():
    common.give_back()
