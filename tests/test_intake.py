from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.config import MODEL_LIST_QUOTAS, TRANSLATE_QUOTAS, AdmissionRules, Endpoint, Quota, ServerDefaults
from folioflow.operators import admission as ad
from folioflow.operators import quota

GOOD = dict(source_lang="English", target_lang="Turkish", content=b"%PDF-1.7", declared="8", n_pages=1, has_key=True,
            base_url="https://llm.example.com/v1")
SCHEMA = ("source_lang STRING, target_lang STRING, content BINARY, declared STRING, n_pages INT, has_key BOOLEAN, base_url STRING")


def verdicts(spark, changes, **rules):
    rows = [tuple({**GOOD, **c}.values()) for c in changes]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("i", F.monotonically_increasing_id())
    return [r.verdict for r in ad.with_verdict(df, AdmissionRules(**rules)).orderBy("i").collect()]


def test_first_broken_rule_names_the_verdict(spark):
    big = b"%PDF-" + b"x" * 1_048_576
    cases = [
        ({}, "admitted"),
        (dict(source_lang="Klingon", has_key=False), "language"),
        (dict(target_lang=None), "language"),
        (dict(target_lang="English"), "admitted"),
        (dict(has_key=False, content=b""), "credentials"),
        (dict(base_url="http://x.example", declared="9" * 30), "url"),
        (dict(base_url="https://10.0.0.1/", content=b""), "url"),
        (dict(base_url=" https://llm.example.com/v1\n"), "admitted"),
        (dict(base_url=" "), "admitted"),
        (dict(base_url=None), "admitted"),
        (dict(has_key=None), "credentials"),
        (dict(declared=str(1_048_576 + 65_536)), "admitted"),
        (dict(declared=str(1_048_576 + 65_537), content=b""), "declared_length"),
        (dict(declared="9" * 40), "declared_length"),
        (dict(declared="0" * 40 + "7"), "admitted"),
        (dict(declared="-5"), "admitted"),
        (dict(declared=None), "admitted"),
        (dict(content=b"", n_pages=None), "empty"),
        (dict(content=None), "empty"),
        (dict(content=b"x" + big), "magic"),
        (dict(content=big, n_pages=9), "size"),
        (dict(content=big[:1_048_576]), "admitted"),
        (dict(n_pages=None), "unreadable"),
        (dict(n_pages=4), "pages"),
        (dict(n_pages=3), "admitted"),
    ]
    assert verdicts(spark, [c for c, _ in cases]) == [v for _, v in cases]


def test_url_and_key_rules_depend_on_the_server(spark):
    odd = [dict(has_key=False), dict(base_url="http://127.0.0.1/")]
    assert verdicts(spark, odd, hosted=False) == ["admitted", "admitted"]
    assert verdicts(spark, odd, server_has_key=True) == ["admitted", "url"]


@pytest.mark.parametrize("hosted, server_key, no_key", [
    (True, True, ("server", "https://s", "sm")), (True, False, ("rejected", None, None)),
    (False, False, ("local", "http://l", "lm")), (False, True, ("server", "https://s", "sm")),
])
def test_routing(spark, hosted, server_key, no_key):
    defaults = ServerDefaults(Endpoint("https://c", "cm"), Endpoint("https://s", "sm"), Endpoint("http://l", "lm"), hosted, server_key)
    jobs = [(1, True, " https://own ", "\t"), (2, True, None, " m "), (3, False, "https://own", "m")]
    df = spark.createDataFrame(jobs, "job_id INT, has_key BOOLEAN, base_url STRING, model STRING")
    rows = ad.route_jobs(df, defaults).orderBy("job_id").collect()
    assert [(r.route, r.eff_base_url, r.eff_model) for r in rows] == [
        ("caller", "https://own", "cm"), ("caller", "https://c", "m"), no_key,
    ]


def test_language_filter_reaches_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(ad.language_allowed(F.col("lang"), ["en", "fr"])).select("doc_id")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "In(lang, [en,fr])" in plan.split("PushedFilters")[1] and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_output_cap(spark):
    df = spark.createDataFrame([(b"1234",), (b"12345",), (None,)], "o BINARY")
    assert [r.status for r in ad.capped_output(df, "o", 4).collect()] == ["done", "too_large", "done"]


# --- quotas --------------------------------------------------------------------------------


def by_hand(events, quotas):
    seen, out = defaultdict(int), {}
    form = {"minute": "%Y%m%d%H%M", "hour": "%Y%m%d%H", "day": "%Y%m%d"}
    for event_id, client, ts in sorted(events, key=lambda e: (e[2], e[0])):
        ok = []
        for q in quotas:
            at = (client, q.period, ts.strftime(form[q.period]))
            seen[at] += 1
            ok.append(seen[at] <= q.limit)
        out[event_id] = ok
    return out


def busy(n=6000):
    """Half of the arrivals come from one client, many in the same second."""
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    return [
        (i, rng.choice(["hot", "hot", "hot", "a", "b", None]), start + timedelta(seconds=rng.randrange(3 * 86_400) // 30 * 30))
        for i in range(n)
    ]


@pytest.mark.parametrize("quotas", [
    TRANSLATE_QUOTAS, MODEL_LIST_QUOTAS, (Quota("minute", 1), Quota("hour", 3), Quota("day", 10)),
])
def test_quotas_against_brute_force(spark, quotas):
    events = busy()
    df = spark.createDataFrame(events, "event_id BIGINT, client STRING, ts TIMESTAMP").repartition(6)
    want = by_hand(events, quotas)
    rows = quota.with_verdicts(df, quotas).collect()
    assert {r.event_id: [r[f"within_{q.period}"] for q in quotas] for r in rows} == want
    assert all(r.allowed == all(want[r.event_id]) for r in rows)
    passed = {r.event_id for r in quota.admitted(df, quotas).collect()}
    assert passed == {i for i, ok in want.items() if all(ok)}
    clients = {e[0]: e[1] for e in events}
    report = {r.client: r for r in quota.quota_report(df, quotas).collect()}
    assert {c: r.n_requests for c, r in report.items()} == Counter(clients.values())
    for c, r in report.items():
        mine = [ok for i, ok in want.items() if clients[i] == c]
        assert r.n_admitted == sum(map(all, mine))
        assert [r[f"over_{q.period}"] for q in quotas] == [sum(not ok[n] for ok in mine) for n in range(len(quotas))]


def test_quota_forwards_few_rows_of_a_busy_client(spark):
    df = spark.createDataFrame(busy(100), "event_id BIGINT, client STRING, ts TIMESTAMP")
    plan = quota.admitted(df, TRANSLATE_QUOTAS)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
