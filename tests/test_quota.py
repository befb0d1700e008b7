from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.config import Quota
from folioflow.operators import quota


def requests(spark, rows):
    return quota.arrivals(spark.createDataFrame(rows, "event_id BIGINT, client STRING, ts STRING").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")), "client")


def allowed(df, *quotas):
    return sorted(r.event_id for r in quota.with_verdicts(df, quotas).where("allowed").collect())


def test_periods_are_those_of_utc_in_any_session(spark):
    rows = [(1, "c", "2024-03-01 00:30:00"), (2, "c", "2024-03-01 06:30:00"), (3, "c", "2024-03-02 00:10:00")]
    want = allowed(requests(spark, rows), Quota("day", 1))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert allowed(requests(spark, rows), Quota("day", 1)) == want == [1, 3]
        report = quota.quota_report(requests(spark, rows), [Quota("day", 1)]).first()
        assert (report.n_requests, report.over_day, report.n_admitted) == (3, 1, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_limits_of_any_size_meet_in_few_rows(spark):
    """No window ranks all arrivals of a client at once, also beyond the optimiser's threshold."""
    df = spark.range(6_000).select(
        F.col("id").alias("event_id"), F.lit("one").alias("client"), F.timestamp_seconds(F.col("id")).alias("ts"))
    for limit in (5, 1_000, 1_001, 5_000):
        got = quota.first_of_period(df, Quota("day", limit))
        assert got.agg(F.count(F.lit(1)), F.max("event_id")).first() == (limit, limit - 1)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("row_number()") >= 2 and "_salt" in plan
