"""Request quotas: the first *n* arrivals of a client per calendar period pass.

A single client may send a large part of all requests, so no task ranks a whole client: arrivals
are first ranked within (client, period, salt), where at most *n* of each pass, and only those
meet per client and period. That holds for every limit; for limits up to Spark's threshold for
window group limits the first ranking also takes place below the shuffle. Periods are those of
UTC, whatever the session's time zone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.config import Quota

MICROS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def arrivals(events: DataFrame, client: str) -> DataFrame:
    """Uniform shape: ``(event_id, client, ts)``. Times without a zone are taken as UTC."""
    ts = F.col("ts").cast("timestamp")
    if dict(events.dtypes)["ts"] == "timestamp_ntz":
        ts = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    return events.select("event_id", F.col(client).alias("client"), ts.alias("ts"))


def period_of(ts: Column, period: str) -> Column:
    """Start of the calendar period in UTC."""
    unit = MICROS[period]
    return F.timestamp_micros((F.floor(F.unix_micros(ts) / unit) * unit).cast("bigint"))


def first_arrivals(requests: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows per ``client`` and ``period`` in order of time, then id, with ``rank``."""
    pieces = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["ts", "event_id"]
    salted = requests.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(pieces)))
    within = Window.partitionBy("client", "period", "_salt").orderBy(*order)
    few = salted.withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= limit).drop("_rank", "_salt")
    in_order = Window.partitionBy("client", "period").orderBy(*order)
    return few.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= limit)


def first_of_period(requests: DataFrame, quota: Quota) -> DataFrame:
    """The arrivals one quota lets through, in order of time, then id."""
    timed = requests.withColumn("period", period_of(F.col("ts"), quota.period))
    return first_arrivals(timed, quota.limit).select("event_id", "client", "ts")


def admitted(requests: DataFrame, quotas: Sequence[Quota]) -> DataFrame:
    """Arrivals that all quotas let through. Every arrival counts, also a refused one.

    Longest period first: what passes it is a prefix of the period, so ranks within a
    shorter period inside it are the same before and after.
    """
    longest_first = sorted(quotas, key=lambda q: ("day", "hour", "minute").index(q.period))
    return reduce(first_of_period, longest_first, requests)


def with_verdicts(requests: DataFrame, quotas: Sequence[Quota]) -> DataFrame:
    """Every arrival with ``within_<period>`` per quota and ``allowed``.

    Passing ids are joined back on the event id, which spreads evenly whatever the clients do.
    """
    flags = [f"within_{q.period}" for q in quotas]
    passing = [
        first_of_period(requests, q).select("event_id", *[F.lit(f == flag).alias(f) for f in flags])
        for q, flag in zip(quotas, flags)
    ]
    merged = reduce(DataFrame.unionByName, passing).groupBy("event_id").agg(*[F.bool_or(f).alias(f) for f in flags])
    joined = requests.join(merged, "event_id", "left").withColumns(
        {f: F.coalesce(f, F.lit(False)) for f in flags}
    )
    return joined.withColumn("allowed", reduce(lambda a, b: a & b, [F.col(f) for f in flags]))


def quota_report(requests: DataFrame, quotas: Sequence[Quota]) -> DataFrame:
    """Per client: arrivals, arrivals beyond each quota, and arrivals admitted.

    Each measure comes from counts per client and period, so only sums meet per client.
    """
    shortest = min(quotas, key=lambda q: ("minute", "hour", "day").index(q.period))
    by_period = requests.groupBy("client", period_of(F.col("ts"), shortest.period).alias("period")).agg(
        F.count(F.lit(1)).alias("n")
    )
    measures = ["n_requests", *[f"over_{q.period}" for q in quotas], "n_admitted"]

    def measure(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select("client", *[(value if m == name else F.lit(0)).cast("bigint").alias(m) for m in measures])

    found = [measure(by_period, "n_requests", F.col("n"))]
    for q in quotas:
        longer = by_period.groupBy("client", period_of(F.col("period"), q.period)).agg(F.sum("n").alias("n"))
        found.append(measure(longer, f"over_{q.period}", F.greatest(F.col("n") - q.limit, F.lit(0))))
    found.append(measure(admitted(requests, quotas), "n_admitted", F.lit(1)))
    return reduce(DataFrame.unionByName, found).groupBy("client").agg(*[F.sum(m).alias(m) for m in measures])
