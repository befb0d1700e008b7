"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from folioflow.plans.queries import QUERIES
from folioflow.session import session

HEADLINE = (
    "chunks", "blocks", "block_bbox", "translate_distinct", "translate_fallback", "translated_docs", "translated_docs_service",
    "translate_corpus", "rejoin_blocks", "edit_plan_preserve", "edit_plan_free", "edit_plan_service_preserve", "size_report",
    "progress", "admit", "url_screen",
    "quota", "quota_report", "stream_translate", "stream_quota",
)


RUNS = 2


def timed(spark, sf_dir: str, name: str, runs: int = 1) -> float:
    """Seconds of the fastest run, from building the plan to the last row."""
    taken = []
    for _ in range(runs):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return min(taken)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = session("bench", cpus)
    timed(spark, sf_dir, "scan_documents")  # start-up of the session is not measured
    seconds = {name: round(timed(spark, sf_dir, name, RUNS), 3) for name in HEADLINE}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    n_chunks = QUERIES["chunks"](spark, sf_dir).count()
    print(json.dumps({
        "metric": "total wall time of the headline queries, best of two runs each",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "rates": {
            "blocks_documents_per_sec": round(documents / seconds["blocks"], 1),
            "chunks_per_sec": round(n_chunks / seconds["chunks"], 1),
            "translate_distinct_chunks_per_sec": round(n_chunks / seconds["translate_distinct"], 1),
            "translated_docs_documents_per_sec": round(documents / seconds["translated_docs"], 1),
        },
        "spark": spark.version, "cpus": cpus, "driver_memory": spark.conf.get("spark.driver.memory"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
