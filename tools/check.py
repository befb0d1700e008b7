"""Compare every registered query with its SQL: ``python tools/check.py SF_DIR [name …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    """Rows in a canonical order, with every missing value as None."""
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(df.itertuples(index=False, name=None), key=repr)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"row count {len(spark_rows)} / {len(sql_rows)}"
    kinds = [
        f"{c}: {spark_rows[c].dtype} / {sql_rows[c].dtype}"
        for c in spark_rows.columns
        if len(spark_rows) and spark_rows[c].dtype.kind != sql_rows[c].dtype.kind
        # integers with missing values: pandas makes floats of Spark's
        and not (sql_rows[c].dtype.name.startswith("Int") and spark_rows[c].isna().any())
    ]
    if kinds:
        return "types " + "; ".join(kinds)
    for ours, theirs in zip(normal(spark_rows), normal(sql_rows)):
        if ours != theirs:
            return f"values {str(ours)[:300]} / {str(theirs)[:300]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from folioflow.session import session
    from folioflow.plans.oracle import ORACLE
    from folioflow.plans.queries import QUERIES

    spark = session("check")
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        rows = QUERIES[name](spark, sf_dir).toPandas()
        took = time.time() - start
        if name not in ORACLE:
            print(f"rows  {name}: {len(rows)} ({took:.1f} s)", flush=True)
            continue
        start = time.time()
        found = difference(rows, con.execute(ORACLE[name]).df())
        bad += found is not None
        print(f"{'DIFF ' if found else 'ok   '} {name}: {len(rows)} ({took:.1f} s, sql {time.time() - start:.1f} s) {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
