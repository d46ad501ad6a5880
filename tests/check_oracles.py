"""Compare registered queries with their SQL on DuckDB: python tests/check_oracles.py [sf] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _norm(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "∅" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else _text(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def _text(v: object) -> str:
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def compare(spark, name: str, fn, sql: str | None, sf_dir: str) -> str:
    started = time.time()
    df = fn(spark, sf_dir)
    got = df.toPandas()
    took = time.time() - started
    if sql is None:
        return f"rows-only {len(got)} rows {took:.1f}s"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = _norm(got), _norm(want)
    if len(a) != len(b):
        return f"FAIL rows {len(a)} vs {len(b)}\n{a.head(4).to_string()}\n{b.head(4).to_string()}"
    if len(a) and not a.equals(b):
        bad = (a != b).any(axis=1)
        return (
            f"FAIL values in {int(bad.sum())} of {len(a)} rows\n"
            f"{a[bad].head(3).to_dict('records')}\n{b[bad].head(3).to_dict('records')}"
        )
    return f"ok {len(a)} rows {took:.1f}s"


def main() -> None:
    import __spark_entry__ as entry
    from sluice.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    spark = build_session(
        "check",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            result = compare(spark, name, fn, oracles.get(name), f"/root/testdata/sf{sf}")
        except Exception as error:  # noqa: BLE001
            result = "FAIL " + str(error)[:900]
        failed += result.startswith("FAIL")
        print(f"{name}: {result}", flush=True)
    print(f"failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
