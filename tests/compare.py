"""Compare registered queries with their SQL, side by side: ``python -m tests.compare [names]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


TIMES: dict[str, float] = {}


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT or x is pd.NA:
        return "∅"
    if isinstance(x, float):
        return f"{x:.6f}" if x != int(x) else str(int(x))
    if hasattr(x, "tolist"):
        x = x.tolist()
    return str(x)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted(tuple(_cell(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str:
    """'' when equal, else what differs."""
    df = fn(spark, sf_dir)
    began = time.time()
    got = df.toPandas()
    TIMES["collect"] = time.time() - began
    if sql is None:
        return "" if len(got) else "no rows"
    began = time.time()
    want = con.execute(sql).fetch_df() if hasattr(con, "fetch_df") else con.execute(sql).df()
    TIMES["sql"] = time.time() - began
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a == b:
        return "" if a else "equal but empty"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} vs {len(b)}; cols {sorted(got.columns)}\n   spark: {str(only_a[:2])[:700]}\n   sql:   {str(only_b[:2])[:700]}"


def main() -> None:
    from pyspark.sql import SparkSession

    from parley.plans import ORACLES, QUERIES

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    picked = [n for n in QUERIES if not sys.argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in sys.argv[1:])]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.log.level", "OFF").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    con = connect(sf_dir)
    bad = 0
    for n in picked:
        t = time.time()
        try:
            diff = compare(spark, con, sf_dir, n, QUERIES[n], ORACLES.get(n))
        except Exception as e:  # noqa: BLE001
            diff = "ERROR " + str(e)[:500] + ("\n" + traceback.format_exc()[-700:] if os.environ.get("TB") else "")
        bad += bool(diff)
        print(f"{'ok  ' if not diff else 'BAD '} {n} {time.time() - t:.1f}s (collect {TIMES.get('collect', 0):.1f}, sql {TIMES.get('sql', 0):.1f}) {'' if n in ORACLES else '(rows only)'} {diff}", flush=True)
    print(f"{len(picked)} queries, {bad} bad")


if __name__ == "__main__":
    main()
