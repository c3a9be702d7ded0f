"""Run named queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def norm(value):
        if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
            return None
        if hasattr(value, "item") and not hasattr(value, "__len__"):
            value = value.item()
        if isinstance(value, bool):
            return value
        if isinstance(value, float):
            return int(value) if value == int(value) and abs(value) < 1e15 else value
        if hasattr(value, "__len__") and not isinstance(value, str):
            return tuple(norm(v) for v in value)
        return value

    columns = sorted(df.columns)
    rows = [tuple(norm(v) for v in row) for row in df[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} vs {len(duck_df)}"
    left, right = canonical(spark_df), canonical(duck_df)
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(bad)} rows differ, first: {bad[0]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from utterset.queries import all_oracles, all_queries
    from utterset.session import get_session

    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = all_queries(), all_oracles()
    failures = 0
    for name in names or list(queries):
        start = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            got = frame.toPandas()
            spent = time.time() - start
            if name in oracles:
                start = time.time()
                want = con.execute(oracles[name]).df()
                problem = compare(got, want)
                status = problem or "ok"
                types = dict(zip(want.columns, map(str, want.dtypes)))
                mine = dict(zip(got.columns, map(str, got.dtypes)))
                odd = {c: (mine[c], types.get(c)) for c in mine if mine[c] != types.get(c)}
                if odd and not problem:
                    status += f"  types {odd}"
                failures += bool(problem)
                print(f"{name:36s} {len(got):7d} rows {spent:6.1f}s duck {time.time() - start:5.1f}s {status}", flush=True)
            else:
                print(f"{name:36s} {len(got):7d} rows {spent:6.1f}s (rows only)", flush=True)
        except Exception as exc:  # report and go on
            failures += 1
            print(f"{name:36s} FAILED {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
        spark.catalog.clearCache()
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
