"""Run registered queries and their SQL side by side and compare the values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description of the first difference."""
    got_c, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_c, want = _rows(rel.columns, rel.fetchall())
    if got_c != want_c:
        return f"columns {got_c} != {want_c}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if not diff:
        compare.rows = len(got)
        return None
    g, w = diff[0]
    cols = [(c, a, b) for c, a, b in zip(got_c, g, w) if a != b]
    return f"{len(diff)} of {len(got)} rows differ, first: {cols}"[:900]


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tidewire.session import build_session

    if os.environ.get("PLAIN_SESSION"):
        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = build_session("local[8]", 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    picked = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    for name in picked:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(queries[name](spark, sf_dir), con, oracles[name])
                kind = f"value, {compare.rows} rows"
            else:
                n = queries[name](spark, sf_dir).count()
                kind, problem = f"rows={n}", None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            kind, problem = "error", str(e).strip()[:700]
        bad += problem is not None
        print(f"{'OK ' if problem is None else 'BAD'} {name} [{kind}] {time.time() - start:.2f}s" + (f"\n    {problem}" if problem else ""), flush=True)
    print(f"{len(picked)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
