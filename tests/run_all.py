"""Runs every query and compares it with its oracle: ``python tests/run_all.py <sf_dir> [names...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from claimsweep.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def show(v):
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    started = time.time()
    df = queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return took, "no oracle", len(mine[1]), ""
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if mine[0] != theirs[0]:
        return took, "COLUMNS", len(mine[1]), f"{mine[0]} vs {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]) - set(theirs[1]), set(theirs[1]) - set(mine[1])
        return took, "DIFF", len(mine[1]), f"{len(mine[1])} vs {len(theirs[1])} rows\n  spark {sorted(a)[:3]}\n  oracle {sorted(b)[:3]} ({len(a)}/{len(b)})"
    return took, "ok", len(mine[1]), ""


def main():
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = build_session("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                    "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name in names:
        try:
            took, state, n, why = compare(spark, con, name, sf_dir)
            print(f"{name:28s} {state:10s} {n:8d} rows {took:6.1f}s {why}", flush=True)
        except Exception as e:  # report and go on
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main()
