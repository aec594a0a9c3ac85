"""Compare every registered query with its DuckDB SQL (also a command line: python tests/oracle.py sf [name...])."""
from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        return "∅" if math.isnan(value) else f"f{value!r}"
    if isinstance(value, int):
        return f"i{value}"
    return f"{type(value).__name__}{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """None when equal, else a message."""
    got_cols, got = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    want_cols, want = [d[0] for d in rel.description], rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; only spark {sorted(set(a) - set(b))[:2]} only sql {sorted(set(b) - set(a))[:2]}"
    if a != b:
        sa, sb = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        return f"{len(sa)}/{len(a)} rows differ; cols {sorted(got_cols)}; spark {sa[:2]} sql {sb[:2]}"
    if not a:
        return "EMPTY"
    return None


def session(cpus="8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("routekit")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry
    sf_dir, names = f"/root/testdata/{argv[0]}", argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = [q for q in queries if not names or any(q.startswith(n) for n in names)]
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in picked:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            note = compare(df, con, oracles[name]) if name in oracles else f"rows-only {df.count()}"
        except Exception as err:  # report and go on
            note = f"ERROR {type(err).__name__}: {str(err)[:600]}"
        bad += note is not None and not note.startswith("rows-only")
        print(f"{'ok ' if note is None else '-- ' if note.startswith('rows-only') else 'BAD'} {name} {time.time() - t0:.1f}s {note or ''}", flush=True)
    print(f"{len(picked)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
