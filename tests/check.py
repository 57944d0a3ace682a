"""Compare one Spark query with its SQL on the same tables; usable from pytest and the shell."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    # Spill to scratch space and not into the working folder; refuse runaway joins.
    con.execute(f"SET temp_directory='{tempfile.mkdtemp(prefix='spark-')}'")
    con.execute("SET max_temp_directory_size='5GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def compare(spark_df, con, sql: str) -> str:
    """Empty text when equal, else a description."""
    got, names = _rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    cur = con.execute(sql)
    want, want_names = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ; {bad[:2]}" if bad else ""


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from seqloom.session import build_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = build_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = oracle_connection(sf_dir)
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                note = compare(df, con, oracles[name])
            else:
                note = "" if df.count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(note)
        flag = "ok  " if not note else "FAIL"
        print(f"{flag} {name} {time.time() - start:.1f}s {'' if name in oracles else '(no sql)'} {note}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
