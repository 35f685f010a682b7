"""Compare registered queries with their reference SQL on one folder of tables."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else v
    if type(v).__name__ == "Decimal":
        return _plain(float(v))
    return str(v) if type(v).__name__ in ("date", "datetime") else v


def compare(con, name: str, df, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    got_cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != got_cols:
        return f"columns {got_cols} vs {sorted(names)}"
    order = [names.index(c) for c in got_cols]
    want = [tuple(_plain(row[i]) for i in order) for row in cur.fetchall()]
    got = [tuple(_plain(row[c]) for c in got_cols) for row in df.collect()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    extra, missing = set(a) - set(b), set(b) - set(a)
    if extra or missing:
        return f"{len(extra)} rows differ {got_cols}: {sorted(extra, key=repr)[:2]} vs {sorted(missing, key=repr)[:2]}"
    return None if a == b else "same rows, other counts"


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from tidecast.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    pick = argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    for name, fn in e.queries().items():
        if pick and not any(name.startswith(p) for p in pick):
            continue
        start = time.time()
        try:
            df, sql = fn(spark, sf), e.oracle_sql().get(name)
            note = compare(con, name, df, sql) if sql else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            note = "ERROR " + " ".join(str(error).split())[:600]
        ok = note is None or note.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print("failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
