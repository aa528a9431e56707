"""Compare queries with their SQL: ``python -m glyphline.plans.check [sf dir] [names...]``."""

from __future__ import annotations

import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(_cell(x) for x in v.values())
    return v


def _kind(v):
    v = type(v).__name__
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t)
    )


def compare(spark, con, name: str, sf: str) -> tuple[str, str]:
    """('ok' | 'rows-only' | 'FAIL', detail)."""
    from .queries import QUERIES, SQL

    df = QUERIES[name](spark, sf)
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return "rows-only", f"{len(got)} rows"
    cur = con.execute(SQL[name])
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    gc, g = _rows(got_cols, got)
    wc, w = _rows(want_cols, want)
    if gc != wc:
        return "FAIL", f"columns {gc} vs {wc}"
    if len(g) != len(w):
        return "FAIL", f"{len(g)} rows vs {len(w)}; spark {g[:2]} sql {w[:2]}"
    for a, b in zip(g, w):
        if a != b or any(type(p) is not type(q) for p, q in zip(a, b)):
            diff = sum(1 for p, q in zip(g, w) if p != q)
            return "FAIL", f"{diff} of {len(g)} rows differ; spark {a} sql {b}"
    return "ok", f"{len(g)} rows"


def main(argv):
    from ..session import local_session
    from .queries import QUERIES

    sf = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(8), connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            verdict, detail = compare(spark, con, n, sf)
        except Exception as e:  # report and go on with the next query
            verdict, detail = "FAIL", f"{type(e).__name__}: {str(e)[:600]}"
        bad += verdict == "FAIL"
        print(f"{verdict:9} {n:24} {time.time() - t:6.2f}s {detail[:900]}", flush=True)
    print(f"{len(names)} queries, {bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
