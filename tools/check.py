"""Run registered queries against the DuckDB oracle: python tools/check.py [sf] [name-substring ...]"""

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from floorlake.fixtures import BASE  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, build, sql, sf_dir):
    df = build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1]), ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if got == want:
        return True, len(got[1]), ""
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} vs {want[0]}"
    a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    note = f"rows {len(got[1])} vs {len(want[1])}; {got[0]}\n   spark  {sorted(a)[:3]}\n   oracle {sorted(b)[:3]}"
    return False, len(got[1]), note


def main(argv):
    from floorlake import plans
    from floorlake.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = oracle_connection(sf_dir)
    oracles = plans.oracle_sql()
    bad = 0
    for name, build in plans.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            ok, count, note = compare(spark, con, build, oracles.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, count, note = False, 0, f"{type(exc).__name__}: {str(exc)[:400]}"
        label = {True: "ok  ", False: "FAIL", None: "rows"}[ok]
        bad += ok is False
        print(f"{label} {name:44s} {count:8d} rows {time.time() - start:6.2f}s {note[:1200]}", flush=True)
    print(f"{bad} failing")


main(sys.argv[1:]) if __name__ == "__main__" else None
