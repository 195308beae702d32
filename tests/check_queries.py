"""Run registered queries next to their SQL statements on DuckDB and compare all values.

    python tests/check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DIGITS = 9  # the statements round to 6: allow for the last bits of sums only
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return value if math.isinf(value) else round(value, DIGITS)
    return value


def _family(value) -> str:
    return "number" if isinstance(value, float) or hasattr(value, "as_tuple") else type(value).__name__


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(cells, key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, run, sql) -> tuple[str, int]:
    """``ok`` or what differs, and the number of rows."""
    df = run(spark, sf_dir)
    raw = [tuple(r) for r in df.collect()]
    columns, rows = _canonical(df.columns, raw)
    if sql is None:
        return "rows only", len(rows)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    fetched = result.fetchall()
    expected_columns, expected = _canonical(names, fetched)
    for i, name in enumerate(df.columns):
        kinds = {_family(r[i]) for r in raw if r[i] is not None}
        wanted = {_family(r[names.index(name)]) for r in fetched if name in names
                  and r[names.index(name)] is not None}
        if kinds != wanted and raw:
            return f"column {name} is {kinds} instead of {wanted}", len(raw)
    if columns != expected_columns:
        return f"columns {columns} instead of {expected_columns}", len(rows)
    if len(rows) != len(expected):
        return f"{len(rows)} rows instead of {len(expected)}", len(rows)
    for got, want in zip(rows, expected, strict=True):
        if got != want:
            return f"{got} instead of {want}", len(rows)
    return "ok", len(rows)


def main() -> int:
    import __spark_entry__ as entry
    from sievewright.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:] or list(entry.queries())
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            verdict, n = compare(
                spark, con, sf_dir, entry.queries()[name], entry.oracle_sql().get(name)
            )
        except Exception as error:  # keep going: one report for all queries
            verdict, n = f"{type(error).__name__}: {str(error)[:600]}", 0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:28s} {time.time() - start:6.2f}s {n:7d} rows  {verdict}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(main())
