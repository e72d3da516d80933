"""Run queries and their SQL on the same tables and report where rows differ.

Usage: python tests/side_by_side.py [sf dir] [name or prefix ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry_module  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pdf[c].dtype == object:
            pdf[c] = pdf[c].map(lambda v: v if v is None or isinstance(v, (str, bool)) else float(v))
    return pdf.sort_values(list(pdf.columns), ignore_index=True, na_position="first")


def difference(spark_pdf, sql_pdf):
    """None when the rows are the same, else what differs."""
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(sql_pdf.columns)}"
    if len(spark_pdf) != len(sql_pdf):
        return f"rows {len(spark_pdf)} != {len(sql_pdf)}"
    a, b = canonical(spark_pdf), canonical(sql_pdf)
    for c in a.columns:
        left, right = a[c], b[c]
        both_null = left.isna() & right.isna()
        bad = ~((left == right) | both_null)
        if bad.any():
            i = bad.idxmax()
            return f"{c}: {int(bad.sum())} rows, e.g. {left[i]!r} != {right[i]!r}"
        # a whole number that is sometimes null has one type in each engine's frame
        if str(left.dtype) != str(right.dtype) and {str(left.dtype), str(right.dtype)} != {"float64", "Int64"}:
            return f"{c}: type {left.dtype} != {right.dtype}"
    return None


def main():
    from tests.conftest import make_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    wanted = [a for a in args if "/" not in a]
    spark, con = make_session(), connect(sf_dir)
    oracle = entry_module.oracle_sql()
    failed = 0
    for name, query in entry_module.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            started = time.time()
            got = query(spark, sf_dir).toPandas()
            took = time.time() - started
            if name not in oracle:
                print(f"rows {len(got):7d} {took:6.2f}s {name} (no SQL)")
                continue
            started = time.time()
            want = con.execute(oracle[name]).fetchdf()
            bad = difference(got, want)
            print(f"{'DIFF' if bad else 'same'} {len(got):7d} {took:6.2f}s sql {time.time() - started:5.2f}s {name} {bad or ''}")
            failed += bool(bad)
        except Exception as error:
            failed += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:700]}")
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
