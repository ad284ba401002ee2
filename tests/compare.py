"""Run queries and their SQL statements side by side.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    """Column names and sorted rows, columns in name order, missing values as None."""
    names = sorted(frame.columns)

    def clean(value):
        if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
            return None
        if hasattr(value, "item"):
            value = value.item()
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value

    rows = [tuple(clean(v) for v in row) for row in frame[names].itertuples(index=False, name=None)]
    return names, sorted(rows, key=repr)


def difference(spark_frame, sql_frame) -> str | None:
    """What differs, or None."""
    names, rows = rows_of(spark_frame)
    sql_names, sql_rows = rows_of(sql_frame)
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    kinds = {n: (spark_frame[n].dtype.kind, sql_frame[n].dtype.kind) for n in names}
    odd = {
        n: k
        for n, k in kinds.items()
        if k[0] != k[1] and len(rows) and not (k == ("f", "i") and spark_frame[n].isna().any())
    }
    if odd:
        return f"types {odd}"
    if rows != sql_rows:
        first = next(((a, b) for a, b in zip(rows, sql_rows) if a != b), None)
        return f"{len(rows)} rows against {len(sql_rows)}; first difference {first}"
    return None


def main() -> None:
    import __spark_entry__ as e
    from tidecrew.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, connection = local_session(), connect(sf_dir)
    statements = e.oracle_sql()
    for name, query in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir).toPandas()
        except Exception as error:  # report and go on with the next query
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        seconds = time.time() - start
        if name not in statements:
            print(f"rows {name}: {len(frame)} rows, {seconds:.1f} s", flush=True)
            continue
        start = time.time()
        try:
            found = difference(frame, connection.sql(statements[name]).df())
        except Exception as error:
            print(f"FAIL {name} (sql): {str(error)[:1500]}", flush=True)
            continue
        state = "ok  " if found is None else "DIFF"
        print(f"{state} {name}: {len(frame)} rows, {seconds:.1f} s, sql {time.time() - start:.1f} s {found or ''}", flush=True)


if __name__ == "__main__":
    main()
