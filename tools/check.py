"""Compare registered queries with their SQL on one data directory.

    python tools/check.py DIRECTORY [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from stockloom.catalog import load  # noqa: E402
from stockloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canonical(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def exact_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


TYPE_CLASS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def compare(query, spark, con, directory):
    started = time.time()
    df = query(spark, directory)
    rows = [tuple(r) for r in df.collect()]
    names, mine = rows_of(df.columns, rows)
    seconds = time.time() - started
    if query.sql is None:
        return "rows-only", f"{len(mine)} rows", seconds
    cursor = con.execute(query.sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    fetched = cursor.fetchall()
    other_names, other = rows_of(columns, fetched)
    if names != other_names:
        return "FAIL", f"columns {set(names) ^ set(other_names)}", seconds
    odd = [
        (n, t, types[n]) for n, t in df.dtypes if TYPE_CLASS.get(t, types[n]) != types[n]
    ]
    if len(mine) != len(other):
        return "FAIL", f"row count {len(mine)} != {len(other)}", seconds
    bad = []
    for a, b in zip(mine, other):
        if a != b:
            close = all(
                x == y
                or (
                    isinstance(x, (int, float)) and isinstance(y, (int, float))
                    and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
                )
                for x, y in zip(a, b)
            )
            if not close:
                bad.append((a, b))
    if bad:
        return "FAIL", f"{len(bad)} rows differ; {names}\n   spark  {bad[0][0]}\n   sql    {bad[0][1]}", seconds
    if odd:
        return "TYPES", f"{len(mine)} rows {odd}", seconds
    # Equal up to float noise only: such results should be rounded.
    exact = exact_rows(df.columns, rows) == exact_rows(columns, fetched)
    return ("ok" if exact else "noise"), f"{len(mine)} rows", seconds


def main(directory: str, prefixes: list[str]) -> int:
    spark = local_session(8)
    con = connect(directory)
    failures = 0
    total = 0.0
    for name, query in load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, detail, seconds = compare(query, spark, con, directory)
        except Exception as error:  # report and go on with the next query
            status, detail, seconds = "ERROR", f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        total += seconds
        failures += status in ("FAIL", "ERROR", "TYPES")
        print(f"{status:9} {seconds:6.2f}s {name}: {detail}", flush=True)
    print(f"{failures} problems, {total:.1f}s")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
