"""Compare registered queries with their SQL on the same tables.

Run as a script: ``python -m tests.oracle_check [sf_dir] [name-prefix ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    relation = con.sql(sql)
    names = sorted(df.columns)
    if sorted(relation.columns) != names:
        return f"columns {names} vs {sorted(relation.columns)}"
    types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    spark_types = dict(df.dtypes)
    wrong = {c: (spark_types[c], types[c]) for c in names if KINDS.get(types[c], types[c]) != spark_types[c]}
    if wrong:
        return f"types {wrong}"
    quoted = ", ".join('"' + c + '"' for c in names)
    expected = [tuple(_cell(v) for v in r) for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()]
    got = [tuple(_cell(v) for v in r) for r in df.select(*["`" + c + "`" for c in names]).collect()]
    if len(got) != len(expected):
        return f"rows {len(got)} vs {len(expected)}"
    got.sort(key=_key)
    expected.sort(key=_key)
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = build_session(), connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"ok rows={df.count()}"
        except Exception as error:  # report and go on with the next query
            state = f"ERROR {type(error).__name__} {str(error)[:600]}"
        failed += not state.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
