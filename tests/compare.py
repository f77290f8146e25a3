"""Run queries beside their SQL and compare whole results.

Usage: python tests/compare.py [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canon(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}") + 0.0
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def difference(spark, con, folder: str, name: str, build, sql: str | None) -> str | None:
    """None if both results agree, else a short account of how they differ."""
    df = build(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    types_got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types_want = {c[0]: str(c[1]).lower() for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    same = {"varchar": "string", "integer": "int", "timestamp": "timestamp_ntz"}
    for column, want_type in types_want.items():
        want_type = same.get(want_type, want_type)
        if want_type != types_got[column]:
            return f"type of {column}: {types_got[column]} against {want_type}"
    if not want:
        return "no rows on either side" if not got else f"{len(got)} rows against none"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows against {len(want)}; only here {str(extra)[:600]}; only there {str(missing)[:600]}"
    return None


def main(names: list[str]) -> int:
    import __spark_entry__ as e
    from bitloom.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = build_session("compare"), duck(folder)
    sqls, bad = e.oracle_sql(), 0
    for name, build in e.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            note = difference(spark, con, folder, name, build, sqls.get(name))
        except Exception as err:
            note = f"{type(err).__name__}: {str(err)[:1500]}"
        bad += note is not None
        print(f"{'ok ' if note is None else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in sqls else '(rows only) '}{note or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
