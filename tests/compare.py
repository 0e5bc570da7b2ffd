"""Run registered queries beside their DuckDB SQL and compare whole results."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from geoevents.plans import registry
from geoevents.plans.adapter import TABLES
from geoevents.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if type(value).__name__ == "Decimal":
        return ("decimal", float(value))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


FAMILY = {"ByteType": "int", "ShortType": "int", "IntegerType": "int", "LongType": "int", "DoubleType": "float", "FloatType": "float",
          "StringType": "str", "BooleanType": "bool", "TimestampType": "ts", "TimestampNTZType": "ts", "DateType": "date"}
DUCK_FAMILY = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool", "TIMESTAMP": "ts", "DATE": "date", "HUGEINT": "hugeint"}


def check(name: str, spark, con, sf_dir: str) -> tuple[str, int]:
    """("ok" or what differs, number of rows)."""
    df = registry.QUERIES[name](spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLES:
        return "no oracle", len(got)
    rel = con.execute(registry.ORACLES[name])
    cols = [d[0] for d in rel.description]
    duck_types = {d[0]: str(d[1]) for d in rel.description}
    want_cols, want = _rows(cols, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    for field in df.schema.fields:
        a, b = FAMILY.get(type(field.dataType).__name__, str(field.dataType)), DUCK_FAMILY.get(duck_types[field.name], duck_types[field.name])
        if a != b:
            return f"type of {field.name}: {a} != {b}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only spark {sorted(set(map(str, got)) - set(map(str, want)))[:2]}; only duck {sorted(set(map(str, want)) - set(map(str, got)))[:2]}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else "ok"), len(got)


if __name__ == "__main__":
    folder, wanted = "/root/testdata/sf0.01", []
    for arg in sys.argv[1:]:
        if arg.startswith("/"):
            folder = arg
        else:
            wanted.append(arg)
    registry.load()
    session = local_session("compare", cpus="8")
    duck = connect(folder)
    names = [n for n in registry.QUERIES if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) or registry.QUERIES[n].__qualname__ == w for w in wanted)]
    modules = [w[2:] for w in wanted if w.startswith("m:")]
    if modules:
        names += [n for n in registry.QUERIES if registry.MODULE[n] in modules and n not in names]
    failed = 0
    for n in names:
        start = time.time()
        try:
            verdict, count = check(n, session, duck, folder)
        except Exception as error:  # noqa: BLE001
            verdict, count = f"{type(error).__name__}: {str(error)[:700]}", -1
        failed += verdict not in ("ok", "no oracle")
        empty = "  EMPTY" if count == 0 else ""
        print(f"{'  ' if verdict in ('ok', 'no oracle') else '!!'} {n:28} {count:7} rows {time.time()-start:6.2f}s {verdict}{empty}", flush=True)
    print(f"{len(names)} checked, {failed} failed")
