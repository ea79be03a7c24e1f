"""Runs a query and its SQL side by side and compares columns, types and rows."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    if isinstance(x, Decimal):
        return plain(float(x))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def difference(frame, con, sql):
    """None if they agree, else what is wrong."""
    columns = sorted(frame.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})")
    kinds = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(kinds) != columns:
        return f"columns {columns} and {sorted(kinds)}"
    wrong = {c: (k, kinds[c]) for c, k in frame.dtypes if KINDS.get(k, k) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    want = Counter(tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall())
    got = Counter(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    if got != want:
        return f"rows {sum(got.values())} and {sum(want.values())}; only here {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}; {columns}"
    return None
