"""Run a registered query and its SQL equivalent on the same folder and compare values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if type(v).__name__ == "Row":
        return tuple(sorted((k, _cell(x)) for k, x in v.asDict().items()))
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=repr)


def compare(df, con, sql: str) -> tuple[bool, str, int]:
    got_cols, got = _table(df.columns, df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want_cols, want = _table(names, res.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got)
    spark_kind = {f.name: f.dataType.simpleString() for f in df.schema}
    for c in names:
        a, b = spark_kind[c], types[c]
        if ("DECIMAL" in b or "HUGEINT" in b) or (a == "double") != (b == "DOUBLE"):
            return False, f"type of {c}: {a} vs {b}", len(got)
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; only spark {list(set(got) - set(want))[:3]} only sql {list(set(want) - set(got))[:3]}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        only = [x for x in got if x not in set(want)][:2] if len(got) < 20000 else bad[:1]
        other = [x for x in want if x not in set(got)][:2] if len(got) < 20000 else []
        return False, f"{len(bad)} differ; columns {got_cols}; spark {only} sql {other}", len(got)
    return True, "ok", len(got)
