"""Order-insensitive comparison of a Spark result with its SQL statement in DuckDB."""

from __future__ import annotations

import math
import time


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(cell(v)) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{cell(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return cell(value.asDict())
    return str(value)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(cell(row[i]) for i in order) for row in rows), key=repr
    )


def run_pair(spark, con, sf_dir, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    spent = time.time() - start
    names, mine = table(rows, df.columns)
    if sql is None:
        return True, f"rows={len(rows)} spark={spent:.2f}s (rows only)"
    start = time.time()
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    theirs_names, theirs = table(cur.fetchall(), theirs_names)
    note = f"rows={len(mine)} spark={spent:.2f}s sql={time.time() - start:.2f}s"
    if names != theirs_names:
        return False, f"{note} columns {names} vs {theirs_names}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return False, (
            f"{note} vs {len(theirs)}; only spark: {sorted(a - b, key=repr)[:3]}; only sql: {sorted(b - a, key=repr)[:3]}"
        )
    return bool(mine), note
