"""Runs queries and their SQL side by side and reports every difference."""

from __future__ import annotations

import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 7) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def differences(df, con, sql: str) -> list[str]:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    got = df.collect()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for c, t in df.dtypes:
        if t in FAMILY and FAMILY[t] != kinds[c]:
            out.append(f"type of {c}: {t} vs {kinds[c]}")
    order = sorted(names)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(_cell(r[c]) for c in order) for r in got), key=key)
    at = {n: i for i, n in enumerate(names)}
    b = sorted((tuple(_cell(r[at[c]]) for c in order) for r in want), key=key)
    if len(a) != len(b):
        out.append(f"rows {len(a)} vs {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, e.g. {order}\n     {bad[0][0]}\n     {bad[0][1]}")
    return out


def main(sf: str, wanted: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from brightledger.session import local_session
    spark = local_session(8)
    sf_dir = f"/root/testdata/{sf}"
    con = duck(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            diff = differences(df, con, oracles[name]) if name in oracles else []
            note = "" if name in oracles else f" rows={len(df.collect())}"
        except Exception as e:
            diff, note = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok'} {name} {time.time() - start:.2f}s{note}", *(f"\n   {x}" for x in diff), flush=True)
        spark.catalog.clearCache()
    print("failed", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
