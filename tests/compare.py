"""Compare registered queries with their SQL, column by column and row by row."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v: object) -> object:
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return str(v)


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}


def check(con, spark, entry, sf_dir: str) -> str | None:
    df = entry.run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if entry.sql is None:
        return None if got else "no rows"
    res = con.execute(entry.sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in order) for r in res.fetchall())
    for c, t in df.dtypes:
        if t in SAME_TYPE and types[c] != SAME_TYPE[t]:
            return f"type of {c}: {t} != {types[c]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = Counter(got), Counter(want)
    only_got, only_want = sorted((a - b).elements()), sorted((b - a).elements())
    if only_got:
        return (f"{len(only_got)}/{len(got)} rows differ ({cols}):\n   spark={str(only_got[:3])[:700]}"
                f"\n   sql={str(only_want[:3])[:700]}")
    return None if got else "EMPTY"


def main(argv: list[str]) -> int:
    from threadloom.plans.catalog import CATALOG
    from threadloom.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    keys = [k for k in CATALOG if not argv or any(a == k or (a.endswith("*") and k.startswith(a[:-1])) for a in argv)]
    spark = build_session("compare", "8")
    con = connect(sf_dir)
    failed = 0
    for key in keys:
        start = time.time()
        try:
            problem = check(con, spark, CATALOG[key], sf_dir)
        except Exception as e:  # report every query, go on with the rest
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        failed += problem is not None
        kind = "sql" if CATALOG[key].sql else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} [{kind}] {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(keys) - failed}/{len(keys)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
