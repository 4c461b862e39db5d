"""Compare every registered query with its SQL: python tests/oracle_check.py SF_DIR [names...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("T00:00:00", "")
    if isinstance(v, (int, float)) or hasattr(v, "__float__"):
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = [df[c].astype(object) for c in sorted(df.columns)]
    return sorted(tuple(_key(v) for v in row) for row in zip(*cols))


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if a == b:
        return ""
    sa, sb = set(a), set(b)
    return f"rows {len(a)}/{len(b)} only ours {len(sa - sb)} {sorted(sa - sb)[:2]} only theirs {len(sb - sa)} {sorted(sb - sa)[:2]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from panelspark.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con, failed = local_session(8), connection(sf), 0
    oracles = oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            ours = fn(spark, sf).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"NOSQL {name} {len(ours)} rows {t1 - t:.1f}s", flush=True)
                continue
            diff = differences(ours, con.execute(oracles[name]).fetchdf())
        except Exception as e:  # report and go on
            diff, t1, ours = f"{type(e).__name__}: {str(e)[:500]}", time.time(), []
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok'} {name} {len(ours)} rows {t1 - t:.1f}s sql {time.time() - t1:.1f}s {diff}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
