"""Run registered queries against DuckDB: python tests/check_queries.py [sf] [name-fragment ...]."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from compare import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from panelspark.session import build_session  # noqa: E402


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("check", 8)
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                diff = differences(df, con, oracles[name])
                note = "ok" if not diff else "DIFF\n    " + "\n    ".join(diff)
                note += f" rows={len(df.collect())}" if wanted and not diff else ""
            else:
                n = df.count()
                diff = [] if n else ["no rows"]
                note = f"rows={n} (no oracle)"
        except Exception as exc:  # noqa: BLE001
            diff, note = [exc], f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(diff)
        print(f"{name:40s} {time.time() - t:6.1f}s {note}", flush=True)
    print(f"{bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
