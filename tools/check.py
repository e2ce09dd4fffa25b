"""Run every query beside its DuckDB text.

    python tools/check.py [--sf 0.01] [--only word,word]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle import compare, connect  # noqa: E402

import millpond.queries  # noqa: E402, F401
from millpond.registry import QUERIES, runner  # noqa: E402
from millpond.session import build  # noqa: E402


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--only", default="")
    args.add_argument("--cpus", default="8")
    options = args.parse_args()
    folder = f"/root/testdata/sf{options.sf}"
    spark = build("check", f"local[{options.cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = [word for word in options.only.split(",") if word]
    bad = 0
    for name, query in QUERIES.items():
        if wanted and not any(word in name for word in wanted):
            continue
        started = time.time()
        try:
            df = runner(query)(spark, folder)
            n, problems = (df.count(), []) if query.sql is None else compare(df, con, query.sql)
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the rest
            n, problems = 0, [str(error)[:1500]]
        bad += bool(problems)
        word = "FAIL" if problems else "ok  " if query.sql else "rows"
        print(f"{word}  {name}: {n} rows {time.time() - started:.2f}s{'' if n else ' EMPTY'}", flush=True)
        for problem in problems:
            print("   ", problem, flush=True)
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
