"""Compare registered queries with their SQL: ``python -m tests.run_queries FOLDER [NAME ...]``."""

from __future__ import annotations

import sys
import time
import traceback

import __spark_entry__ as entry
from fathom.session import local_session

from .compare import connect, difference


def main(folder: str, wanted: list[str]) -> int:
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            plan = df._jdf.queryExecution().executedPlan().toString()
            pairs = [j for j in ("CartesianProduct", "BroadcastNestedLoopJoin") if j in plan]
            if name in checks:
                problem = difference(df, con, checks[name])
                state = problem or "same rows"
            else:
                problem, state = None, f"{df.count()} rows, no SQL"
            if pairs:
                problem = state = f"{state}; plan has {pairs}"
        except Exception as error:
            problem = state = f"{type(error).__name__}: {str(error)[:600]}"
            if len(wanted) == 1:
                traceback.print_exc()
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.1f}s {name}: {state}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
