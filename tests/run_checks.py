"""Compare registered queries with their SQL: python tests/run_checks.py SF_DIR [name prefix...]."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from gridloom import build_session  # noqa: E402

if __name__ == "__main__":
    sf, only = sys.argv[1], sys.argv[2:]
    spark = build_session("checks", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            sql = entry.oracle_sql().get(name)
            msg = compare(df, con, sql) if sql else f"rows only: {df.count()}"
            bad += bool(sql and msg)
        except Exception as exc:
            bad += 1
            msg = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{name:28s} {time.time() - t:6.2f}s {msg or 'ok'}", flush=True)
    print("failed:", bad)
