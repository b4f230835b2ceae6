"""Run queries against their SQL: ``python tests/check.py [name ...]``."""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

from sessionloom.session import build_session  # noqa: E402


def main():
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.connect()
    names = sys.argv[1:] or list(entry.queries())
    sql = entry.oracle_sql()
    for name in names:
        t0 = time.time()
        try:
            df = entry.queries()[name](spark, compare.SF)
            if name in sql:
                problem = compare.difference(df, con, sql[name])
                state = "ok" if problem is None else "DIFF " + problem
            else:
                state = f"rows {df.count()}"
        except Exception as e:
            state = "FAIL " + str(e)[:600]
        print(f"{time.time() - t0:6.2f}s {name}: {state}", flush=True)


main()
