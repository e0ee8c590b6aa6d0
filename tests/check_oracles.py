"""Compare registered queries with DuckDB on a data folder: check_oracles.py DIR [name prefix...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from boxlake.session import build_session  # noqa: E402
from tests.duck import ORACLES, QUERIES, connect, duck_rows, spark_rows  # noqa: E402


def main() -> int:
    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:]) or ("",)
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), []
    for name in sorted(n for n in QUERIES if n.startswith(prefixes)):
        start = time.perf_counter()
        try:
            got = spark_rows(spark, sf_dir, name)
            took = time.perf_counter() - start
            if name not in ORACLES:
                print(f"rows {name} {len(got[1])} {took:.1f}s", flush=True)
                continue
            want = duck_rows(con, name)
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL {name} {str(e)[:300]}", flush=True)
            continue
        if got != want:
            bad.append(name)
        print(f"{'ok' if got == want else 'DIFF'} {name} {len(got[1])} {took:.1f}s", flush=True)
    print("bad:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
