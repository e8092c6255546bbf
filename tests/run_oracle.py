"""python tests/run_oracle.py [pattern] [sf]: compare queries with their SQL on one folder."""

import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402
from partmill.session import session  # noqa: E402

if __name__ == "__main__":
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf = sys.argv[2] if len(sys.argv) > 2 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                          "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    good = 0
    names = [n for n in entry.queries() if re.search(pattern, n)]
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                ok, note, n = True, "rows only", df.count()
            else:
                ok, note, n = compare(df, con, sql)
        except Exception as exc:
            ok, note, n = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0
        good += ok
        print(f"{'PASS' if ok else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {note if not ok or note != 'ok' else ''}", flush=True)
    print(f"{good}/{len(names)}")
