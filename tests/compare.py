"""Run chosen queries against their SQL: python tests/compare.py sf0.001 [name ...]"""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import __spark_entry__ as entry  # noqa: E402
from oracle import connect, difference  # noqa: E402

from rowforge.session import build_session  # noqa: E402


def main(sf: str, names: list[str]) -> int:
    folder = f"/root/testdata/{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            sql = entry.oracle_sql().get(name)
            problem = difference(df, con, sql) if sql else None
            note = "" if sql else f" (rows only: {df.count()})"
        except Exception as e:  # report and go on
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{note} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
