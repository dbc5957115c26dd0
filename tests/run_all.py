"""Run queries and compare them with their SQL: python tests/run_all.py [names] (SF_DIR)."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tests.compare import duck, rows_of_duck, rows_of_spark, difference
from tests.session import spark_session


def main() -> None:
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = spark_session()
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    con = duck(folder)
    bad = []
    for name in names:
        start = time.time()
        try:
            got = rows_of_spark(queries[name](spark, folder))
        except Exception as error:
            bad.append(name)
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
            continue
        spent = time.time() - start
        if name not in oracle:
            print(f"rows  {name}: {len(got[1])} rows {spent:.2f}s", flush=True)
            continue
        start = time.time()
        try:
            want = rows_of_duck(con, oracle[name])
        except Exception as error:
            bad.append(name)
            print(f"SQL   {name}: {str(error)[:1500]}", flush=True)
            continue
        why = difference(got, want)
        if why:
            bad.append(name)
        print(f"{'DIFF ' if why else 'ok   '} {name}: {len(got[1])} rows {spent:.2f}s, sql {time.time() - start:.2f}s {why}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
