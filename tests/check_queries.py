"""Compare all queries with their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import __spark_entry__ as entry  # noqa: E402
from shortlist.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session(8)
con = connect(sf_dir)
bad = 0
sqls = entry.oracle_sql()
for name, fn in entry.queries().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        df = fn(spark, sf_dir)
        note = compare(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
    except Exception as error:  # noqa: BLE001
        note = f"{type(error).__name__}: {str(error)[:700]}"
    bad += bool(note) and name in sqls
    print(f"{'ok  ' if not note else '--  '}{name:28s}{time.time() - start:6.2f}s {note or ''}", flush=True)
print("differing:", bad)
