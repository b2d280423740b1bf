"""Run queries against their SQL twins: check.py [sf dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from tests.compare import connect, difference  # noqa: E402
from tidemeter.catalog import load  # noqa: E402
from tidemeter.session import build_session  # noqa: E402

root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:]
spark = build_session("check")
spark.sparkContext.setLogLevel("ERROR")
con = connect(root)
bad = 0
for name, q in load().items():
    if only and name not in only:
        continue
    began = time.time()
    try:
        if q.sql is None:
            rows = q(spark, root).count()
            msg = None if rows else "no rows"
        else:
            msg = difference(q(spark, root), con, q.sql)
    except Exception as error:  # noqa: BLE001
        msg = f"{type(error).__name__}: {str(error)[:600]}"
    bad += msg is not None
    print(f"{'ok  ' if msg is None else 'FAIL'} {time.time() - began:6.2f}s {name}" + (f"  {msg}" if msg else ""), flush=True)
print("failures:", bad)
spark.stop()
