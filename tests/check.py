"""Command-line check: python tests/check.py [sf dir] [name ...]."""

import sys
import time

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

import __spark_entry__ as entry  # noqa: E402
from oracle_harness import compare, connect  # noqa: E402
from tallyloom.session import local_session  # noqa: E402

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = local_session("check", 8)
con = connect(folder)
sqls = entry.oracle_sql()
bad = 0
for name, fn in entry.queries().items():
    if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
        continue
    start = time.time()
    try:
        if name in sqls:
            n, faults = compare(spark, name, fn, sqls[name], folder, con)
        else:
            df = fn(spark, folder)
            n, faults = len(df.collect()), []
    except Exception as error:  # noqa: BLE001
        n, faults = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
    bad += bool(faults)
    kind = "S" if name in sqls else "R"
    print(f"{'FAIL' if faults else 'ok  '} {kind} {name:28s} {n:8d} rows {time.time() - start:6.2f}s", *faults, sep="  ", flush=True)
print("failed:", bad)
