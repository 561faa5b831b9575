"""Run every registered query against its oracle: python tests/check_all.py SF_DIR [name-prefix]"""
import sys
import time

sys.path.insert(0, ".")
from pkgscope.session import local_session  # noqa: E402
from tests.oracle import compare, duck  # noqa: E402
import __spark_entry__ as E  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
prefix = sys.argv[2] if len(sys.argv) > 2 else ""
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf)
qs, os_ = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if not name.startswith(prefix):
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in os_:
            r = compare(df, con, os_[name])
            ok = r["cols"] and r["rows"] and r["hash"]
            print(f"{'OK ' if ok else 'BAD'} {name} {time.time()-t:.1f}s rows={r['spark_rows']}/{r['duck_rows']}"
                  + ("" if ok else f" cols={r['spark_cols']} vs {r['duck_cols']} diff={r['diff']}"))
            bad += not ok
        else:
            n = df.count()
            print(f"RWS {name} {time.time()-t:.1f}s rows={n}")
    except Exception as e:  # noqa: BLE001
        bad += 1
        print(f"ERR {name}: {str(e)[:600]}")
print("bad", bad)
