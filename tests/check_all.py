"""Compare every registered query with its oracle: python tests/check_all.py SF_DIR [name ...]"""

import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from oracle import connect, difference  # noqa: E402
from tallybook.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from tallybook.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                verdict = difference(df, con, ORACLES[name])
            else:
                verdict = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += verdict is not None
        spark.catalog.clearCache()
        print(f"{name:24s} {time.time() - t:6.1f}s {'ok' if verdict is None else verdict}",
              flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    sys.exit(bool(bad))
