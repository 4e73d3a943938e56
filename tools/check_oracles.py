"""Run every query that has an SQL twin and report the differences.

    python tools/check_oracles.py [sf_dir] [query ...]
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quotemill.catalog import QUERIES  # noqa: E402
from quotemill.oracles import ORACLES  # noqa: E402
from quotemill.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in chosen:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name not in ORACLES:
                print(f"{name:28s} rows only {df.count():>8}  {time.time() - start:5.1f}s", flush=True)
                continue
            n, m, extra, missing = compare(df, con, ORACLES[name])
        except Exception as problem:  # report and go on with the next query
            print(f"{name:28s} FAILED {str(problem)[:1500]}", flush=True)
            continue
        verdict = "ok" if not extra and not missing else f"DIFFERS {len(extra)} {len(missing)}"
        print(f"{name:28s} {verdict} {n:>8} {m:>8}  {time.time() - start:5.1f}s", flush=True)
        for label, some in (("spark", sorted(extra, key=str)[:3]), ("duckdb", sorted(missing, key=str)[:3])):
            for row in some:
                print("   ", label, row)


if __name__ == "__main__":
    main()
