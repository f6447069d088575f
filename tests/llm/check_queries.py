"""Run this package's queries against their SQL: python tests/llm/check_queries.py [sf] [name ...]"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle import compare, connect  # noqa: E402

from tableworks.llm import queries  # noqa: E402
from tableworks.session import build_session  # noqa: E402


def main() -> int:
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark, con, bad = build_session(cores=8, spark__checkpoint__dir=os.environ.get("CHECKPOINTS", "/tmp/tw-checkpoints")), connect(sf), 0
    for name in sys.argv[2:] or list(queries.QUERIES):
        start = time.time()
        try:
            df = queries.QUERIES[name](spark, sf)
            problems = compare(df, con, queries.ORACLES[name]) if name in queries.ORACLES else ([] if df.count() else ["no rows"])
        except Exception as error:  # report and go on with the next query
            print("FAIL", name, str(error)[-1500:], flush=True)
            bad += 1
            continue
        print("FAIL" if problems else "ok", name, f"{time.time() - start:.1f}s", df.count(), *problems, flush=True)
        df.show(5)
        bad += bool(problems)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
