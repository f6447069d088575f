"""Run registered queries against their SQL: python tests/check.py [sf] [name ...]"""

import sys
import time

sys.path.insert(0, "/root/repo")

from oracle import compare, connect  # noqa: E402

from tableworks import plans  # noqa: E402
from tableworks.session import build_session  # noqa: E402


def main() -> int:
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(plans.QUERIES)
    spark, con, bad = build_session(cores=8), connect(sf), 0
    for name in names:
        start = time.time()
        try:
            df = plans.QUERIES[name](spark, sf)
            if name in plans.ORACLES:
                problems = compare(df, con, plans.ORACLES[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        kind = "sql " if name in plans.ORACLES else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {name} {time.time() - start:.1f}s", *problems, sep="\n    " if problems else " ")
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
