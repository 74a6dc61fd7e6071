"""Print the physical plan tree of selected registered queries.

usage: python scripts/show_plans.py [sf_dir] name ...
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.plans.queries import QUERIES  # noqa: E402
from tillroll.session import local_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session(8, 16)
    for name in args:
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().treeString()
        print(f"### {name}\n```\n{plan}```\n")
    spark.stop()


if __name__ == "__main__":
    main()
