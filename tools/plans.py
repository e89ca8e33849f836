"""Print the final adaptive plan of queries with counts of exchanges, sorts and windows.

usage: python tools/plans.py SF_DIR query [...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.plans.catalog import QUERIES
from barloom.session import local_session


def final_plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def main() -> None:
    brief = "--brief" in sys.argv
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    spark = local_session("8")
    for name in args[1:] or list(QUERIES):
        text = final_plan(QUERIES[name](spark, args[0]))
        counts = {k: len(re.findall(p, text)) for k, p in {
            "Exchange": r"(?<!Broadcast)(?<!Reused)Exchange (?:hash|range|Single|Round)", "Broadcast": r"BroadcastExchange ",
            "Reused": r"ReusedExchange", "Sort": r"\bSort \[", "Window": r"Window \[", "SMJ": r"SortMergeJoin",
            "BHJ": r"BroadcastHashJoin", "NLJ": r"NestedLoop", "Scan": r"FileScan", "SortAgg": r"SortAggregate"}.items()}
        print(name, {k: v for k, v in counts.items() if v})
        if not brief:
            for line in text.splitlines():
                print("  ", line[:170])


if __name__ == "__main__":
    main()
