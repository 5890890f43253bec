"""Write PLANS.md: the physical plan shape of every registered query.

Usage: python tools/explain_all.py [sf_dir] > PLANS.md
For each query: shuffles (Exchange), join strategies, aggregate and window
operators, pushed filters and read columns of each scan; the full plan tree
for the headline operators. Plans are the initial AQE plans (before runtime
re-optimisation) of a session built by ``tickvault.session``.
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickvault.catalog import QUERIES  # noqa: E402
from tickvault.session import local_session  # noqa: E402

FULL = ["keep_last", "gaps_all", "apply_backfill_windows", "attempts_resolved"]
NODES = [
    "Exchange hashpartitioning", "Exchange SinglePartition", "Exchange rangepartitioning", "BroadcastExchange",
    "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
    "HashAggregate", "SortAggregate", "ObjectHashAggregate", "WindowGroupLimit", "Window", "Generate", "Sort",
]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(shuffle_partitions=16)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `python tools/explain_all.py {sf}` (initial adaptive plans, session of `tickvault.session`).\n")
    print("| query | shuffles | joins | aggregates / windows | scans: pushed filters / columns read |")
    print("|---|---|---|---|---|")
    full = {}
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        c = collections.Counter()
        for node in NODES:
            c[node] = len(re.findall(r"(?<![A-Za-z])" + re.escape(node) + r"(?![A-Za-z])", plan))
        shuffles = c["Exchange hashpartitioning"] + c["Exchange rangepartitioning"] + c["Exchange SinglePartition"]
        joins = ", ".join(f"{k} {c[k]}" for k in ["SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct"] if c[k])
        aggs = ", ".join(f"{k} {c[k]}" for k in ["HashAggregate", "SortAggregate", "ObjectHashAggregate", "WindowGroupLimit", "Window", "Generate"] if c[k])
        scans = []
        for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", plan):
            cols = [x for x in m.group(1).split(",") if x]
            pf = m.group(2).strip() or "-"
            scans.append(f"{len(cols)} cols, {pf[:60]}")
        print(f"| {name} | {shuffles} | {joins or '-'} | {aggs or '-'} | {'; '.join(sorted(set(scans)))} |")
        if name in FULL:
            full[name] = plan
    for name, plan in full.items():
        print(f"\n## {name}\n\n```")
        for line in plan.splitlines():
            print(line[:160])
        print("```")


if __name__ == "__main__":
    main()
