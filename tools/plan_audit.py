"""Physical-plan facts of every registered query: exchanges, joins, Python nodes, one-partition steps.

usage: python tools/plan_audit.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SKIP = ("asofkit.plans.models", "asofkit.plans.streams")


def facts(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return {
        "exchanges": len(re.findall(r"Exchange (?:hash|range|Single)", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "bnlj": plan.count("BroadcastNestedLoopJoin"),
        "cartesian": plan.count("CartesianProduct"),
        "python": len(re.findall(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups", plan)),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
    }


def main():
    from asofkit.registry import load_all
    from asofkit.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark = local_session()
    for n, q in load_all().items():
        if q.fn.__module__ in SKIP or (args and not any(a in n for a in args)):
            continue
        f = facts(q.fn(spark, sf))
        flag = " <--" if f["bnlj"] or f["cartesian"] or f["python"] or f["single"] else ""
        print(f"{n:36s} " + " ".join(f"{k}={v}" for k, v in f.items()) + flag, flush=True)


if __name__ == "__main__":
    main()
