"""Summarise the physical plans of the headline queries into PLANS.md.

For each query: shuffles (Exchange), broadcasts, generators, whole-stage
codegen stages, Python evaluation nodes, and every Parquet scan with its
ReadSchema and PushedFilters. Plans are AQE's initial plans at the given
scale (runtime re-planning may coalesce partitions or turn a small side into
a broadcast). Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import bench  # noqa: E402
from benchcohort.plans import QUERIES  # noqa: E402
from benchcohort.session import build_session  # noqa: E402


def summarise(plan: str) -> dict:
    ops = re.findall(r"^\((\d+)\) (\w+)", plan, flags=re.M)
    names = [o for _, o in ops]
    scans = []
    for block in re.split(r"\n(?=\(\d+\) )", plan):
        if block.startswith("(") and " Scan parquet" in block.splitlines()[0]:
            loc = re.search(r"Location: \w+ \[(.*?)\]", block)
            schema = re.search(r"ReadSchema: (.*)", block)
            pushed = re.search(r"PushedFilters: (.*)", block)
            scans.append((os.path.basename(loc.group(1)) if loc else "?", schema.group(1) if schema else "",
                          pushed.group(1) if pushed else ""))
    return {
        "exchanges": sum(1 for n in names if n == "Exchange"),
        "broadcasts": sum(1 for n in names if n == "BroadcastExchange"),
        "generates": sum(1 for n in names if n == "Generate"),
        "codegen": len(re.findall(r"WholeStageCodegen", plan)),
        "python": sum(1 for n in names if "Python" in n or "ArrowEval" in n),
        "joins": sorted({n for n in names if n.endswith("Join")}),
        "scans": scans,
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16, extra={"spark.driver.memory": "8g"})
    print(f"# Physical plans of the headline queries ({os.path.basename(sf)})\n")
    print("Generated by `tools/plan_report.py` from `explain('formatted')` (AQE initial plans; checkpointed")
    print("inputs appear as scans of the checkpoint, not of the source tables).\n")
    print("| query | shuffles | broadcasts | joins | generate | python nodes |")
    print("|---|---|---|---|---|---|")
    details = []
    for name in bench.HEADLINE:
        df = QUERIES[name](spark, sf)
        buf = io.StringIO()
        with redirect_stdout(buf):
            df.explain("formatted")
        s = summarise(buf.getvalue())
        print(f"| `{name}` | {s['exchanges']} | {s['broadcasts']} | {', '.join(s['joins']) or '–'} | "
              f"{s['generates']} | {s['python']} |")
        details.append((name, s))
    print("\n## Scans (column pruning and pushed filters)\n")
    for name, s in details:
        if not s["scans"]:
            continue
        print(f"**{name}**\n")
        for loc, schema, pushed in s["scans"]:
            print(f"* `{loc}` — ReadSchema `{schema}`" + (f"; PushedFilters `{pushed}`" if pushed else ""))
        print()
    spark.stop()


if __name__ == "__main__":
    main()
