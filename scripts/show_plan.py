"""Print the physical plan of a registered query.

Usage: python scripts/show_plan.py <query> [sf_dir] [mode]

``mode`` is an ``explain`` mode (default ``formatted``).  With ``final``
the query is executed first and the adaptive plan it settled on is printed
(AQE decisions: coalesced partitions, broadcast conversions, skew splits);
``outline`` prints that plan with operator names only.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from doeffect.plans.registry import QUERIES  # noqa: E402
from doeffect.session import local_session  # noqa: E402


def outline(plan: str) -> str:
    """Operator names only, one per line, keeping the tree indentation.

    The plans of cached side tables are folded into their InMemoryRelation.
    """
    out, skip = [], None
    for line in plan.splitlines():
        stripped = line.lstrip(" :+-|")
        if not stripped or stripped.startswith(("==", "Output", "Arguments")):
            continue
        indent = line[: len(line) - len(stripped)]
        if skip is not None and len(indent) > skip:
            continue
        skip = len(indent) if stripped.startswith("InMemoryRelation") else None
        name = stripped.split(" [", 1)[0].split("(keys=", 1)[0].split(" (", 1)[0]
        if name.startswith("Exchange"):
            name = stripped.split(", ENSURE", 1)[0].split(", REPARTITION", 1)[0]
            name = name.split("(", 1)[0] + ("" if "(" not in name else "(" + name.split("(", 1)[1])
        out.append(indent + name[:120])
    return "\n".join(out)


def main() -> None:
    name = sys.argv[1] if len(sys.argv) > 1 else "contingency_grid"
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    mode = sys.argv[3] if len(sys.argv) > 3 else "formatted"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    df = QUERIES[name](spark, sf_dir)
    if mode in ("final", "outline"):
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(outline(plan) if mode == "outline" else plan)
    else:
        df.explain(mode)
    spark.stop()


if __name__ == "__main__":
    main()
