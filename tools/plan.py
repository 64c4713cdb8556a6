"""Print the physical plan of a catalog query: python tools/plan.py name [folder] [final]."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bequest.catalog.queries import CATALOG  # noqa: E402
from bequest.session import local_session  # noqa: E402

if __name__ == "__main__":
    name = sys.argv[1]
    folder = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session(8)
    # Plans as for large inputs: nothing is small enough to broadcast by size.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    df = CATALOG[name](spark, folder)
    if "final" in sys.argv:
        df.collect()
    df.explain("simple" if "simple" in sys.argv else "formatted")
