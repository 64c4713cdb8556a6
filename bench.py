"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from bequest.catalog.queries import CATALOG  # noqa: E402
from bequest.session import local_session  # noqa: E402

HEADLINE = (
    "q04_testator_dashboard",
    "q05_executor_dashboard",
    "q08_will_list",
    "q11_will_visibility",
    "q12_asset_allocation",
    "q17_beneficiary_inheritance",
    "q18_transfer_report",
    "q21_beneficiary_portfolio",
    "q22_will_summary_as_written",
    "q24_will_beneficiary_summary",
    "q25_system_totals",
    "q27_recent_activity",
    "q28_audit_page",
    "r03_assignments",
    "r04_allocation_approve",
    "r05_approvals",
    "r06_transfers",
    "r07_business_day",
    "m01_approve_audit",
    "m02_assign_added",
    "m03_transfer_added",
    "m06_delete_deleted_counts",
    "m09_history_history",
    "t02_activity_per_day",
    "t03_machine_history",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bequest-bench")
    # One untimed query loads classes and file listings.
    CATALOG["q23_will_asset_allocations"](spark, folder).write.format("noop").mode(
        "overwrite"
    ).save()
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        start = time.perf_counter()
        CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
