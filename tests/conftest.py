from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from bequest.session import local_session  # noqa: E402
from bequest.sources.tables import literal_rows  # noqa: E402

NOW = "2025-06-11 10:30:00"  # a Wednesday


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "bequest-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def estate(spark):
    """A small estate with one case for every rule.

    Will 1: draft, asset 12 allocated to 80 %.  Will 2: approved, fully allocated.  Will 3:
    executed.  Will 4: draft without assets.  Will 5: draft without executor.  Will 6: draft
    without a primary executor.  Will 7: approved, asset 71 allocated to 95 %.  Will 8: draft
    with two primary executors.
    """
    day = datetime(2025, 6, 1)

    def will(key, user, status):
        return (key, user, f"Will {key}", None, status, day, day)

    rows = {
        "users": [
            (1, "Ada Admin", "ada@office.rw", "0788000001", date(1970, 1, 1), "Main Road 1", "admin", day),
            (2, "Ben Owner", "ben@home.rw", "+250 788 000 002", date(1980, 2, 29), "Hill Road 22", None, day),
            (3, "Cleo Owner", "cleo@home.rw", "0788000003", date(1990, 6, 11), "Lake Road 33", "testator", day),
            (4, "Dan Clerk", "dan@law.rw", "0788000004", date(2007, 6, 12), "Law Street 44", "executor", day),
            (5, "Eva Heir", "eva@home.rw", "12", date(2007, 6, 11), "Short", "beneficiary", day),
            (6, "Fay None", None, None, None, None, None, day),
        ],
        "wills": [
            will(1, 2, "Draft"),
            will(2, 3, "Approved"),
            will(3, 3, "Executed"),
            will(4, 2, "Draft"),
            will(5, 2, "Draft"),
            will(6, 2, "Draft"),
            will(7, 3, "Approved"),
            will(8, 2, "Draft"),
        ],
        "assets": [
            (11, 1, "House", "Real Estate", Decimal("1000.00")),
            (12, 1, "Car", "Vehicle", Decimal("500.00")),
            (21, 2, "Shop", "Business", Decimal("2000.50")),
            (22, 2, "Boat", "Vehicle", None),
            (31, 3, "Clinic", "Real Estate", Decimal("9000.00")),
            (71, 7, "Farm", "Real Estate", Decimal("700.00")),
            (81, 8, "Barn", "Other", Decimal("80.00")),
        ],
        "beneficiaries": [
            (1, "Eva Heir", "Child", "eva@home.rw"),
            (2, "Finn Heir", "Child", None),
            (3, "Gus Heir", "Friend", "gus@home.rw"),
        ],
        "executors": [
            (101, 1, "Dan Clerk", "dan@law.rw", "Y"),
            (102, 1, "Gus Heir", "gus@home.rw", "N"),
            (103, 2, "Dan Clerk", "dan@law.rw", "Y"),
            (104, 3, "Dan Clerk", "dan@law.rw", "Y"),
            (105, 4, "Dan Clerk", "dan@law.rw", "Y"),
            (106, 6, "Gus Heir", "gus@home.rw", None),
            (107, 7, "Dan Clerk", "dan@law.rw", "Y"),
            (108, 8, "Dan Clerk", "dan@law.rw", "Y"),
            (109, 8, "Gus Heir", "gus@home.rw", "Y"),
            (110, 8, "Eva Heir", "eva@home.rw", None),
        ],
        "shares": [
            (1, 11, 1, Decimal("60.00")),
            (2, 11, 2, Decimal("40.00")),
            (3, 12, 1, Decimal("80.00")),
            (4, 21, 1, Decimal("50.00")),
            (5, 21, 2, Decimal("50.00")),
            (6, 22, 3, Decimal("100.00")),
            (7, 31, 1, Decimal("100.00")),
            (8, 71, 1, Decimal("95.00")),
            (9, 81, 2, Decimal("90.00")),
        ],
        "transfers": [
            (1, 31, 1, datetime(2025, 6, 2), "dan@law.rw", "Completed"),
            (2, 21, 2, datetime(2025, 6, 10), "dan@law.rw", "Completed"),
            (3, 21, 1, datetime(2025, 6, 10), "dan@law.rw", "Initiated"),
        ],
        "documents": [
            (1, "WILL", 1, "Scan", "PDF"),
            (2, "ASSET", 11, "Deed", "PDF"),
            (3, "ASSET", 21, "Deed", "PDF"),
        ],
        "holidays": [
            (date(2020, 7, 1), "Independence Day", "Y"),
            (date(2025, 6, 12), "Bridge Day", "N"),
            (date(2019, 6, 12), "Another Day", "Y"),
        ],
        "history": [
            (1, None, "Draft", "x", day, None),
            (2, "Draft", "Approved", "x", day, None),
        ],
    }
    return {name: literal_rows(spark, data, name).cache() for name, data in rows.items()}


def codes(df, key: str) -> dict:
    return {r[key]: r["reject_code"] for r in df.collect()}


def pairs(df, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
