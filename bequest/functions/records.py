"""Role lists, next actions and JSON text of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def role_array(initial: Column, owns: Column, executes: Column, inherits: Column) -> Column:
    """All roles of a user: derived ones first, else the registered one, else `user`."""
    derived = F.array_compact(
        F.array(
            F.when(initial == "admin", "admin"),
            F.when(owns, "testator"),
            F.when(executes, "executor"),
            F.when(inherits, "beneficiary"),
        )
    )
    fallback = F.array(F.coalesce(initial, F.lit("user")))
    return F.when(F.size(derived) > 0, derived).otherwise(fallback)


def main_role(initial: Column, owns: Column, executes: Column, inherits: Column) -> Column:
    return (
        F.when(initial == "admin", "admin")
        .when(owns, "testator")
        .when(executes, "executor")
        .when(inherits, "beneficiary")
        .otherwise(F.coalesce(initial, F.lit("user")))
    )


def has_any_role(roles: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(roles, F.array(*[F.lit(w) for w in wanted]))


def next_action(transfer_status: Column, will_status: Column) -> Column:
    return (
        F.when(transfer_status == "Completed", "Transfer Completed")
        .when(transfer_status == "Initiated", "Transfer in Progress")
        .when(will_status == "Executed", "Awaiting Transfer")
        .otherwise("Will Not Yet Executed")
    )


def json_text(**fields: Column) -> Column:
    """JSON object text; names keep their order, NULL fields are kept, text is escaped."""
    packed = F.struct(*[c.alias(name) for name, c in fields.items()])
    return F.to_json(packed, {"ignoreNullFields": "false"})


def display_value(c: Column) -> Column:
    """Audit value for display: JSON objects normalised, anything else as it stands."""
    parsed = F.when(c.startswith("{"), F.to_json(F.try_parse_json(c)))
    missing = c.isNull() | (F.trim(c) == "") | (c == "None")
    return F.when(missing, "No data").otherwise(F.coalesce(parsed, c))


def json_field(c: Column, name: str) -> Column:
    """One field of JSON object text; NULL for plain text or broken JSON."""
    return F.when(c.startswith("{"), F.try_variant_get(F.try_parse_json(c), f"$.{name}", "string"))
