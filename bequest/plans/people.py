"""Users: lookup, roles, visibility and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bequest.functions.records import main_role, role_array
from bequest.operators.joins import attach, rows_per, with_flag


def user_lookup(users: DataFrame, emails: DataFrame) -> DataFrame:
    wanted = emails.where(F.col("email").isNotNull()).select("email")
    return users.select("user_id", "full_name", "email").join(wanted, "email", "left_semi")


def _role_flags(
    users: DataFrame, wills: DataFrame, executors: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    base = users.select("user_id", "email", "initial_role")
    base = with_flag(base, wills, ["user_id"], "owns")
    base = with_flag(base, executors.where(F.col("email").isNotNull()), ["email"], "executes")
    return with_flag(
        base, beneficiaries.where(F.col("email").isNotNull()), ["email"], "inherits"
    )


def primary_role(
    users: DataFrame, wills: DataFrame, executors: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    role = main_role(F.col("initial_role"), F.col("owns"), F.col("executes"), F.col("inherits"))
    flags = _role_flags(users, wills, executors, beneficiaries)
    return flags.select("user_id", role.alias("role"))


def all_roles(
    users: DataFrame, wills: DataFrame, executors: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    roles = role_array(
        F.col("initial_role"), F.col("owns"), F.col("executes"), F.col("inherits")
    )
    flags = _role_flags(users, wills, executors, beneficiaries)
    return flags.select("user_id", roles.alias("roles"))


def will_visibility(users: DataFrame, wills: DataFrame, executors: DataFrame) -> DataFrame:
    """Who may see which will.

    An administrator sees every will: that is one row with an empty `will_id`, not one row
    per will.
    """
    admins = users.where(F.col("initial_role") == "admin").select(
        "user_id", F.lit("every will").alias("scope"), F.lit(None).cast("long").alias("will_id")
    )
    owners = wills.select("user_id", "will_id").join(
        users.select("user_id"), "user_id", "left_semi"
    )
    named = (
        executors.where(F.col("email").isNotNull())
        .select("email", "will_id")
        .join(users.select("user_id", "email"), "email")
        .select("user_id", "will_id")
    )
    single = (
        owners.unionByName(named)
        .distinct()
        .select("user_id", F.lit("one will").alias("scope"), "will_id")
    )
    return admins.unionByName(single)


def may_view(asked: DataFrame, visibility: DataFrame) -> DataFrame:
    """Add `allowed` to (user_id, will_id) rows."""
    every = visibility.where(F.col("scope") == "every will")
    one = visibility.where(F.col("scope") == "one will")
    flagged = with_flag(asked, every, ["user_id"], "__every")
    flagged = with_flag(flagged, one, ["user_id", "will_id"], "__one")
    return flagged.withColumn("allowed", F.col("__every") | F.col("__one")).drop(
        "__every", "__one"
    )


def user_activity(
    users: DataFrame, wills: DataFrame, executors: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    owned = rows_per(wills, "user_id", name="wills_count")
    named = rows_per(executors, "email", name="executor_count")
    inherits = rows_per(beneficiaries, "email", name="beneficiary_count")
    joined = users.join(owned, "user_id", "left")
    for counted in (named, inherits):
        joined = attach(joined, counted, ["email"])
    zero = F.lit(0).cast("long")
    return joined.select(
        "user_id",
        "full_name",
        "email",
        "initial_role",
        "created_at",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("wills_count", "executor_count", "beneficiary_count")
        ],
    )


def role_counts(users: DataFrame) -> DataFrame:
    role = F.col("initial_role")
    return users.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(role == "testator").alias("testators"),
        F.count_if(role == "executor").alias("executors"),
        F.count_if(role == "beneficiary").alias("beneficiaries"),
    )
