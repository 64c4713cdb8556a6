"""Dashboards and system totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bequest.functions.dates import since
from bequest.functions.money import percent_of, share_value, zero_if_null
from bequest.functions.text import join_text
from bequest.model import RECENT_DAYS, RECENT_ROWS
from bequest.operators.joins import attach, rows_per


def testator_dashboard(
    users: DataFrame, wills: DataFrame, assets: DataFrame, shares: DataFrame
) -> DataFrame:
    owned = wills.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_wills"),
        F.count_if(F.col("status") == "Draft").alias("pending_wills"),
    )
    owner = wills.select("will_id", "user_id")
    per_will = assets.groupBy("will_id").agg(
        F.count(F.lit(1)).alias("assets"), F.sum("value").alias("value")
    )
    worth = (
        per_will.join(owner, "will_id")
        .groupBy("user_id")
        .agg(
            F.sum("assets").alias("total_assets"), F.sum("value").alias("total_assets_value")
        )
    )
    heirs = (
        shares.select("asset_id", "beneficiary_id")
        .join(assets.select("asset_id", "will_id"), "asset_id")
        .select("will_id", "beneficiary_id")
        .distinct()
        .join(owner, "will_id")
        .groupBy("user_id")
        .agg(F.count_distinct("beneficiary_id").alias("total_beneficiaries"))
    )
    joined = (
        users.select("user_id")
        .join(owned, "user_id", "left")
        .join(worth, "user_id", "left")
        .join(heirs, "user_id", "left")
    )
    zero = F.lit(0).cast("long")
    return joined.select(
        "user_id",
        F.coalesce("total_wills", zero).alias("total_wills"),
        F.coalesce("total_assets", zero).alias("total_assets"),
        zero_if_null(F.col("total_assets_value")).alias("total_assets_value"),
        F.coalesce("pending_wills", zero).alias("pending_wills"),
        F.coalesce("total_beneficiaries", zero).alias("total_beneficiaries"),
    )


def _transfers_per_will(assets: DataFrame, transfers: DataFrame) -> DataFrame:
    """Counted per asset and then per will, before any executor is joined."""
    status = F.col("transfer_status")
    per_asset = transfers.groupBy("asset_id").agg(
        F.count_if(status == "Initiated").alias("pending"),
        F.count_if(status == "Completed").alias("completed"),
    )
    return (
        per_asset.join(assets.select("asset_id", "will_id"), "asset_id")
        .groupBy("will_id")
        .agg(F.sum("pending").alias("pending"), F.sum("completed").alias("completed"))
    )


def executor_dashboard(
    executors: DataFrame, assets: DataFrame, transfers: DataFrame
) -> DataFrame:
    named = (
        executors.where(F.col("email").isNotNull())
        .groupBy("email", "will_id")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    zero = F.lit(0).cast("long")
    moved = attach(named, _transfers_per_will(assets, transfers), ["will_id"])
    return moved.groupBy("email").agg(
        F.sum("times").alias("assigned_wills"),
        F.sum(F.col("times") * F.coalesce("pending", zero)).alias("pending_transfers"),
        F.sum(F.col("times") * F.coalesce("completed", zero)).alias("completed_transfers"),
    )


def beneficiary_dashboard(
    beneficiaries: DataFrame, shares: DataFrame, assets: DataFrame
) -> DataFrame:
    """Per e-mail; summed per beneficiary before the e-mail is looked up."""
    per_heir = (
        shares.join(assets.select("asset_id", "value"), "asset_id")
        .groupBy("beneficiary_id")
        .agg(
            F.count(F.lit(1)).alias("assigned"),
            F.sum(share_value(F.col("value"), F.col("share_percent"))).alias("worth"),
        )
    )
    return (
        beneficiaries.where(F.col("email").isNotNull())
        .select("beneficiary_id", "email")
        .join(per_heir, "beneficiary_id", "left")
        .groupBy("email")
        .agg(
            F.coalesce(F.sum("assigned"), F.lit(0).cast("long")).alias("assigned_assets"),
            zero_if_null(F.sum("worth")).alias("total_value"),
        )
    )


def _side_by_side(*totals: DataFrame) -> DataFrame:
    """One row from several one-row aggregates."""
    first, *rest = totals
    return first.select("*", *[t.scalar().alias(t.columns[0]) for t in rest])


def _counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def admin_totals(
    users: DataFrame, wills: DataFrame, assets: DataFrame, transfers: DataFrame
) -> DataFrame:
    return _side_by_side(
        _counted(users, "total_users"),
        _counted(wills, "total_wills"),
        _counted(assets, "total_assets"),
        _counted(transfers, "total_transfers"),
    )


def system_totals(
    users: DataFrame,
    wills: DataFrame,
    assets: DataFrame,
    beneficiaries: DataFrame,
    executors: DataFrame,
    transfers: DataFrame,
) -> DataFrame:
    return _side_by_side(
        _counted(users, "total_users"),
        _counted(wills, "total_wills"),
        _counted(assets, "total_assets"),
        _counted(beneficiaries, "total_beneficiaries"),
        _counted(executors, "total_executors"),
        _counted(transfers, "total_transfers"),
        assets.agg(zero_if_null(F.sum("value")).alias("total_asset_value")),
    )


def will_status_distribution(wills: DataFrame) -> DataFrame:
    counted = rows_per(wills, "status", name="count")
    total = counted.agg(F.sum("count").alias("total"))
    return counted.select(
        "status", "count", percent_of(F.col("count"), total.scalar()).alias("percentage")
    )


def recent_activity(
    wills: DataFrame,
    transfers: DataFrame,
    assets: DataFrame,
    beneficiaries: DataFrame,
    as_of: Column,
    days: int = RECENT_DAYS,
    k: int = RECENT_ROWS,
) -> DataFrame:
    """The newest wills and transfers.

    At most k transfers can reach the result, so the newest k are picked before the names are
    looked up; only transfers that have both an asset and a beneficiary count.
    """
    created = wills.where(since(F.col("created_at"), as_of, days)).select(
        F.lit("Will Created").alias("activity"),
        F.col("title").alias("description"),
        F.col("created_at").alias("activity_date"),
        F.col("will_id").alias("tie"),
    )
    newest = (
        transfers.where(since(F.col("transfer_date"), as_of, days))
        .join(assets.select("asset_id"), "asset_id", "left_semi")
        .join(beneficiaries.select("beneficiary_id"), "beneficiary_id", "left_semi")
        .orderBy(F.desc("transfer_date"), F.desc("transfer_id"))
        .limit(k)
    )
    moved = (
        newest.join(assets.select("asset_id", "name"), "asset_id")
        .join(beneficiaries.select("beneficiary_id", "full_name"), "beneficiary_id")
        .select(
            F.lit("Transfer Initiated").alias("activity"),
            join_text(F.col("name"), F.lit(" to "), F.col("full_name")).alias("description"),
            F.col("transfer_date").alias("activity_date"),
            F.col("transfer_id").alias("tie"),
        )
    )
    return (
        created.unionByName(moved)
        .orderBy(F.desc("activity_date"), F.desc("activity"), F.desc("tie"))
        .limit(k)
        .drop("tie")
    )
