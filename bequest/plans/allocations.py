"""Shares of assets and what they are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bequest.functions.money import band, remaining, share_value, zero_if_null
from bequest.functions.records import next_action


def allocated(shares: DataFrame) -> DataFrame:
    return shares.groupBy("asset_id").agg(
        F.sum("share_percent").alias("allocated_percent"),
        F.count("beneficiary_id").alias("beneficiary_count"),
    )


def asset_allocation(assets: DataFrame, shares: DataFrame) -> DataFrame:
    return assets.join(allocated(shares), "asset_id", "left").select(
        "asset_id",
        "will_id",
        "name",
        "asset_type",
        "value",
        zero_if_null(F.col("allocated_percent")).alias("allocated_percent"),
    )


def remaining_percent(assets: DataFrame, shares: DataFrame) -> DataFrame:
    percent = zero_if_null(F.col("allocated_percent"))
    return (
        assets.select("asset_id")
        .join(allocated(shares), "asset_id", "left")
        .select(
            "asset_id",
            percent.alias("allocated_percent"),
            remaining(percent).alias("remaining_percent"),
        )
    )


def will_asset_allocations(assets: DataFrame, shares: DataFrame) -> DataFrame:
    percent = zero_if_null(F.col("allocated_percent"))
    return assets.join(allocated(shares), "asset_id", "left").select(
        "will_id",
        "asset_id",
        "name",
        "asset_type",
        "value",
        percent.alias("allocated_percent"),
        F.coalesce("beneficiary_count", F.lit(0)).alias("beneficiary_count"),
        band(percent).alias("band"),
    )


def allocation_bands(assets: DataFrame, shares: DataFrame) -> DataFrame:
    return (
        will_asset_allocations(assets, shares)
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("asset_count"))
    )


def _worth(name: str):
    return share_value(F.col("value"), F.col("share_percent")).alias(name)


def allocation_detail(
    assets: DataFrame, shares: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    return (
        shares.join(assets.select("asset_id", "will_id", "name", "value"), "asset_id")
        .join(beneficiaries.select("beneficiary_id", "full_name"), "beneficiary_id")
        .select(
            "will_id",
            F.col("name").alias("asset_name"),
            F.col("full_name").alias("beneficiary_name"),
            "share_percent",
            _worth("estimated_value"),
        )
    )


def current_allocations(
    assets: DataFrame, shares: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    """Allocations asset by asset, the largest share first."""
    return (
        shares.join(assets.select("asset_id", "value"), "asset_id")
        .join(beneficiaries.select("beneficiary_id", "full_name"), "beneficiary_id")
        .select("asset_id", "full_name", "share_percent", _worth("estimated_value"))
        .orderBy(
            "asset_id", F.desc_nulls_first("share_percent"), F.asc_nulls_last("full_name")
        )
    )


def allocation_listing(
    shares: DataFrame, assets: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    return (
        shares.join(assets.select("asset_id", "name"), "asset_id")
        .join(beneficiaries.select("beneficiary_id", "full_name"), "beneficiary_id")
        .select(
            F.col("name").alias("asset_name"),
            F.col("full_name").alias("beneficiary_name"),
            "share_percent",
        )
        .orderBy(
            F.asc_nulls_last("asset_name"),
            F.desc_nulls_first("share_percent"),
            F.asc_nulls_last("beneficiary_name"),
        )
    )


def beneficiary_inheritance(
    beneficiaries: DataFrame, shares: DataFrame, assets: DataFrame
) -> DataFrame:
    """Summed per beneficiary before the names are joined; beneficiaries without shares stay."""
    per_heir = (
        shares.join(assets.select("asset_id", "value"), "asset_id", "left")
        .groupBy("beneficiary_id")
        .agg(
            F.count("asset_id").alias("assigned_assets"),
            F.sum(share_value(F.col("value"), F.col("share_percent"))).alias("worth"),
        )
    )
    return beneficiaries.join(per_heir, "beneficiary_id", "left").select(
        "beneficiary_id",
        "full_name",
        "relation",
        "email",
        F.coalesce("assigned_assets", F.lit(0)).alias("assigned_assets"),
        zero_if_null(F.col("worth")).alias("total_inheritance"),
    )


def beneficiary_assets(shares: DataFrame, assets: DataFrame) -> DataFrame:
    return shares.join(
        assets.select("asset_id", "name", "asset_type", "value"), "asset_id"
    ).select(
        "beneficiary_id",
        "asset_id",
        "name",
        "asset_type",
        "value",
        "share_percent",
        _worth("inheritance_value"),
    )


def eligible_beneficiaries(
    assets: DataFrame, shares: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    """Assets with their beneficiaries: a row for each of both, as many as there are.

    An asset without beneficiaries has one row in which `beneficiary` is NULL.
    """
    entry = F.struct(
        "full_name", F.col("beneficiary_id").alias("id"), "relation", "share_percent"
    )
    heirs = shares.join(
        beneficiaries.select("beneficiary_id", "full_name", "relation"), "beneficiary_id"
    )
    listed = heirs.select("asset_id", entry.alias("beneficiary"))
    return assets.join(listed, "asset_id", "left").select(
        "asset_id",
        "name",
        F.coalesce("value", F.lit(0)).alias("value"),
        "asset_type",
        "beneficiary",
    )


def beneficiary_portfolio(
    shares: DataFrame,
    assets: DataFrame,
    beneficiaries: DataFrame,
    wills: DataFrame,
    transfers: DataFrame,
) -> DataFrame:
    moved = transfers.select("asset_id", "beneficiary_id", "transfer_id", "transfer_status")
    status = F.when(F.col("transfer_id").isNotNull(), F.col("transfer_status")).otherwise(
        "Not Transferred"
    )
    return (
        shares.select("asset_id", "beneficiary_id", "share_percent")
        .join(moved, ["asset_id", "beneficiary_id"], "left")
        .join(assets.select("asset_id", "will_id", "name", "asset_type", "value"), "asset_id")
        .join(
            wills.select(
                "will_id", F.col("title").alias("will_title"), F.col("status").alias("will_status")
            ),
            "will_id",
        )
        .join(beneficiaries.select("beneficiary_id", "email"), "beneficiary_id")
        .select(
            "email",
            "name",
            "asset_type",
            "value",
            "share_percent",
            _worth("my_share_value"),
            "will_title",
            "will_status",
            status.alias("transfer_status"),
            next_action(F.col("transfer_status"), F.col("will_status")).alias("next_action"),
        )
    )


def portfolio_totals(portfolio: DataFrame) -> DataFrame:
    return portfolio.groupBy("email").agg(
        F.count(F.lit(1)).alias("assets"),
        zero_if_null(F.sum("my_share_value")).alias("total_value"),
        F.count_if(F.col("transfer_status") == "Initiated").alias("initiated"),
        F.count_if(F.col("transfer_status") == "Completed").alias("completed"),
    )
