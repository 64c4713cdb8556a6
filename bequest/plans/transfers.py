"""Transfer reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bequest.functions.money import share_value, zero_if_null
from bequest.operators.joins import attach


REPORT_COLUMNS = (
    "transfer_id",
    "asset_name",
    "beneficiary_name",
    "transfer_date",
    "transfer_status",
    "approved_by",
    "value",
    "share_percent",
    "transfer_value",
)


def _described(
    transfers: DataFrame, assets: DataFrame, beneficiaries: DataFrame, shares: DataFrame
) -> DataFrame:
    percent = shares.select("asset_id", "beneficiary_id", "share_percent")
    named = assets.select("asset_id", F.col("name").alias("asset_name"), "value")
    heirs = beneficiaries.select("beneficiary_id", F.col("full_name").alias("beneficiary_name"))
    worth = share_value(F.col("value"), F.col("share_percent"))
    return (
        transfers.join(percent, ["asset_id", "beneficiary_id"], "left")
        .join(named, "asset_id")
        .join(heirs, "beneficiary_id")
        .withColumn("transfer_value", worth)
    )


def transfer_report(
    transfers: DataFrame, assets: DataFrame, beneficiaries: DataFrame, shares: DataFrame
) -> DataFrame:
    return _described(transfers, assets, beneficiaries, shares).select(*REPORT_COLUMNS)


def transfer_report_scoped(
    transfers: DataFrame,
    assets: DataFrame,
    beneficiaries: DataFrame,
    shares: DataFrame,
    wills: DataFrame,
    executors: DataFrame,
    user_id: Column,
    email: Column,
) -> DataFrame:
    """The report as one signed-in user sees it: wills they own or execute."""
    owned = wills.where(F.col("user_id") == user_id).select("will_id")
    named = (
        executors.where(F.col("email") == email)
        .select("will_id")
        .join(wills.select("will_id"), "will_id", "left_semi")
    )
    seen = assets.join(owned.unionByName(named), "will_id", "left_semi")
    return transfer_report(transfers, seen, beneficiaries, shares).distinct()


def transfer_totals(report: DataFrame, *by: str) -> DataFrame:
    status = F.col("transfer_status")
    return report.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "Initiated").alias("pending"),
        F.count_if(status == "Completed").alias("completed"),
        zero_if_null(F.sum("transfer_value")).alias("total_value"),
    )


def viewer_transfer_totals(
    transfers: DataFrame,
    assets: DataFrame,
    beneficiaries: DataFrame,
    shares: DataFrame,
    wills: DataFrame,
    visibility: DataFrame,
) -> DataFrame:
    """Totals of the scoped report for every user at once.

    Transfers are totalled per will before the viewers are joined, so no transfer is repeated
    for each of its viewers.
    """
    of_will = assets.join(wills.select("will_id"), "will_id", "left_semi")
    names = of_will.select("asset_id", "will_id")
    described = _described(transfers, of_will, beneficiaries, shares)
    per_asset = transfer_totals(described, "asset_id")
    per_will = (
        per_asset.join(names, "asset_id")
        .groupBy("will_id")
        .agg(*[F.sum(c).alias(c) for c in ("total", "pending", "completed", "total_value")])
    )
    viewers = visibility.where(F.col("scope") == "one will").select("user_id", "will_id")
    return (
        attach(viewers, per_will, ["will_id"], "inner")
        .groupBy("user_id")
        .agg(*[F.sum(c).alias(c) for c in ("total", "pending", "completed", "total_value")])
    )
