"""Will lists, details and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bequest.functions.money import percent_of, rounded_mean, share_value, zero_if_null
from bequest.operators.joins import attach, matching, rows_per


def will_list(wills: DataFrame, assets: DataFrame, executors: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (
        wills.join(rows_per(assets, "will_id", name="asset_count"), "will_id", "left")
        .join(rows_per(executors, "will_id", name="executor_count"), "will_id", "left")
        .select(
            "will_id",
            "user_id",
            "title",
            "description",
            "status",
            "created_at",
            F.coalesce("asset_count", zero).alias("asset_count"),
            F.coalesce("executor_count", zero).alias("executor_count"),
        )
    )


def executor_will_list(wills: DataFrame, assets: DataFrame, executors: DataFrame) -> DataFrame:
    """Wills per executor e-mail; an executor named twice sees the will once."""
    named = executors.where(F.col("email").isNotNull()).select("email", "will_id").distinct()
    return attach(named, will_list(wills, assets, executors), ["will_id"], "inner")


def will_detail(wills: DataFrame, users: DataFrame) -> DataFrame:
    owner = users.select(
        "user_id", F.col("full_name").alias("owner_name"), F.col("email").alias("owner_email")
    )
    return wills.join(owner, "user_id")


def wills_with_testator(wills: DataFrame, users: DataFrame) -> DataFrame:
    owner = users.select("user_id", F.col("full_name").alias("testator_name"))
    return wills.join(owner, "user_id").select("will_id", "title", "status", "testator_name")


def executors_ranked(executors: DataFrame) -> DataFrame:
    """Executors of every will, primary first; a range sort splits even one huge will."""
    return executors.select("will_id", "executor_id", "full_name", "email", "is_primary").orderBy(
        F.asc_nulls_last("will_id"),
        F.desc_nulls_first("is_primary"),
        F.asc_nulls_last("full_name"),
        F.asc("executor_id"),
    )


def executor_counts(wills: DataFrame, executors: DataFrame) -> DataFrame:
    counted = executors.groupBy("will_id").agg(F.count("executor_id").alias("executor_count"))
    return wills.join(counted, "will_id", "left").select(
        "will_id", "title", F.coalesce("executor_count", F.lit(0)).alias("executor_count")
    )


def will_executors(wills: DataFrame, executors: DataFrame) -> DataFrame:
    named = executors.select("will_id", "executor_id", "full_name", "email", "is_primary")
    return wills.select("will_id", "title", "status").join(named, "will_id", "left")


def will_value(wills: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset count and value; the value stays NULL for a will without assets."""
    worth = assets.groupBy("will_id").agg(
        F.count("asset_id").alias("asset_count"), F.sum("value").alias("total_value")
    )
    return wills.join(worth, "will_id", "left").select(
        "will_id",
        "title",
        "status",
        F.coalesce("asset_count", F.lit(0)).alias("asset_count"),
        "total_value",
    )


def _will_facts(assets: DataFrame, shares: DataFrame) -> DataFrame:
    """Per will: assets and value, plain and repeated once per share row, percents and beneficiaries.

    The share rows of all assets are met once; an asset without shares is one row.  Beneficiaries are
    counted by grouping by will and beneficiary first, which splits a will with many.
    """
    plain = assets.groupBy("will_id").agg(F.count("asset_id").alias("assets"), F.sum("value").alias("worth"))
    held = assets.select("asset_id", "will_id", "value").join(
        shares.select("asset_id", "beneficiary_id", "share_percent"), "asset_id", "left"
    )
    per_heir = held.groupBy("will_id", "beneficiary_id").agg(
        F.count(F.lit(1)).alias("asset_rows"),
        F.sum("value").alias("worth_rows"),
        F.sum(F.coalesce("share_percent", F.lit(0))).alias("percent"),
    )
    repeated = per_heir.groupBy("will_id").agg(
        F.sum("asset_rows").alias("asset_rows"),
        F.sum("worth_rows").alias("worth_rows"),
        F.sum("percent").alias("percent"),
        F.count("beneficiary_id").alias("total_beneficiaries"),
    )
    return plain.join(repeated, "will_id")


def will_summary_stats(
    assets: DataFrame, shares: DataFrame, executors: DataFrame, mode: str = "exact"
) -> DataFrame:
    """Statistics per will with assets.

    `exact` counts every asset and executor once.  `as_written` gives the figures of the plain
    asset-share-executor join, where rows repeat; they are computed as products of per-side
    counts, so the repeated rows never exist.
    """
    named = executors.groupBy("will_id").agg(
        F.count("executor_id").alias("executors"),
        F.count_if(F.col("is_primary") == "Y").alias("primaries"),
    )
    zero = F.lit(0).cast("long")
    sides = (
        _will_facts(assets, shares)
        .join(named, "will_id", "left")
        .withColumn("executors", F.coalesce("executors", zero))
        .withColumn("primaries", F.coalesce("primaries", zero))
    )
    if mode == "as_written":
        times = F.greatest("executors", F.lit(1))
        assets_col = F.col("asset_rows") * times
        value_col = F.col("worth_rows") * times
        executors_col = F.col("asset_rows") * F.col("executors")
        primary_col = F.col("asset_rows") * F.col("primaries")
    else:
        assets_col, value_col = F.col("assets"), F.col("worth")
        executors_col, primary_col = F.col("executors"), F.col("primaries")
    return sides.select(
        "will_id",
        assets_col.alias("total_assets"),
        zero_if_null(value_col).alias("total_value"),
        F.coalesce("total_beneficiaries", zero).alias("total_beneficiaries"),
        executors_col.alias("total_executors"),
        primary_col.alias("primary_executors"),
        rounded_mean(zero_if_null(value_col), assets_col).alias("avg_asset_value"),
    )


def will_stats(assets: DataFrame, shares: DataFrame, mode: str = "exact") -> DataFrame:
    """Assets, value, beneficiaries and mean share per will.

    The mean runs over share rows, an asset without shares counting as one row of 0 %.
    """
    sides = _will_facts(assets, shares)
    as_written = mode == "as_written"
    mean = F.col("percent").cast("double") / F.col("asset_rows").cast("double")
    return sides.select(
        "will_id",
        F.col("asset_rows" if as_written else "assets").alias("total_assets"),
        zero_if_null(F.col("worth_rows" if as_written else "worth")).alias("total_value"),
        F.coalesce("total_beneficiaries", F.lit(0).cast("long")).alias("total_beneficiaries"),
        mean.alias("avg_allocation"),
    )


def will_beneficiary_summary(
    beneficiaries: DataFrame, shares: DataFrame, assets: DataFrame
) -> DataFrame:
    """Inheritance per will and beneficiary with its percentage of the estate.

    Estates are summed from the heirs, which are exact decimals.
    """
    total = zero_if_null(F.sum(share_value(F.col("value"), F.col("share_percent"))))
    worth = shares.select("asset_id", "beneficiary_id", "share_percent").join(
        assets.select("asset_id", "will_id", "value"), "asset_id"
    )
    per_heir = worth.groupBy("will_id", "beneficiary_id").agg(
        F.count("asset_id").alias("assigned_assets"), total.alias("total_inheritance")
    )
    named = per_heir.join(
        beneficiaries.select("beneficiary_id", "full_name", "relation"), "beneficiary_id"
    )
    estates = named.groupBy("will_id").agg(F.sum("total_inheritance").alias("estate"))
    joined = attach(named, estates, ["will_id"], "inner")
    return joined.select(
        "will_id",
        "beneficiary_id",
        "full_name",
        "relation",
        "assigned_assets",
        "total_inheritance",
        percent_of(F.col("total_inheritance"), F.col("estate")).alias("pct_of_estate"),
    )
