"""Validators: a batch gets `reject_code` and `reject_reason`, both NULL when accepted.

When several rules are broken, the first in checking order is reported.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bequest import model as M
from bequest.functions import dates, text
from bequest.functions.money import zero_if_null
from bequest.operators.joins import (
    attach,
    first_failure,
    judged_by_key,
    missing,
    split_checked,
    with_flag,
)
from bequest.plans.allocations import allocated
from bequest.session import written
from bequest.sources.tables import literal_rows


def _checked(df: DataFrame, *checks) -> DataFrame:
    return df.select("*", *first_failure(*checks))


def _is_false(flag: str) -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


# --- users -----------------------------------------------------------------------------------


def check_email(users: DataFrame) -> DataFrame:
    """A missing e-mail passes."""
    email = F.col("email")
    bad = email.isNotNull() & ~text.is_email(email)
    reason = text.join_text(F.lit("malformed e-mail: "), email)
    return _checked(users, (bad, -20030, reason))


def check_new_users(batch: DataFrame, users: DataFrame) -> DataFrame:
    """Required fields, role domain and an e-mail that nobody has; the first request wins."""
    lacking = (
        text.is_blank(F.col("full_name"))
        | text.is_blank(F.col("email"))
        | text.is_blank(F.col("initial_role"))
    )
    strange = ~F.col("initial_role").isin(*M.INITIAL_ROLES)
    usable = batch.withColumn("__usable", ~lacking & ~F.coalesce(strange, F.lit(True)))

    taken = users.where(F.col("email").isNotNull())
    first = F.min(F.when(F.col("__usable"), F.col("seq"))).alias("__first")
    joined = judged_by_key(
        usable, ["email"], lambda keys: with_flag(keys, taken, ["email"], "__taken"), first
    )
    return _checked(
        joined,
        (lacking, M.FORM_FIELD_MISSING, "name, e-mail and role are required"),
        (strange, M.FORM_ROLE_UNKNOWN, "unknown role"),
        (F.col("__taken"), M.FORM_EMAIL_TAKEN, "e-mail is registered already"),
        (F.col("seq") > F.col("__first"), M.FORM_EMAIL_REPEATED, "e-mail repeats in the batch"),
    ).drop("__usable", "__first", "__taken")


def check_profile(users: DataFrame, as_of: Column) -> DataFrame:
    name, address = F.trim("full_name"), F.trim("address")
    too_young = dates.full_years(F.col("date_of_birth"), as_of) < M.ADULT_AGE
    return _checked(
        users,
        (
            F.coalesce(F.length(name) < 3, F.lit(True)),
            M.PROFILE_NAME,
            "name shorter than 3 characters",
        ),
        (
            ~F.coalesce(text.is_loose_email(F.col("email")), F.lit(False)),
            M.PROFILE_EMAIL,
            "unusable e-mail",
        ),
        (
            ~F.coalesce(text.is_phone(F.col("phone_number")), F.lit(False)),
            M.PROFILE_PHONE,
            "unusable phone number",
        ),
        (too_young, M.PROFILE_AGE, "younger than 18"),
        (
            F.coalesce(F.length(address) < 10, F.lit(True)),
            M.PROFILE_ADDRESS,
            "address shorter than 10 characters",
        ),
    )


# --- form rows -------------------------------------------------------------------------------


def check_required(batch: DataFrame, *fields: str) -> DataFrame:
    """The first blank field, in the order given, is named in the reason."""
    return _checked(
        batch,
        *[
            (text.is_blank(F.col(f)), M.FORM_FIELD_MISSING, f"{f.replace('_', ' ')} is required")
            for f in fields
        ],
    )


def check_asset_forms(batch: DataFrame) -> DataFrame:
    number = F.trim("value").try_cast(M.MONEY)
    return _checked(
        batch,
        *[
            (text.is_blank(F.col(f)), M.FORM_FIELD_MISSING, f"{f.replace('_', ' ')} is required")
            for f in ("name", "asset_type", "value")
        ],
        (number.isNull(), M.FORM_VALUE_INVALID, "value is no number"),
        (number < 0, M.FORM_VALUE_INVALID, "value is negative"),
    )


def check_domain(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """Count the values of a column and tell which belong to its domain."""
    value = F.col(column)
    return (
        df.groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.lit(column).alias("column"),
            "value",
            "rows",
            F.coalesce(F.col("value").isin(*allowed), F.lit(False)).alias("in_domain"),
        )
    )


# --- shares ----------------------------------------------------------------------------------


def assets_with_status(assets: DataFrame, wills: DataFrame) -> DataFrame:
    status = wills.select("will_id", F.col("status").alias("__status"))
    return assets.select("asset_id", "will_id").join(status, "will_id", "left")


def _with_asset(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Facts by asset for every row, moved once; a row without a beneficiary names no pair and gets none."""
    named = F.when(F.col("beneficiary_id").isNotNull(), F.col("asset_id"))
    found = known.withColumnRenamed("asset_id", "__named")
    return attach(batch.withColumn("__named", named), found, ["__named"]).drop("__named")


def _assignment_facts(
    batch: DataFrame,
    assets: DataFrame,
    wills: DataFrame,
    beneficiaries: DataFrame,
    per_asset: DataFrame | None = None,
) -> DataFrame:
    known = assets_with_status(assets, wills).select(
        "asset_id", F.lit(True).alias("__asset"), "__status"
    )
    if per_asset is not None:
        known = known.join(per_asset, "asset_id", "left")
    heirs = beneficiaries.select("beneficiary_id", F.lit(True).alias("__heir"))
    facts = _with_asset(batch, known).join(heirs, "beneficiary_id", "left")
    pair = ["asset_id", "beneficiary_id"]
    return facts.select(*pair, *[c for c in facts.columns if c not in pair])


def _assignment_checks() -> list[tuple]:
    share = F.col("share_percent")
    usable = share.isNotNull() & (share >= M.MIN_SHARE) & (share <= M.FULL_PERCENT)
    return [
        (~usable, M.FORM_SHARE_INVALID, "share must lie between 0.01 and 100"),
        (F.col("asset_id").isNull(), -20010, "asset id is missing"),
        (
            _is_false("__asset"),
            -21001,
            text.join_text(F.lit("unknown asset "), F.col("asset_id")),
        ),
        (
            _is_false("__heir"),
            -21002,
            text.join_text(F.lit("unknown beneficiary "), F.col("beneficiary_id")),
        ),
        (F.col("__status").isNull(), -20013, "asset has no valid will"),
        (F.col("__status") == "Executed", -21003, "will is executed"),
    ]


def check_assignment_targets(
    batch: DataFrame, assets: DataFrame, wills: DataFrame, beneficiaries: DataFrame
) -> DataFrame:
    """Everything about a share request but the 100 % limit."""
    facts = _assignment_facts(batch, assets, wills, beneficiaries)
    return _checked(facts, *_assignment_checks()).drop("__asset", "__status", "__heir")


def check_assignments(
    batch: DataFrame,
    assets: DataFrame,
    wills: DataFrame,
    beneficiaries: DataFrame,
    shares: DataFrame,
) -> DataFrame:
    """Each share request on its own against the stored shares."""
    stored = allocated(shares).select("asset_id", F.col("allocated_percent").alias("__stored"))
    facts = _assignment_facts(batch, assets, wills, beneficiaries, stored)
    total = zero_if_null(F.col("__stored")) + F.col("share_percent")
    reason = text.join_text(
        F.lit("shares would exceed 100 %, now at "), zero_if_null(F.col("__stored"))
    )
    checked = _checked(facts, *_assignment_checks(), (total > M.FULL_PERCENT, -21004, reason))
    warned = F.col("reject_code").isNull() & (total < M.APPROVE_PERCENT)
    return checked.withColumn("below_90", warned).drop(
        "__asset", "__status", "__heir", "__stored"
    )


def check_share_rows(
    rows: DataFrame, assets: DataFrame, wills: DataFrame, shares: DataFrame
) -> DataFrame:
    """Written share rows (inserts with a NULL mapping id, or updates) with the table's codes.

    The stored row that an update replaces does not count towards the total.
    """

    stored = allocated(shares).select("asset_id", F.col("allocated_percent").alias("__stored"))

    def judge(keys: DataFrame) -> DataFrame:
        known = assets_with_status(assets, wills).select(
            "asset_id", F.lit(True).alias("__asset"), "__status"
        )
        return keys.join(known, "asset_id", "left").join(stored, "asset_id", "left")

    own = shares.select("mapping_id", "asset_id", F.col("share_percent").alias("__own"))
    facts = judged_by_key(rows, ["asset_id"], judge)
    facts = facts.join(own, ["mapping_id", "asset_id"], "left")
    total = (
        zero_if_null(F.col("__stored"))
        - zero_if_null(F.col("__own"))
        + zero_if_null(F.col("share_percent"))
    )
    return _checked(
        facts,
        (F.col("asset_id").isNull(), -20010, "asset id is missing"),
        (_is_false("__asset"), -20011, "unknown asset"),
        (F.col("__status").isNull(), -20013, "asset has no valid will"),
        (F.col("__status") == "Executed", -20012, "will is executed"),
        (total > M.FULL_PERCENT, -20005, text.join_text(F.lit("shares add up to "), total)),
    ).drop("__asset", "__status", "__stored", "__own")


def orphan_shares(shares: DataFrame, assets: DataFrame) -> DataFrame:
    """Share rows whose asset is gone."""
    return missing(shares.where(F.col("asset_id").isNotNull()), assets, "asset_id")


# --- wills -----------------------------------------------------------------------------------


def incomplete_assets(assets: DataFrame, shares: DataFrame, threshold: int) -> DataFrame:
    """Per will, the number of assets allocated below the threshold."""
    low = zero_if_null(F.col("allocated_percent")) < threshold
    return (
        assets.select("asset_id", "will_id")
        .join(allocated(shares), "asset_id", "left")
        .groupBy("will_id")
        .agg(F.count_if(low).alias("incomplete"))
    )


def check_allocation(
    wills: DataFrame, assets: DataFrame, shares: DataFrame, threshold: int, code: int
) -> DataFrame:
    """Wills with an asset below the threshold; a will without assets passes."""
    low = incomplete_assets(assets, shares, threshold)
    reason = text.join_text(F.col("incomplete"), F.lit(f" assets below {threshold} %"))
    return _checked(
        wills.join(low, "will_id", "left").withColumn(
            "incomplete", F.coalesce("incomplete", F.lit(0).cast("long"))
        ),
        (F.col("incomplete") > 0, code, reason),
    )


def check_approvals(
    requests: DataFrame,
    wills: DataFrame,
    executors: DataFrame,
    assets: DataFrame,
    shares: DataFrame,
) -> DataFrame:
    """Approval requests by will; facts are gathered once per will."""

    def judge(keys: DataFrame) -> DataFrame:
        named = executors.groupBy("will_id").agg(
            F.count(F.lit(1)).alias("__executors"),
            F.count_if(F.col("is_primary") == "Y").alias("__primaries"),
        )
        low = incomplete_assets(assets, shares, M.APPROVE_PERCENT).select(
            "will_id", F.col("incomplete").alias("__low")
        )
        status = wills.select(
            "will_id", F.lit(True).alias("__will"), F.col("status").alias("__status")
        )
        return (
            keys.join(status, "will_id", "left")
            .join(named, "will_id", "left")
            .join(low, "will_id", "left")
        )

    facts = judged_by_key(requests, ["will_id"], judge)
    none = F.lit(0).cast("long")
    return _checked(
        facts,
        (_is_false("__will"), -20091, text.join_text(F.lit("unknown will "), F.col("will_id"))),
        (
            F.col("__status") != "Draft",
            -20092,
            text.join_text(F.lit("will is "), F.col("__status")),
        ),
        (F.coalesce("__executors", none) == 0, -20093, "will has no executor"),
        (F.coalesce("__primaries", none) == 0, -20094, "will has no primary executor"),
        (
            F.coalesce("__low", none) > 0,
            -20095,
            text.join_text(F.col("__low"), F.lit(" assets below 90 %")),
        ),
    ).drop("__will", "__status", "__executors", "__primaries", "__low")


def status_checks(old: Column, new: Column) -> list[tuple]:
    moved = old != new
    return [
        (
            moved & (old == "Executed"),
            -20003,
            text.join_text(F.lit("executed will cannot become "), new),
        ),
        (
            moved & (old == "Draft") & (new == "Executing"),
            -20004,
            "draft will cannot become Executing",
        ),
    ]


def check_status_moves(moves: DataFrame) -> DataFrame:
    """Rows with old_status and new_status; an unchanged or missing status passes."""
    return _checked(moves, *status_checks(F.col("old_status"), F.col("new_status")))


def request_place(requests: DataFrame, *key: str) -> Column:
    """Total order of the requests of one key: by seq, then by what they ask for.

    The row number `__id` tells only true copies apart, of which it does not matter which is first.
    """
    rest = [c for c in sorted(requests.columns) if c not in ("seq", "__id", *key)]
    return F.struct("seq", *rest, "__id")


def check_deletions(
    requests: DataFrame, wills: DataFrame, enforce_protection: bool = True
) -> DataFrame:
    """Delete requests in order: once a will's request passes, later ones find no will.

    Their order is that of seq, then of what they ask for; of true copies one is first.
    """
    # The written numbers tell copies of a request apart; once written they do not change.
    place = request_place(requests, "will_id")
    requests = written(requests.withColumn("__id", F.monotonically_increasing_id()), "delete-requests")

    def judge(keys: DataFrame) -> DataFrame:
        status = wills.select(
            "will_id", F.lit(True).alias("__will"), F.col("status").alias("__status")
        )
        return keys.join(status, "will_id", "left")

    forced = F.coalesce("force", F.lit(False))
    confirmed = F.coalesce(F.col("confirm_text") == M.DELETE_CONFIRMATION, F.lit(False))
    facts = judged_by_key(
        requests,
        ["will_id"],
        judge,
        F.min(place).alias("__any"),
        F.min(F.when(forced & confirmed, place)).alias("__forced"),
    )
    not_draft = F.col("__status") != "Draft"
    protected = F.lit(enforce_protection) & F.col("__status").isin(*M.PROTECTED_STATUSES)
    passed = F.when(~not_draft, F.col("__any")).when(~protected, F.col("__forced"))
    gone = _is_false("__will") | F.coalesce(place > passed, F.lit(False))
    return _checked(
        facts,
        (F.col("will_id").isNull(), -26000, "will id is missing"),
        (gone, -26001, text.join_text(F.lit("unknown will "), F.col("will_id"))),
        (
            not_draft & ~forced,
            -26002,
            text.join_text(F.lit("will is "), F.col("__status")),
        ),
        (not_draft & forced & ~confirmed, -26004, "confirmation text is missing"),
        (protected, -20031, "will is protected"),
    ).drop("__will", "__status", "__any", "__forced", "__id")


# --- executors -------------------------------------------------------------------------------


def check_primary(batch: DataFrame, executors: DataFrame) -> DataFrame:
    """Executor rows marked primary while another executor of the will is.

    A batch is taken in the order of executor_id: its first primary of a will that has none counts
    for the rows behind it.
    """
    stored = executors.where(F.col("is_primary") == "Y")
    per_will = stored.groupBy("will_id").agg(
        F.count(F.lit(1)).alias("__primaries"),
        F.min("executor_id").alias("__low"),
        F.max("executor_id").alias("__high"),
    )
    facts = judged_by_key(
        batch,
        ["will_id"],
        lambda keys: keys.join(per_will, "will_id", "left"),
        F.min(F.when(F.col("is_primary") == "Y", F.col("executor_id"))).alias("__first"),
    )
    own = F.coalesce(F.col("executor_id"), F.lit(-1))
    # Another id is among the primaries when the smallest or the largest differs.
    stored_other = (F.col("__low") != own) | (F.col("__high") != own)
    before = F.col("__low").isNull() & (F.col("executor_id") > F.col("__first"))
    other = F.coalesce(stored_other, F.lit(False)) | F.coalesce(before, F.lit(False))
    return _checked(
        facts,
        ((F.col("is_primary") == "Y") & other, -20022, "will has another primary executor"),
    ).drop("__primaries", "__low", "__high", "__first")


def check_primary_requests(requests: DataFrame, executors: DataFrame) -> DataFrame:
    known = executors.select("executor_id", "will_id")
    facts = judged_by_key(
        requests, ["executor_id"], lambda keys: keys.join(known, "executor_id", "left")
    )
    return _checked(
        facts,
        (F.col("executor_id").isNull(), -25000, "executor id is missing"),
        (
            F.col("will_id").isNull(),
            -25001,
            text.join_text(F.lit("unknown executor "), F.col("executor_id")),
        ),
    )


# --- transfers and documents -----------------------------------------------------------------


def check_transfers(
    requests: DataFrame,
    assets: DataFrame,
    beneficiaries: DataFrame,
    shares: DataFrame,
    wills: DataFrame,
    transfers: DataFrame,
    per_will: DataFrame | None = None,
) -> DataFrame:
    """`per_will` adds columns by will to the facts looked up.

    The requests are moved twice: by pair, to one row with what shares and transfers say of it, and by asset.
    """
    known = assets_with_status(assets, wills).withColumnRenamed("__status", "will_status")
    known = known.withColumn("__asset", F.lit(True))
    if per_will is not None:
        known = known.join(per_will, "will_id", "left")
    heirs = beneficiaries.select("beneficiary_id", F.lit(True).alias("__heir"))
    pair = ["asset_id", "beneficiary_id"]
    done = transfers.where(F.col("transfer_status") == "Completed")
    linked = shares.select(*pair, F.lit(False).alias("__done"))
    flags = linked.unionByName(done.select(*pair, F.lit(True).alias("__done")))
    flags = flags.groupBy(*pair).agg(
        F.bool_or(~F.col("__done")).alias("__linked"), F.bool_or("__done").alias("__done")
    )
    facts = _with_asset(attach(requests, flags, pair), known)
    facts = facts.withColumn("__done", F.coalesce("__done", F.lit(False)))
    facts = facts.join(heirs, "beneficiary_id", "left")
    facts = facts.select(*pair, *[c for c in facts.columns if c not in pair])
    movable = F.col("will_status").isin(*M.TRANSFERABLE_STATUSES)
    return _checked(
        facts,
        (
            _is_false("__asset"),
            -23001,
            text.join_text(F.lit("unknown asset "), F.col("asset_id")),
        ),
        (
            _is_false("__heir"),
            -23002,
            text.join_text(F.lit("unknown beneficiary "), F.col("beneficiary_id")),
        ),
        (_is_false("__linked"), -23003, "beneficiary has no share of the asset"),
        (
            ~F.coalesce(movable, F.lit(False)),
            -23004,
            text.join_text(F.lit("will is "), F.col("will_status")),
        ),
        (F.col("__done"), -23005, "transfer is completed already"),
    ).drop("__asset", "__heir", "__linked", "__done")


def holiday_keys(holidays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holiday names by exact day and, for recurring ones, by month and day.

    Two keyed tables turn the "same day or same MM-DD" test into two equi-joins.
    """
    exact = holidays.groupBy(F.to_date("holiday_date").alias("__day")).agg(
        F.max("description").alias("__exact"), F.lit(True).alias("__is_exact")
    )
    yearly = (
        holidays.where(F.col("is_recurring") == "Y")
        .groupBy(dates.month_day_number(F.col("holiday_date")).alias("__md"))
        .agg(F.max("description").alias("__yearly"), F.lit(True).alias("__is_yearly"))
    )
    return exact, yearly


def _with_calendar(batch: DataFrame, holidays: DataFrame, when: Column) -> DataFrame:
    """Holiday facts by day and by month-day: two small keyed tables, joined without a shuffle
    of the batch as long as the calendar stays below Spark's broadcast threshold."""
    exact, yearly = holiday_keys(holidays)
    dated = batch.withColumn("__day", F.to_date(when)).withColumn("__md", dates.month_day_number(when))
    return dated.join(exact, "__day", "left").join(yearly, "__md", "left")


def business_day_checks(when: Column) -> list[tuple]:
    holiday = F.coalesce("__is_exact", "__is_yearly", F.lit(False))
    # The greatest name, as with several holidays on one day.
    name = F.coalesce(F.greatest("__exact", "__yearly"), F.lit("a public holiday"))
    return [
        (
            dates.is_weekend(when),
            -20001,
            text.join_text(F.lit("Weekend: no transfers on "), dates.day_name(when)),
        ),
        (
            holiday,
            -20002,
            text.join_text(
                F.lit("Holiday: no transfers on "),
                name,
                F.lit(" ("),
                dates.date_text(when),
                F.lit(")"),
            ),
        ),
    ]


CALENDAR_FACTS = ("__day", "__md", "__exact", "__is_exact", "__yearly", "__is_yearly")


def check_business_day(
    batch: DataFrame, holidays: DataFrame, as_of: Column, column: str = "transfer_date"
) -> DataFrame:
    """Transfers on weekends or holidays; a missing date means `as_of`."""
    when = F.coalesce(F.col(column), as_of)
    facts = _with_calendar(batch, holidays, when)
    return _checked(facts, *business_day_checks(when)).drop(*CALENDAR_FACTS)


def check_documents(batch: DataFrame, wills: DataFrame, assets: DataFrame) -> DataFrame:
    kind = text.normalise(F.col("related_entity"))
    keyed = batch.withColumn("__kind", kind)

    def judge(keys: DataFrame) -> DataFrame:
        targets = wills.select(F.lit("WILL").alias("__kind"), F.col("will_id").alias("entity_id"))
        targets = targets.unionByName(
            assets.select(F.lit("ASSET").alias("__kind"), F.col("asset_id").alias("entity_id"))
        ).withColumn("__known", F.lit(True))
        return keys.join(targets, ["__kind", "entity_id"], "left")

    facts = judged_by_key(keyed, ["__kind", "entity_id"], judge)
    proper = F.coalesce(F.col("__kind").isin(*M.DOCUMENT_ENTITIES), F.lit(False))
    return _checked(
        facts,
        (
            ~proper,
            -24001,
            text.join_text(F.lit("unusable related entity: "), F.col("related_entity")),
        ),
        (
            _is_false("__known"),
            -24002,
            text.join_text(F.lit("unknown "), F.col("__kind"), F.lit(" "), F.col("entity_id")),
        ),
    ).drop("__kind", "__known")


# --- messages --------------------------------------------------------------------------------


def explain(rejected: DataFrame) -> DataFrame:
    """Class, severity and message of every rejected row; unlisted codes are generic."""
    codes = literal_rows(rejected.sparkSession, M.CODES, M.CODES_SCHEMA)
    kind, severity, message = M.GENERIC
    tail = text.tail_after(F.col("reject_reason"), ":")
    worded = F.when(
        F.col("error_class").isin("weekend", "holiday", "approval"),
        text.join_text(F.coalesce("message", F.lit(message)), F.lit(": "), tail),
    ).otherwise(F.coalesce("message", F.lit(message)))
    return rejected.join(codes, "reject_code", "left").select(
        *rejected.columns,
        F.coalesce("error_class", F.lit(kind)).alias("error_class"),
        F.coalesce("severity", F.lit(severity)).alias("severity"),
        worded.alias("message"),
    )


__all__ = [name for name in dir() if name.startswith("check_")] + [
    "explain",
    "orphan_shares",
    "split_checked",
]
