"""Batch state transitions: requests and tables in, new tables plus history and audit out.

Nothing is updated in place.  Every function returns a dict of lazy frames; rejected requests
always reach `rejected` and the audit rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bequest import model as M
from bequest.functions import dates, text
from bequest.functions.records import json_text
from bequest.operators import rules
from bequest.operators.joins import (
    attach,
    first_failure,
    judged_by_key,
    matching,
    missing,
    rows_per,
    split_checked,
    with_flag,
)
from bequest.operators.ordered import CHUNK, first_rows, last_before
from bequest.operators.snapshots import BUCKETS, where_changed
from bequest.session import written
from bequest.sources.parted import PartedTable

Tables = dict[str, DataFrame]


def _audit(
    df: DataFrame,
    actor: str,
    as_of: Column,
    action: str | Column,
    table: str | Column,
    record: Column | None = None,
    old: Column | None = None,
    new: Column | None = None,
    status: str = "SUCCESS",
) -> DataFrame:
    def lit(c):
        return c if isinstance(c, Column) else F.lit(c)

    nothing = F.lit(None).cast("string")
    return df.select(
        F.lit(actor).alias("user_name"),
        lit(action).alias("action"),
        lit(table).alias("action_table"),
        (F.lit(None) if record is None else record).cast("long").alias("record_id"),
        (nothing if old is None else old).alias("old_values"),
        (nothing if new is None else new).alias("new_values"),
        as_of.alias("timestamp"),
        F.lit(status).alias("status"),
    )


def _refused(
    rejected: DataFrame, actor: str, as_of: Column, table: str, step: str, record=None
) -> DataFrame:
    reason = text.join_text(F.col("reject_code"), F.lit(" "), F.col("reject_reason"))
    return _audit(
        rejected,
        actor,
        as_of,
        "PROCEDURE",
        table,
        record,
        F.lit(f"{step} refused"),
        reason,
        "ERROR",
    )


def _history(
    df: DataFrame, old: Column, new: Column, actor: str, when: Column, reason: str
) -> DataFrame:
    return df.select(
        "will_id",
        old.alias("old_status"),
        new.alias("new_status"),
        F.lit(actor).alias("changed_by"),
        when.alias("change_date"),
        F.lit(reason).alias("reason"),
    )


def _set_status(wills: DataFrame, moved: DataFrame, status: str, as_of: Column) -> DataFrame:
    """Wills with the status of the (distinct) moved ids replaced."""
    flag = moved.select("will_id").distinct().withColumn("__moved", F.lit(True))
    joined = wills.join(flag, "will_id", "left")
    hit = F.coalesce("__moved", F.lit(False))
    return joined.select(
        *[
            F.when(hit, F.lit(status)).otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(hit, as_of).otherwise(F.col(c)).alias(c)
            if c == "last_updated_at"
            else F.col(c)
            for c in wills.columns
        ]
    )


# --- wills -----------------------------------------------------------------------------------


def approve_wills(requests: DataFrame, tables: Tables, as_of: Column, actor: str) -> Tables:
    checked = rules.check_approvals(
        requests, tables["wills"], tables["executors"], tables["assets"], tables["shares"]
    )
    # The written numbers tell copies of a request apart; once written they do not change.
    checked = written(
        checked.withColumn("__id", F.monotonically_increasing_id()), "approvals"
    )
    place = rules.request_place(requests, "will_id")
    passing = checked.where(F.col("reject_code").isNull())
    first = passing.groupBy("will_id").agg(F.min(place).alias("__first"))
    late = F.col("reject_code").isNull() & (place > F.col("__first"))
    judged = attach(checked, first, ["will_id"]).withColumns(
        {
            "reject_code": F.when(late, F.lit(-20092)).otherwise(F.col("reject_code")),
            "reject_reason": F.when(late, "will is Approved").otherwise(F.col("reject_reason")),
        }
    )
    accepted, rejected = split_checked(judged.drop("__id", "__first"))
    done = _audit(
        accepted,
        actor,
        as_of,
        "PROCEDURE",
        "WILLS",
        F.col("will_id"),
        json_text(status=F.lit("Draft")),
        json_text(status=F.lit("Approved")),
    )
    refused = _refused(rejected, actor, as_of, "WILLS", "approve_wills", F.col("will_id"))
    return {
        "wills": _set_status(tables["wills"], accepted, "Approved", as_of),
        "history": _history(
            accepted.select("will_id").distinct(), F.lit("Draft"), F.lit("Approved"), actor, as_of, "approve_wills"
        ),
        "audit": done.unionByName(refused),
        "rejected": rejected,
    }


def approve_in_parts(
    requests: DataFrame, wills: PartedTable, tables: Tables, as_of: Column, actor: str
) -> Tables:
    """`approve_wills` over a table in parts, of which those with approved wills are written anew.

    The wills of the result are the table's new version.
    """
    result = approve_wills(requests, {**tables, "wills": wills.rows()}, as_of, actor)
    moved = written(result["history"].select("will_id"), "approved-wills")
    wills.rewrite(moved, lambda rows: _set_status(rows, moved, "Approved", as_of))
    return result | {"wills": wills.rows()}


def status_history(
    changes: DataFrame,
    actor: str,
    initial: DataFrame | None = None,
    chunk: int = CHUNK,
) -> Tables:
    """Replay status changes (seq, will_id, new_status, change_date) in seq order.

    A refused change leaves the status as it was.  The first change of a will without an
    initial status (will_id, status) just sets it.  `state` is the status after the replay.

    The replay needs no walk through a will's changes.  Executed is final, so every change
    after the first move to Executed meets Executed.  Otherwise only an Executing request can
    be refused, namely while the will is a draft: the status is that of the last other change,
    or Executing if an Executing request followed and that change was not to Draft.
    """
    new = F.col("new_status")
    start = (
        initial.select("will_id", F.col("status").alias("__start"))
        if initial is not None
        else None
    )
    bounds = changes.groupBy("will_id").agg(
        F.min("seq").alias("__first"),
        F.min(F.when(new == "Executed", F.col("seq"))).alias("__final"),
    )
    if start is None:
        facts = bounds.withColumn("__start", F.lit(None).cast("string"))
    else:
        facts = bounds.join(start, "will_id", "left")
    known = attach(changes, facts, ["will_id"])

    # The first change of a will without a start is its anchor even if it says Executing.
    sets_start = F.col("__start").isNull() & (F.col("seq") == F.col("__first"))
    anchors = (new != "Executing") | sets_start
    scanned = last_before(
        known,
        "will_id",
        "seq",
        {
            "anchor": F.when(anchors, F.struct("seq", F.col("new_status").alias("status"))),
            "executing": F.when(~anchors, F.col("seq")),
        },
        chunk,
    )
    base = F.coalesce(F.col("anchor.status"), F.col("__start"))
    followed = F.col("executing") > F.coalesce(F.col("anchor.seq"), F.lit(-(2**62)))
    old = (
        F.when((F.col("__start") == "Executed") | (F.col("__final") < F.col("seq")), "Executed")
        .when((base != "Draft") & followed, "Executing")
        .otherwise(base)
    )
    stepped = scanned.withColumn("old_status", old).select(
        *changes.columns, "old_status", "__first"
    )
    judged = stepped.drop("__first").select(
        "*", *first_failure(*rules.status_checks(F.col("old_status"), F.col("new_status")))
    )
    checked = written(judged, "status-changes")
    accepted, rejected = split_checked(checked)
    moved = accepted.where(F.col("old_status") != F.col("new_status"))
    after = F.when(F.col("reject_code").isNull(), F.col("new_status")).otherwise(
        F.col("old_status")
    )
    return {
        "history": moved.select(
            "will_id",
            "seq",
            "old_status",
            "new_status",
            F.lit(actor).alias("changed_by"),
            "change_date",
            F.lit("status change").alias("reason"),
        ),
        "rejected": rejected,
        "state": checked.groupBy("will_id").agg(F.max_by(after, "seq").alias("status")),
    }


def will_changes(
    asset_changes: DataFrame,
    executor_changes: DataFrame,
    share_changes: DataFrame,
    assets: DataFrame,
) -> DataFrame:
    """(will_id, changed_at) from changed assets, executors and shares.

    Shares name their will through the asset; they are reduced to the latest change per asset
    before the lookup.
    """
    per_asset = share_changes.groupBy("asset_id").agg(F.max("changed_at").alias("changed_at"))
    via_assets = per_asset.join(assets.select("asset_id", "will_id"), "asset_id")
    parts = [
        df.where(F.col("will_id").isNotNull()).select("will_id", "changed_at")
        for df in (asset_changes, executor_changes, via_assets)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def touch_wills(wills: DataFrame, changes: DataFrame) -> DataFrame:
    latest = changes.groupBy("will_id").agg(F.max("changed_at").alias("__changed"))
    return wills.join(latest, "will_id", "left").select(
        *[
            F.greatest("last_updated_at", "__changed").alias(c)
            if c == "last_updated_at"
            else F.col(c)
            for c in wills.columns
        ]
    )


def diff_audit(old: DataFrame, new: DataFrame, actor: str, as_of: Column) -> DataFrame:
    """Audit rows telling two snapshots of the wills apart."""
    shown = ("title", "status")
    before = old.select("will_id", *[F.col(c).alias(f"old_{c}") for c in shown]).withColumn(
        "was", F.lit(True)
    )
    after = new.select("will_id", *[F.col(c).alias(f"new_{c}") for c in shown]).withColumn(
        "is", F.lit(True)
    )
    both = before.join(after, "will_id", "full_outer")
    action = (
        F.when(F.col("was").isNull(), "INSERT")
        .when(F.col("is").isNull(), "DELETE")
        .otherwise("UPDATE")
    )
    same = F.lit(True)
    for c in shown:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    unchanged = F.col("was").isNotNull() & F.col("is").isNotNull() & same

    def values(side: str) -> Column:
        return json_text(
            will_id=F.col("will_id"), **{c: F.col(f"{side}_{c}") for c in shown}
        )

    return _audit(
        both.where(~unchanged),
        actor,
        as_of,
        action,
        "WILLS",
        F.col("will_id"),
        F.when(F.col("was"), values("old")),
        F.when(F.col("is"), values("new")),
        "ALLOWED",
    )


def delete_wills(
    requests: DataFrame,
    tables: Tables,
    as_of: Column,
    actor: str,
    enforce_protection: bool = True,
    counts: bool = True,
) -> Tables:
    """Delete wills with everything that hangs on them.

    Without `counts` the rows of each table are not counted, and deleted_counts and audit, which
    need the counts, are left out.
    """
    checked = rules.check_deletions(requests, tables["wills"], enforce_protection)
    accepted, rejected = split_checked(written(checked, "deletions"))
    status = tables["wills"].select("will_id", F.col("status").alias("old_status"))
    doomed = written(matching(status, accepted, "will_id"), "deleted-wills")
    gone_assets = written(
        matching(tables["assets"].select("asset_id", "will_id"), doomed, "will_id"),
        "deleted-assets",
    )

    def target(kind: str, ids: DataFrame, key: str) -> DataFrame:
        return ids.select(F.lit(kind).alias("related_entity"), F.col(key).alias("entity_id"))

    gone_targets = target("WILL", doomed, "will_id").unionByName(
        target("ASSET", gone_assets, "asset_id")
    )
    entity = ["related_entity", "entity_id"]
    left = {
        "wills": missing(tables["wills"], doomed, "will_id"),
        "assets": missing(tables["assets"], doomed, "will_id"),
        "executors": missing(tables["executors"], doomed, "will_id"),
        "history": missing(tables["history"], doomed, "will_id"),
        "shares": missing(tables["shares"], gone_assets, "asset_id"),
        "transfers": missing(tables["transfers"], gone_assets, "asset_id"),
        "documents": missing(tables["documents"], gone_targets, *entity),
        "rejected": rejected,
    }
    if not counts:
        return left

    # Rows per will of every table, counted by the nearest key first.
    def by_asset(name: str) -> DataFrame:
        per_asset = rows_per(tables[name], "asset_id", name="rows")
        return per_asset.join(gone_assets, "asset_id").select("will_id", "rows")

    def by_will(name: str) -> DataFrame:
        return rows_per(matching(tables[name], doomed, "will_id"), "will_id", name="rows")

    documents = rows_per(tables["documents"], *entity, name="rows")
    will_documents = documents.where(F.col("related_entity") == "WILL").select(
        F.col("entity_id").alias("will_id"), "rows"
    )
    asset_documents = documents.where(F.col("related_entity") == "ASSET").select(
        F.col("entity_id").alias("asset_id"), "rows"
    )
    counted = {
        "documents": matching(will_documents, doomed, "will_id").unionByName(
            asset_documents.join(gone_assets, "asset_id").select("will_id", "rows")
        ),
        "shares": by_asset("shares"),
        "transfers": by_asset("transfers"),
        "executors": by_will("executors"),
        "assets": by_will("assets"),
        "history": by_will("history"),
        "wills": doomed.select("will_id", F.lit(1).cast("long").alias("rows")),
    }
    rows = None
    for name, df in counted.items():
        part = df.select("will_id", F.lit(name).alias("table"), "rows")
        rows = part if rows is None else rows.unionByName(part)
    deleted = written(
        rows.groupBy("will_id", "table").agg(F.sum("rows").alias("rows")), "deleted-counts"
    )

    def count_of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("table") == name, F.col("rows"))), F.lit(0))

    per_will = deleted.groupBy("will_id").agg(
        F.sum("rows").alias("all_rows"),
        *[count_of(n).alias(n) for n in ("assets", "executors", "shares", "documents")],
    )
    summary = doomed.join(per_will, "will_id")
    attempt = _audit(
        summary,
        actor,
        as_of,
        "DELETE_ATTEMPT",
        "WILLS",
        F.col("will_id"),
        text.filled(M.TEXT_STATUS, F.col("old_status")),
        text.filled(
            M.TEXT_RELATED, *(F.col(c) for c in ("assets", "executors", "shares", "documents"))
        ),
        "STARTED",
    )
    per_table = _audit(
        deleted,
        actor,
        as_of,
        "DELETE",
        F.upper("table"),
        F.col("will_id"),
        text.join_text(F.lit("Deleted "), F.col("rows"), F.lit(" rows")),
    )
    final = _audit(
        summary,
        actor,
        as_of,
        "DELETE",
        "WILLS",
        F.col("will_id"),
        text.filled(M.TEXT_STATUS_BEFORE, F.col("old_status")),
        text.filled(M.TEXT_DELETED, F.col("all_rows")),
    )
    refused = _refused(rejected, actor, as_of, "WILLS", "delete_wills", F.col("will_id"))
    return left | {
        "deleted_counts": deleted,
        "audit": attempt.unionByName(per_table).unionByName(final).unionByName(refused),
    }


# --- shares ----------------------------------------------------------------------------------


def numbered(requests: DataFrame, name: str) -> DataFrame:
    """Requests written with numbers `__id`, which tell copies apart; once written they do not change."""
    return written(requests.withColumn("__id", F.monotonically_increasing_id()), name)


def accept_in_order(
    requests: DataFrame, room: DataFrame, salts: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Accept requests (asset_id, seq, cents, ...) in seq order while they fit.

    `room` holds the free cents per asset; refused requests use nothing up.  Gives the accepted
    and the refused rows.  Requests that are `numbered` already are not written again.

    Free room only shrinks, so if a request is accepted, all earlier ones of its size were too:
    of one size at most room / size requests can succeed.  Everything behind those is refused
    without looking at it, which leaves at most sum(room / s, s = 1..room) candidates per asset,
    about 98,000 where all 10,000 cents are open, however many requests there are.  Assets whose
    requests all fit need no walk at all.
    """
    if "__id" not in requests.columns:
        requests = numbered(requests, "share-requests")
    shown = [c for c in requests.columns if c != "__id"]
    rest = [c for c in sorted(shown) if c not in ("asset_id", "seq", "cents")]
    known = requests.withColumn("__tie", F.struct(*rest) if rest else F.lit(0))
    wanted = requests.groupBy("asset_id").agg(F.sum("cents").alias("__wanted"))
    open_ = wanted.join(room.select("asset_id", "room"), "asset_id", "left").withColumn(
        "room", F.coalesce("room", F.lit(10000))
    )
    # A row for each asset that cannot take all; the requests themselves stay where they are written.
    crowded = written(open_.where(F.col("__wanted") > F.col("room")).select("asset_id", "room"), "crowded-assets")
    easy = missing(known, crowded, "asset_id")
    contested = known.join(crowded, "asset_id")

    places = F.floor(F.col("room") / F.col("cents"))
    candidates = first_rows(
        contested.where(F.col("cents") <= F.col("room")).select(
            "asset_id", "seq", "__tie", "__id", "cents", "room"
        ),
        ["asset_id", "cents"],
        ["seq", "__tie", "__id"],
        places,
        **({} if salts is None else {"salts": salts}),
    )
    queue = candidates.groupBy("asset_id").agg(
        F.max("room").alias("room"),
        F.array_sort(F.collect_list(F.struct("seq", "__tie", "__id", "cents"))).alias("queue"),
    )
    nobody = F.array().cast("array<bigint>")
    walked = F.aggregate(
        "queue",
        F.struct(F.col("room").cast("long").alias("left"), nobody.alias("taken")),
        lambda acc, x: F.when(
            x["cents"] <= acc["left"],
            F.struct(
                (acc["left"] - x["cents"]).alias("left"),
                F.array_append(acc["taken"], x["__id"]).alias("taken"),
            ),
        ).otherwise(acc),
        lambda acc: acc["taken"],
    )
    taken = written(queue.select(F.explode(walked).alias("__id")), "taken-requests")
    won = contested.join(taken, "__id", "left_semi")
    lost = contested.join(taken, "__id", "left_anti")
    return easy.select(*shown).unionByName(won.select(*shown)), lost.select(*shown)


def assign_shares(
    requests: DataFrame,
    tables: Tables,
    as_of: Column,
    actor: str,
    salts: int | None = None,
) -> Tables:
    """Share requests in seq order; one that would lift its asset above 100 % is refused.

    The stored shares are read for the free room and again for the new table: `tables` should hold them as a
    table, not as a plan that derives them.
    """
    checked = rules.check_assignment_targets(
        requests, tables["assets"], tables["wills"], tables["beneficiaries"]
    )
    cents = (F.col("share_percent") * 100).cast("long")
    valid, broken = split_checked(numbered(checked.withColumn("cents", cents), "checked-shares"))
    broken = broken.drop("__id", "cents")
    stored = (
        tables["shares"]
        .groupBy("asset_id")
        .agg((F.lit(10000) - F.sum((F.col("share_percent") * 100).cast("long"))).alias("room"))
    )
    accepted, refused = accept_in_order(valid, stored, salts)
    over = refused.drop("cents").select(
        "*",
        F.lit(-21004).alias("reject_code"),
        F.lit("shares would exceed 100 %").alias("reject_reason"),
    )
    rejected = broken.unionByName(over)
    conditions = (
        F.col("conditions") if "conditions" in requests.columns else F.lit(None).cast("string")
    )
    added = accepted.select(
        F.lit(None).cast("long").alias("mapping_id"),
        "asset_id",
        "beneficiary_id",
        "share_percent",
        conditions.alias("conditions"),
    )
    done = _audit(
        accepted,
        actor,
        as_of,
        "INSERT",
        "WILL_ASSET_BENEFICIARIES",
        new=text.join_text(
            F.lit("Share of asset "),
            F.col("asset_id"),
            F.lit(" for beneficiary #"),
            F.col("beneficiary_id"),
        ),
    )
    failed = _refused(rejected, actor, as_of, "WILL_ASSET_BENEFICIARIES", "assign_shares")
    return {
        "shares": tables["shares"].unionByName(added, allowMissingColumns=True),
        "added": added,
        "audit": done.unionByName(failed),
        "rejected": rejected,
    }


# --- transfers -------------------------------------------------------------------------------


def transfer_assets(
    requests: DataFrame, tables: Tables, as_of: Column, actor: str
) -> Tables:
    """Start transfers on business days; the first of an Approved will makes it Executing."""
    low = rules.incomplete_assets(tables["assets"], tables["shares"], M.FULL_PERCENT)
    eligible = rules.check_transfers(
        requests,
        tables["assets"],
        tables["beneficiaries"],
        tables["shares"],
        tables["wills"],
        tables["transfers"],
        per_will=low,
    )
    # Eligibility, then the calendar, then the completeness of the will that starts executing.
    first = eligible.withColumnsRenamed({"reject_code": "__code", "reject_reason": "__reason"})
    dated = rules.check_business_day(first, tables["holidays"], as_of)
    short = (F.col("will_status") == "Approved") & (F.col("incomplete") > 0)
    reason = text.join_text(F.col("incomplete"), F.lit(" assets below 100 %"))
    code = F.coalesce("__code", "reject_code", F.when(short, -20020))
    # A reason goes with every code.
    words = F.coalesce("__reason", "reject_reason", F.when(short, reason))
    checked = dated.select(
        *requests.columns,
        "will_id",
        "will_status",
        code.alias("reject_code"),
        words.alias("reject_reason"),
    )
    accepted, rejected = split_checked(written(checked, "transfer-requests"))
    rejected = rejected.drop("will_status")
    flipped = accepted.where(F.col("will_status") == "Approved").select("will_id").distinct()
    when = F.coalesce("transfer_date", as_of)
    added = accepted.select(
        F.lit(None).cast("long").alias("transfer_id"),
        "asset_id",
        "beneficiary_id",
        when.alias("transfer_date"),
        F.lit(actor).alias("approved_by"),
        F.lit("Initiated").alias("transfer_status"),
        text.filled(M.TEXT_INITIATED, F.lit(actor), dates.date_time_text(when)).alias("notes"),
    )
    done = _audit(
        accepted,
        actor,
        as_of,
        "INSERT",
        "TRANSFER_LOGS",
        new=text.filled(M.TEXT_TRANSFER, F.col("asset_id"), F.col("beneficiary_id")),
    )
    failed = _refused(rejected, actor, as_of, "TRANSFER_LOGS", "transfer_assets")
    return {
        "transfers": tables["transfers"].unionByName(added, allowMissingColumns=True),
        "added": added,
        "wills": _set_status(tables["wills"], flipped, "Executing", as_of),
        "history": _history(
            flipped, F.lit("Approved"), F.lit("Executing"), actor, as_of, "transfer_assets"
        ),
        "audit": done.unionByName(failed),
        "rejected": rejected,
    }


# --- documents -------------------------------------------------------------------------------


def attach_documents(
    requests: DataFrame, tables: Tables, as_of: Column, actor: str
) -> Tables:
    checked = rules.check_documents(requests, tables["wills"], tables["assets"])
    accepted, rejected = split_checked(written(checked, "document-requests"))
    kind = text.normalise(F.col("related_entity"))
    path = text.document_path(
        F.col("related_entity"), F.col("entity_id"), F.col("title"), F.col("file_type")
    )
    kept = [c for c in requests.columns if c not in ("related_entity", "file_path")]
    done = _audit(
        accepted,
        actor,
        as_of,
        "INSERT",
        "DOCUMENTS",
        new=text.filled(M.TEXT_DOCUMENT, F.col("title"), kind, F.col("entity_id")),
    )
    failed = _refused(rejected, actor, as_of, "DOCUMENTS", "attach_documents")
    return {
        "documents": accepted.select(
            *kept,
            kind.alias("related_entity"),
            path.alias("file_path"),
            as_of.alias("upload_date"),
        ),
        "audit": done.unionByName(failed),
        "rejected": rejected,
    }


# --- executors -------------------------------------------------------------------------------


def set_primary_executors(
    requests: DataFrame, tables: Tables, as_of: Column, actor: str
) -> Tables:
    """The last valid request of a will names its primary executor; the others lose the mark."""
    executors = tables["executors"]
    checked = rules.check_primary_requests(requests, executors)
    accepted, rejected = split_checked(written(checked, "primary-requests"))
    chosen = accepted.groupBy("will_id").agg(
        F.max_by("executor_id", F.struct("seq", "executor_id")).alias("__chosen")
    )
    before = (
        executors.where(F.col("is_primary") == "Y")
        .groupBy("will_id")
        .agg(F.count(F.lit(1)).alias("__primaries"), F.min("executor_id").alias("__old"))
    )
    touched = chosen.join(before, "will_id", "left")
    # Executors of one will are few next to all executors, but one will may be hot.
    marked = judged_by_key(
        executors, ["will_id"], lambda keys: keys.join(touched, "will_id", "left")
    )
    mark = (
        F.when(F.col("__chosen").isNull(), F.col("is_primary"))
        .when(F.col("executor_id") == F.col("__chosen"), "Y")
        .when((F.col("is_primary") == "Y") | (F.col("__primaries") > 1), "N")
        .otherwise(F.col("is_primary"))
    )
    state = marked.select(
        *[mark.alias(c) if c == "is_primary" else F.col(c) for c in executors.columns]
    )
    several = F.coalesce(F.col("__primaries") > 1, F.lit(False))
    fixed = _audit(
        touched.where(several),
        actor,
        as_of,
        "DATA_FIX",
        "EXECUTORS",
        F.col("will_id"),
        text.join_text(F.lit("Several primary executors of will "), F.col("will_id")),
        F.lit(M.TEXT_RESET),
    )
    previous = F.when(
        F.col("__old").isNotNull() & ~several,
        text.filled(M.TEXT_PRIMARY_BEFORE, F.col("__old")),
    ).otherwise(M.TEXT_NO_PRIMARY)
    done = _audit(
        touched,
        actor,
        as_of,
        "UPDATE",
        "EXECUTORS",
        F.col("__chosen"),
        previous,
        text.filled(M.TEXT_PRIMARY, F.col("__chosen"), F.col("will_id")),
    )
    failed = _refused(
        rejected, actor, as_of, "EXECUTORS", "set_primary_executors", F.col("executor_id")
    )
    return {
        "executors": state,
        "audit": fixed.unionByName(done).unionByName(failed),
        "rejected": rejected,
    }


def add_executors(batch: DataFrame, executors: DataFrame) -> DataFrame:
    """New executors; the first one of a will that has none becomes primary."""
    order = F.struct("seq", "full_name")
    joined = judged_by_key(
        batch,
        ["will_id"],
        lambda keys: with_flag(keys, executors, ["will_id"], "__present"),
        F.min(order).alias("__first"),
    )
    first = ~F.col("__present") & (order == F.col("__first"))
    return joined.select(
        F.lit(None).cast("long").alias("executor_id"),
        "will_id",
        "full_name",
        "email",
        F.when(first, "Y").otherwise("N").alias("is_primary"),
    )


# --- users -----------------------------------------------------------------------------------


def backfill_roles(users: DataFrame) -> DataFrame:
    return users.fillna({"initial_role": "user"})


def update_roles(users: DataFrame, updates: DataFrame) -> DataFrame:
    """New roles by e-mail (seq, email, new_role); the last update of an e-mail wins."""
    latest = (
        updates.where(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.max_by("new_role", "seq").alias("__role"))
    )
    return attach(users, latest, ["email"]).select(
        *[
            F.coalesce("__role", "initial_role").alias(c) if c == "initial_role" else F.col(c)
            for c in users.columns
        ]
    )


def update_roles_in_parts(users: PartedTable, updates: DataFrame) -> DataFrame:
    """`update_roles` over a table in parts, of which those with named users are written anew."""
    named = matching(users.rows().select("user_id", "email"), updates, "email")
    users.rewrite(named, lambda rows: update_roles(rows, updates))
    return users.rows()


def diff_audit_by_digest(
    old: DataFrame, new: DataFrame, actor: str, as_of: Column, buckets: int = BUCKETS
) -> DataFrame:
    """`diff_audit` that moves digests, and then only wills of buckets in which something changed."""
    return diff_audit(*where_changed(old, new, "will_id", ["title", "status"], buckets), actor, as_of)
