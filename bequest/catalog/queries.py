"""Query name -> callable(spark, folder)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bequest import model as M
from bequest.catalog.shown import shown
from bequest.functions import dates, money, records, text
from bequest.operators import filters, joins, moves, ordered, rules, search
from bequest.plans import allocations, audit, dashboards, people, transfers, wills
from bequest.session import fresh_folder, written
from bequest.sources import by_day, tables, writers
from bequest.sources.parted import PartedTable
from bequest.sources.testbed import Testbed, change_columns, email_of
from bequest.streaming import jobs
from bequest.streaming.state import published

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

REPORT_DAY = "2001-08-01 00:00:00"
AUDIT_DAY = "2024-01-31 00:00:00"
PROFILE_DAY = "2025-06-11 00:00:00"
VIEWER = 7
PAGE = 3
ACTOR = "registrar"


def query(name: str):
    """Register a plan over the testbed; its result is shown in comparable types."""

    def add(plan: Callable[[Testbed], DataFrame]):
        CATALOG[name] = lambda spark, folder: shown(plan(Testbed(spark, folder)))
        return plan

    return add


# --- reports ---------------------------------------------------------------------------------


@query("q01_user_lookup")
def _(t):
    return people.user_lookup(t.users, t.beneficiaries)


@query("q02_primary_role")
def _(t):
    return people.primary_role(t.users, t.wills, t.executors, t.beneficiaries)


@query("q03_all_roles")
def _(t):
    return people.all_roles(t.users, t.wills, t.executors, t.beneficiaries)


@query("q04_testator_dashboard")
def _(t):
    return dashboards.testator_dashboard(t.users, t.wills, t.assets, t.shares)


@query("q05_executor_dashboard")
def _(t):
    return dashboards.executor_dashboard(t.executors, t.assets, t.transfers)


@query("q06_beneficiary_dashboard")
def _(t):
    return dashboards.beneficiary_dashboard(t.beneficiaries, t.shares, t.assets)


@query("q07_admin_totals")
def _(t):
    return dashboards.admin_totals(t.users, t.wills, t.assets, t.transfers)


@query("q08_will_list")
def _(t):
    return wills.will_list(t.wills, t.assets, t.executors)


@query("q09_executor_will_list")
def _(t):
    return wills.executor_will_list(t.wills, t.assets, t.executors)


@query("q10_will_detail")
def _(t):
    return wills.will_detail(t.wills, t.users)


@query("q11_will_visibility")
def _(t):
    return people.will_visibility(t.users, t.wills, t.executors)


@query("q11_may_view")
def _(t):
    asked = t.wills.select(F.col("user_id"), (F.col("will_id") + 1).alias("will_id"))
    return people.may_view(asked, people.will_visibility(t.users, t.wills, t.executors))


@query("q12_asset_allocation")
def _(t):
    return allocations.asset_allocation(t.assets, t.shares)


@query("q13_executors_ranked")
def _(t):
    return wills.executors_ranked(t.executors)


@query("q14_allocation_detail")
def _(t):
    return allocations.allocation_detail(t.assets, t.shares, t.beneficiaries)


@query("q15_remaining_percent")
def _(t):
    return allocations.remaining_percent(t.assets, t.shares)


@query("q16_current_allocations")
def _(t):
    return allocations.current_allocations(t.assets, t.shares, t.beneficiaries)


@query("q17_beneficiary_inheritance")
def _(t):
    return allocations.beneficiary_inheritance(t.beneficiaries, t.shares, t.assets)


@query("q18_transfer_report")
def _(t):
    return transfers.transfer_report(t.transfers, t.assets, t.beneficiaries, t.shares)


@query("q19_transfer_report_scoped")
def _(t):
    return transfers.transfer_report_scoped(
        t.transfers,
        t.assets,
        t.beneficiaries,
        t.shares,
        t.wills,
        t.executors,
        F.lit(VIEWER),
        email_of(F.lit(VIEWER)),
    )


@query("q19_viewer_transfer_totals")
def _(t):
    visible = people.will_visibility(t.users, t.wills, t.executors)
    return transfers.viewer_transfer_totals(
        t.transfers, t.assets, t.beneficiaries, t.shares, t.wills, visible
    )


@query("q20_eligible_beneficiaries")
def _(t):
    listed = allocations.eligible_beneficiaries(t.assets, t.shares, t.beneficiaries)
    return listed.select("asset_id", "name", "value", "asset_type", "beneficiary.*")


@query("q21_beneficiary_portfolio")
def _(t):
    return allocations.beneficiary_portfolio(
        t.shares, t.assets, t.beneficiaries, t.wills, t.transfers
    )


@query("q22_will_summary_exact")
def _(t):
    return wills.will_summary_stats(t.assets, t.shares, t.executors)


@query("q22_will_summary_as_written")
def _(t):
    return wills.will_summary_stats(t.assets, t.shares, t.executors, "as_written")


@query("q23_will_asset_allocations")
def _(t):
    return allocations.will_asset_allocations(t.assets, t.shares)


@query("q24_will_beneficiary_summary")
def _(t):
    return wills.will_beneficiary_summary(t.beneficiaries, t.shares, t.assets)


@query("q25_system_totals")
def _(t):
    return dashboards.system_totals(
        t.users, t.wills, t.assets, t.beneficiaries, t.executors, t.transfers
    )


@query("q26_will_status_distribution")
def _(t):
    return dashboards.will_status_distribution(t.wills)


@query("q27_recent_activity")
def _(t):
    return dashboards.recent_activity(
        t.wills, t.transfers, t.assets, t.beneficiaries, dates.moment(REPORT_DAY)
    )


@query("q28_audit_page")
def _(t):
    return audit.audit_page(t.audit, PAGE)


@query("q28_audit_page_facets")
def _(t):
    return audit.audit_page(
        t.audit, 1, action="UPDATE", table="WILLS", status="SUCCESS", day=date(2024, 1, 15)
    )


@query("q28_audit_next_page")
def _(t):
    last = (F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"), F.lit(1_000_000_000_000))
    return ordered.page_after(t.audit, "timestamp", "audit_id", last, M.PAGE_SIZE)


def _by_day(t: Testbed) -> DataFrame:
    folder = fresh_folder(t.spark, "audit-by-day")
    by_day.write_by_day(t.audit, folder)
    return by_day.read_by_day(t.spark, folder)


@query("q28_audit_page_indexed")
def _(t):
    stored, folder = _by_day(t), fresh_folder(t.spark, "audit-pages")
    by_day.write_page_index(stored, folder)
    return by_day.indexed_page(stored, t.spark.read.parquet(folder), PAGE)


@query("q28_audit_page_facets_by_day")
def _(t):
    wanted = by_day.one_day(_by_day(t), date(2024, 1, 15))
    return audit.audit_page(wanted, 1, action="UPDATE", table="WILLS", status="SUCCESS", day=date(2024, 1, 15))


@query("q29_user_activity")
def _(t):
    return people.user_activity(t.users, t.wills, t.executors, t.beneficiaries)


@query("q30_role_counts")
def _(t):
    return people.role_counts(t.users)


@query("q31_will_stats_exact")
def _(t):
    return wills.will_stats(t.assets, t.shares)


@query("q31_will_stats_as_written")
def _(t):
    return wills.will_stats(t.assets, t.shares, "as_written")


@query("q32_beneficiary_assets")
def _(t):
    return allocations.beneficiary_assets(t.shares, t.assets)


@query("q33_calendar_status")
def _(t):
    days = t.table("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return audit.calendar_status(days)


@query("q34_executor_counts")
def _(t):
    return wills.executor_counts(t.wills, t.executors)


@query("q35_will_executors")
def _(t):
    return wills.will_executors(t.wills, t.executors)


@query("q36_wills_with_testator")
def _(t):
    return wills.wills_with_testator(t.wills, t.users)


@query("q37_allocation_listing")
def _(t):
    return allocations.allocation_listing(t.shares, t.assets, t.beneficiaries)


@query("q38_will_value")
def _(t):
    return wills.will_value(t.wills, t.assets)


@query("q39_audit_trail")
def _(t):
    return audit.audit_trail(t.audit, dates.moment(AUDIT_DAY))


@query("q39_audit_trail_by_day")
def _(t):
    day = dates.moment(AUDIT_DAY)
    return audit.audit_trail(by_day.recent_days(_by_day(t), day, M.AUDIT_DAYS), day)


@query("q40_audit_action_counts_by_day")
def _(t):
    day = dates.moment(AUDIT_DAY)
    return audit.audit_action_counts(by_day.recent_days(_by_day(t), day, M.AUDIT_DAYS), day)


@query("q40_audit_action_counts")
def _(t):
    return audit.audit_action_counts(t.audit, dates.moment(AUDIT_DAY))


@query("q40_audit_status_counts")
def _(t):
    return audit.audit_status_counts(t.audit)


@query("q41_transfer_totals")
def _(t):
    report = transfers.transfer_report(t.transfers, t.assets, t.beneficiaries, t.shares)
    return transfers.transfer_totals(report)


@query("q42_portfolio_totals")
def _(t):
    return allocations.portfolio_totals(
        allocations.beneficiary_portfolio(
            t.shares, t.assets, t.beneficiaries, t.wills, t.transfers
        )
    )


@query("q43_allocation_bands")
def _(t):
    return allocations.allocation_bands(t.assets, t.shares)


def _listing(name: str, table: str, *columns: str) -> None:
    @query(f"q44_{name}")
    def _(t):
        return getattr(t, table).select(*columns).orderBy(columns[0])


_listing("users", "users", "user_id", "full_name", "email")
_listing("wills", "wills", "will_id", "title", "status", "user_id")
_listing("assets", "assets", "asset_id", "will_id", "name", "asset_type", "value")
_listing("beneficiaries", "beneficiaries", "beneficiary_id", "full_name", "relation", "email")
_listing("executors", "executors", "executor_id", "will_id", "full_name", "email", "is_primary")


# --- building blocks -------------------------------------------------------------------------


@query("s2_one_row")
def _(t):
    # The one-row source carries the bind values of a scan over all wills.
    bind = tables.one_row(t.spark, wanted="Draft")
    total = t.wills.where(F.col("status") == bind.scalar())
    return tables.count_rows(total, "drafts")


@query("s3_literal_rows")
def _(t):
    marked = t.requests.select("transfer_date").withColumn(
        "holiday_date", F.to_date("transfer_date")
    )
    hits = marked.join(t.holidays, "holiday_date")
    return hits.groupBy("holiday_date", "description", "is_recurring").agg(
        F.count(F.lit(1)).alias("requests")
    )


@query("s4_append_accepted")
def _(t):
    folder = fresh_folder(t.spark, "accepted-users")
    writers.append_accepted(rules.check_new_users(t.signups, t.users), folder)
    return t.spark.read.parquet(folder)


@query("s5_json_rows")
def _(t):
    heirs = allocations.beneficiary_assets(t.shares, t.assets)
    return writers.as_json(
        heirs.select(
            "beneficiary_id", "asset_id", "name", "asset_type",
            F.col("share_percent").cast("string").alias("share_percent"),
        )
    )


@query("s6_csv_export")
def _(t):
    folder = fresh_folder(t.spark, "audit-csv")
    exported = t.audit
    writers.write_csv(exported, folder)
    schema = exported.schema
    return t.spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder)


@query("p13_facet_filter")
def _(t):
    return filters.facets(t.audit, action="DELETE", status="ERROR", user="user8").select(
        "audit_id", "action", "status", "user_name"
    )


@query("p14_text_search")
def _(t):
    return filters.search(t.users, "STREET, kig", "full_name", "email", "address").select(
        "user_id", "address"
    )


@query("p14_text_search_indexed")
def _(t):
    shown_columns, folder = ("full_name", "email", "address"), fresh_folder(t.spark, "search")
    search.write_search_table(t.users, "user_id", list(shown_columns), folder)
    return search.search_indexed(t.users, "user_id", "STREET, kig", folder, *shown_columns).select(
        "user_id", "address"
    )


@query("p15_transfer_tabs")
def _(t):
    tabs = ("pending", "completed", "all")
    counted = t.transfers.agg(*(F.count_if(filters.in_tab(tab)).alias(tab) for tab in tabs))
    return counted.unpivot([], list(tabs), "tab", "rows")


@query("p6_in_and_not_in")
def _(t):
    movable = F.col("status").isin(*M.TRANSFERABLE_STATUSES)
    return t.wills.groupBy(movable.alias("transferable")).agg(F.count(F.lit(1)).alias("wills"))


@query("p10_case_and_default")
def _(t):
    role = F.coalesce("initial_role", F.lit("user"))
    rank = F.when(role == "admin", 1).when(role.isin("testator", "executor"), 2).otherwise(3)
    return t.users.select("user_id", role.alias("role"), rank.alias("rank"))


@query("p12_inequality")
def _(t):
    # A NULL role is not unequal to anything.
    return t.users.where(F.col("initial_role") != "admin").select("user_id", "initial_role")


@query("p5_or_filter")
def _(t):
    return t.documents.where(
        (F.col("related_entity") == "ASSET") | (F.col("file_type") == "EXE")
    ).select("document_id", "related_entity", "file_type")


@query("p3_bound_parameter")
def _(t):
    wanted = t.spark.sql(
        "SELECT will_id, title FROM {w} WHERE status = :status AND user_id >= :low",
        args={"status": "Approved", "low": 10},
        w=t.wills,
    )
    return wanted


@query("j6_semi_join")
def _(t):
    return joins.matching(t.shares, t.transfers, "asset_id").select("mapping_id")


@query("j8_anti_join")
def _(t):
    return joins.missing(t.wills, t.assets, "will_id").select("will_id", "status")


@query("j9_scalar_per_row")
def _(t):
    t.wills.createOrReplaceTempView("bequest_wills")
    t.assets.createOrReplaceTempView("bequest_assets")
    return t.spark.sql(
        "SELECT w.will_id, (SELECT max(a.value) FROM bequest_assets a "
        "WHERE a.will_id = w.will_id) AS top_value FROM bequest_wills w"
    )


@query("o4_distinct_rows")
def _(t):
    return t.executors.select("email", "is_primary").distinct()


@query("o5_first_row")
def _(t):
    # The pair with the smallest mapping id, whichever order the rows arrive in.
    first = F.min_by(F.struct("asset_id", "beneficiary_id"), "mapping_id")
    return t.shares.agg(first.alias("pair")).select("pair.*")


@query("o6_display_sort")
def _(t):
    number = text.number_in_text(F.col("phone_number"))
    return (
        t.users.select("user_id", "phone_number", number.alias("number"))
        .orderBy(*ordered.display_order(F.col("phone_number"), F.col("number")), "user_id")
    )


@query("c_text")
def _(t):
    d = t.documents
    return d.select(
        "document_id",
        text.normalise(F.col("related_entity")).alias("entity"),
        text.document_path(
            F.col("related_entity"), F.col("entity_id"), F.col("title"), F.col("file_type")
        ).alias("path"),
        text.join_text(F.col("title"), F.lit(" is "), F.nullif("file_type", F.lit("EXE"))).alias(
            "joined"
        ),
        text.tail_after(F.col("title"), " ").alias("tail"),
    )


@query("c_shorten")
def _(t):
    return t.table("documents").select(
        F.col("doc_id"),
        text.shorten(F.col("text")).alias("short"),
        F.length("text").alias("long"),
    )


@query("c_users")
def _(t):
    as_of = dates.moment(PROFILE_DAY)
    return t.users.select(
        "user_id",
        text.title_case(F.coalesce("initial_role", F.lit("no_role"))).alias("role_title"),
        text.phone_digits(F.col("phone_number")).alias("digits"),
        text.is_phone(F.col("phone_number")).alias("phone_ok"),
        text.is_email(F.col("email")).alias("email_ok"),
        text.number_in_text(F.col("full_name")).alias("number"),
        dates.full_years(F.col("date_of_birth"), as_of).alias("age"),
        F.length("address").alias("address_length"),
    )


@query("c_dates")
def _(t):
    c = F.col("transfer_date")
    return t.transfers.select(
        "transfer_id",
        dates.day_number(c).alias("day_number"),
        dates.day_name(c).alias("day_name"),
        dates.month_day(c).alias("month_day"),
        dates.date_text(c).alias("date_text"),
        dates.date_time_text(c).alias("date_time"),
        dates.short_date(c).alias("short_date"),
        dates.slash_date(c).alias("slash_date"),
        dates.clock_text(c).alias("clock"),
        F.to_date(c).alias("day"),
        dates.days_before(c, 10).alias("ten_before"),
        dates.is_late_weekday(c).alias("weekend"),
        dates.parse_day(F.date_format(c, "yyyy-MM-dd")).alias("parsed"),
        dates.parse_day(F.date_format(c, "dd/MM")).alias("unparsed"),
    )


@query("c_money")
def _(t):
    percent = money.zero_if_null(F.col("allocated_percent"))
    rows = allocations.asset_allocation(t.assets, t.shares)
    return rows.select(
        "asset_id",
        money.remaining(percent).alias("remaining"),
        money.clamp_percent(percent).alias("clamped"),
        money.band(percent).alias("band"),
        F.bround(percent, 1).alias("one_decimal"),
        money.amount_text(F.col("value")).alias("amount"),
        money.currency_text(F.floor("value").cast("decimal(15,2)")).alias("francs"),
        F.floor("value").cast("string").alias("whole_text"),
        F.floor("value").cast("string").try_cast("long").alias("whole"),
    )


@query("c_roles")
def _(t):
    roles = people.all_roles(t.users, t.wills, t.executors, t.beneficiaries)
    c = F.col("roles")
    return roles.select(
        "user_id",
        F.size(c).alias("how_many"),
        records.has_any_role(c, ["executor", "admin"]).alias("may_transfer"),
        F.array_contains(c, "testator").alias("is_testator"),
        F.element_at(c, 1).alias("first_role"),
    )


@query("c_json")
def _(t):
    mixed = F.when(F.col("audit_id") % 3 == 0, F.lit("plain text")).when(
        F.col("audit_id") % 3 == 1, F.lit("{broken")
    ).otherwise(F.col("new_values"))
    return t.audit.select(
        "audit_id",
        records.display_value(mixed).alias("new_shown"),
        records.display_value(F.col("old_values")).alias("old_shown"),
        records.json_field(mixed, "k").alias("k"),
        records.json_text(user=F.col("user_name"), old=F.col("old_values")).alias("built"),
    )


# --- validators ------------------------------------------------------------------------------


@query("r01_email")
def _(t):
    return rules.check_email(t.users).select(
        "user_id", "email", "reject_code", "reject_reason"
    )


@query("r02_new_users")
def _(t):
    return rules.check_new_users(t.signups, t.users)


@query("r03_assignments")
def _(t):
    return rules.check_assignments(
        t.requests, t.assets, t.wills, t.beneficiaries, t.shares
    )


@query("r03_share_rows")
def _(t):
    raised = t.shares.withColumn(
        "share_percent", (F.col("share_percent") + 1).cast(M.TOTAL)
    )
    return rules.check_share_rows(raised, t.assets, t.wills, t.shares)


@query("r04_allocation_approve")
def _(t):
    return rules.check_allocation(
        t.wills, t.assets, t.shares, M.APPROVE_PERCENT, -20095
    ).select("will_id", "incomplete", "reject_code")


@query("r04_allocation_execute")
def _(t):
    return rules.check_allocation(
        t.wills, t.assets, t.shares, M.FULL_PERCENT, -20020
    ).select("will_id", "incomplete", "reject_code", "reject_reason")


@query("r05_approvals")
def _(t):
    return rules.check_approvals(t.approvals, t.wills, t.executors, t.assets, t.shares)


@query("r06_transfers")
def _(t):
    return rules.check_transfers(
        t.requests, t.assets, t.beneficiaries, t.shares, t.wills, t.transfers
    )


@query("r07_business_day")
def _(t):
    return rules.check_business_day(t.requests, t.holidays, dates.moment(REPORT_DAY))


@query("r08_status_moves")
def _(t):
    # The stored status against the one each change asks for.
    moves_ = t.changes.join(
        t.wills.select("will_id", F.col("status").alias("old_status")), "will_id"
    )
    return rules.check_status_moves(moves_.select("seq", "old_status", "new_status"))


@query("r09_primary")
def _(t):
    return rules.check_primary(t.executors, t.executors).select(
        "executor_id", "is_primary", "reject_code"
    )


@query("r09_primary_in_batch")
def _(t):
    arrivals = t.executors.select(
        (F.col("executor_id") + 4).alias("executor_id"), "will_id", F.lit("Y").alias("is_primary")
    )
    return rules.check_primary(arrivals, t.executors).select(
        "executor_id", "is_primary", "reject_code"
    )


@query("r10_documents")
def _(t):
    return rules.check_documents(t.documents, t.wills, t.assets)


@query("r11_deletions")
def _(t):
    return rules.check_deletions(t.deletions, t.wills)


@query("r11_deletions_unprotected")
def _(t):
    return rules.check_deletions(t.deletions, t.wills, enforce_protection=False)


@query("r12_domains")
def _(t):
    parts = [
        rules.check_domain(t.users, "initial_role", M.INITIAL_ROLES),
        rules.check_domain(t.transfers, "transfer_status", M.TRANSFER_STATUSES),
        rules.check_domain(t.documents, "related_entity", M.DOCUMENT_ENTITIES),
        rules.check_domain(t.documents, "file_type", M.FILE_TYPES),
        rules.check_domain(t.assets, "asset_type", M.ASSET_TYPES),
        rules.check_domain(t.wills, "status", M.WILL_STATUSES),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("r13_orphan_shares")
def _(t):
    return rules.orphan_shares(t.share_changes, t.assets)


@query("r14_asset_forms")
def _(t):
    return rules.check_asset_forms(t.asset_forms)


@query("r14_beneficiary_forms")
def _(t):
    return rules.check_required(t.person_forms, "full_name", "relation")


@query("r14_executor_forms")
def _(t):
    return rules.check_required(t.person_forms, "full_name", "email")


@query("r14_will_forms")
def _(t):
    return rules.check_required(t.will_forms, "title")


@query("r15_explain")
def _(t):
    checked = rules.check_business_day(t.requests, t.holidays, dates.moment(REPORT_DAY))
    _, rejected = rules.split_checked(checked)
    return rules.explain(rejected.select("seq", "asset_id", "reject_code", "reject_reason"))


@query("r15_explain_approvals")
def _(t):
    checked = rules.check_approvals(t.approvals, t.wills, t.executors, t.assets, t.shares)
    _, rejected = rules.split_checked(checked)
    return rules.explain(rejected)


@query("r16_primary_requests")
def _(t):
    return rules.check_primary_requests(t.primary_requests, t.executors)


@query("r17_profile")
def _(t):
    return rules.check_profile(t.users, dates.moment(PROFILE_DAY)).select(
        "user_id", "reject_code", "reject_reason"
    )


# --- transitions -----------------------------------------------------------------------------


def _moved(name: str, outputs: tuple[str, ...], run: Callable[[Testbed], dict]) -> None:
    for output in outputs:
        CATALOG[f"{name}_{output}"] = lambda spark, folder, output=output: shown(
            run(Testbed(spark, folder))[output]
        )


def _tables(t: Testbed) -> dict[str, DataFrame]:
    names = ("wills", "assets", "executors", "beneficiaries", "shares", "transfers", "holidays")
    found = {n: getattr(t, n) for n in names}
    # Stored documents carry the normalised entity name.
    found["documents"] = t.documents.withColumn(
        "related_entity", text.normalise(F.col("related_entity"))
    )
    found["history"] = t.changes.select(
        "will_id", F.col("new_status"), F.col("change_date"), "seq"
    )
    return found


def _approve(t: Testbed) -> dict:
    return moves.approve_wills(t.approvals, _tables(t), dates.moment(REPORT_DAY), ACTOR)


def _assign(t: Testbed) -> dict:
    requests = t.requests.drop("transfer_date")
    found = _tables(t)
    # Deriving them takes four shuffles, and the transition reads them twice.
    found["shares"] = written(found["shares"], "stored-shares")
    return moves.assign_shares(requests, found, dates.moment(REPORT_DAY), ACTOR)


def _transfer(t: Testbed) -> dict:
    requests = t.requests.drop("share_percent")
    return moves.transfer_assets(requests, _tables(t), dates.moment(REPORT_DAY), ACTOR)


def _attach(t: Testbed) -> dict:
    return moves.attach_documents(t.documents, _tables(t), dates.moment(REPORT_DAY), ACTOR)


def _set_primary(t: Testbed) -> dict:
    return moves.set_primary_executors(
        t.primary_requests, _tables(t), dates.moment(REPORT_DAY), ACTOR
    )


def _delete(t: Testbed) -> dict:
    return moves.delete_wills(
        t.deletions, _tables(t), dates.moment(REPORT_DAY), ACTOR, enforce_protection=False
    )


def _delete_rows(t: Testbed) -> dict:
    return moves.delete_wills(
        t.deletions,
        _tables(t),
        dates.moment(REPORT_DAY),
        ACTOR,
        enforce_protection=False,
        counts=False,
    )


def _replay(t: Testbed) -> dict:
    return moves.status_history(t.changes, ACTOR)


_moved("m01_approve", ("wills", "history", "audit", "rejected"), _approve)
_moved("m02_assign", ("added", "shares", "audit", "rejected"), _assign)
_moved("m03_transfer", ("added", "wills", "history", "audit", "rejected"), _transfer)
_moved("m04_attach", ("documents", "audit", "rejected"), _attach)
_moved("m05_primary", ("executors", "audit", "rejected"), _set_primary)
_moved(
    "m06_delete",
    (
        "wills",
        "assets",
        "executors",
        "shares",
        "transfers",
        "documents",
        "history",
        "rejected",
    ),
    _delete_rows,
)
_moved("m06_delete", ("deleted_counts", "audit"), _delete)
_moved("m09_history", ("history", "rejected", "state"), _replay)


@query("m07_touch_wills")
def _(t):
    asset_changes = t.table("lineitem").select(
        F.col("l_orderkey").alias("will_id"), F.col("l_shipdate").alias("changed_at")
    )
    executor_changes = t.changes.select("will_id", F.col("change_date").alias("changed_at"))
    changes = moves.will_changes(asset_changes, executor_changes, t.share_changes, t.assets)
    return moves.touch_wills(t.wills, changes)


@query("m08_diff_audit")
def _(t):
    return moves.diff_audit(t.wills, t.revised_wills, ACTOR, dates.moment(REPORT_DAY))


@query("m08_diff_audit_by_digest")
def _(t):
    return moves.diff_audit_by_digest(t.wills, t.revised_wills, ACTOR, dates.moment(REPORT_DAY))


#: Keys of a part of the stored tables.
PART_KEYS = 4096


def _parted(t: Testbed, rows: DataFrame, key: str) -> PartedTable:
    return PartedTable(t.spark, fresh_folder(t.spark, "parts"), key, PART_KEYS).create(rows)


@query("m01_approve_wills_in_parts")
def _(t):
    stored = _parted(t, t.wills, "will_id")
    return moves.approve_in_parts(t.approvals, stored, _tables(t), dates.moment(REPORT_DAY), ACTOR)["wills"]


@query("m10_add_executors")
def _(t):
    return moves.add_executors(t.new_executors, t.executors).drop("executor_id")


@query("m11_backfill_roles")
def _(t):
    return moves.backfill_roles(t.users).select("user_id", "initial_role")


@query("m12_update_roles")
def _(t):
    return moves.update_roles(t.users, t.role_updates).select("user_id", "initial_role")


@query("m12_update_roles_in_parts")
def _(t):
    stored = _parted(t, t.users, "user_id")
    return moves.update_roles_in_parts(stored, t.role_updates).select("user_id", "initial_role")


# --- streams ---------------------------------------------------------------------------------


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    return fresh_folder(spark, name), fresh_folder(spark, f"{name}-checkpoint")


def _streamed(t: Testbed, table: str) -> DataFrame:
    return jobs.stream_table(t.spark, t.folder, table)


class _Stream(Testbed):
    """The testbed with one table read as a stream."""

    def __init__(self, spark: SparkSession, folder: str, streamed: str):
        super().__init__(spark, folder)
        self.streamed = streamed

    def table(self, name: str) -> DataFrame:
        if name == self.streamed:
            return jobs.stream_table(self.spark, self.folder, name)
        return super().table(name)


def _gate(t: Testbed) -> str:
    out, checkpoint = _folders(t.spark, "gate")
    requests = _Stream(t.spark, t.folder, "lineitem").requests
    jobs.start_transfer_gate(
        requests, t.holidays, REPORT_DAY, out, checkpoint
    ).awaitTermination()
    return out


@query("t01_gate_accepted")
def _(t):
    return t.spark.read.parquet(f"{_gate(t)}/accepted").drop("batch")


@query("t01_gate_rejected")
def _(t):
    return t.spark.read.parquet(f"{_gate(t)}/rejected").drop("batch")


@query("t02_activity_per_day")
def _(t):
    out, checkpoint = _folders(t.spark, "activity")
    stream = _Stream(t.spark, t.folder, "events").audit
    jobs.start_activity(stream, out, checkpoint, mode="complete").awaitTermination()
    return published(t.spark, out).withColumn("day", F.col("day").cast("date"))


def _machine(t: Testbed) -> str:
    out, checkpoint = _folders(t.spark, "machine")
    changes = _streamed(t, "events").select(*change_columns())
    jobs.start_status_machine(changes, ACTOR, out, checkpoint).awaitTermination()
    return out


@query("t03_machine_history")
def _(t):
    return t.spark.read.parquet(f"{_machine(t)}/history").drop("batch")


@query("t03_machine_rejected")
def _(t):
    return t.spark.read.parquet(f"{_machine(t)}/rejected").drop("batch")


@query("t04_share_guard")
def _(t):
    out, checkpoint = _folders(t.spark, "guard")
    requests = _Stream(t.spark, t.folder, "lineitem").requests.drop("transfer_date")
    jobs.start_share_guard(
        requests, t.assets, t.wills, t.beneficiaries, t.shares, out, checkpoint
    ).awaitTermination()
    return t.spark.read.parquet(f"{out}/accepted").drop("batch")


@query("t05_repeat_filter")
def _(t):
    out, checkpoint = _folders(t.spark, "repeats")
    requests = _Stream(t.spark, t.folder, "lineitem").requests
    completed = t.transfers.where(F.col("transfer_status") == "Completed").select(*jobs.PAIR)
    arrived = fresh_folder(t.spark, "completions")
    completed.write.parquet(arrived)
    done = t.spark.readStream.schema(completed.schema).parquet(arrived)
    jobs.start_repeat_filter(requests, done, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


def _live(t: Testbed, **figures: jobs.Figure) -> DataFrame:
    out, checkpoint = _folders(t.spark, "totals")
    jobs.start_live_totals(figures, out, checkpoint).awaitTermination()
    return published(t.spark, f"{out}/total")


def _live_figures(t: Testbed) -> dict[str, jobs.Figure]:
    line = ["l_orderkey", "l_linenumber"]
    lines = _streamed(t, "lineitem")
    orders = t.table("orders").where(F.col("o_orderstatus") != "O")
    moved = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return {
        "total_users": jobs.Figure(_streamed(t, "customer")),
        "total_wills": jobs.Figure(_streamed(t, "orders")),
        "total_assets": jobs.Figure(lines, line, F.col("l_extendedprice").cast(M.MONEY)),
        "total_transfers": jobs.Figure(moved, line + ["l_suppkey"]),
    }


@query("t06_live_totals")
def _(t):
    return _live(t, **_live_figures(t)).select("name", "total")


@query("t06_live_system_totals")
def _(t):
    executors = _streamed(t, "orders").select((F.col("o_orderkey") % 4).alias("many"))
    more = {
        "total_beneficiaries": jobs.Figure(_streamed(t, "supplier")),
        "total_executors": jobs.Figure(executors, change=F.col("many")),
    }
    found = _live(t, **_live_figures(t), **more)
    return found.select("name", "total", F.col("amount").cast("double").alias("amount"))
