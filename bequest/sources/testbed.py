"""Estate tables derived from the generated star-schema tables.

Each property is a lazy DataFrame, so a report that needs three columns of one table reads
just those.  Repeated (order, line) pairs of `lineitem` make assets with several shares.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bequest.model import MONEY, TOTAL
from bequest.operators.joins import attach
from bequest.session import tune
from bequest.sources.tables import literal_rows, scan, stored_bytes

HOLIDAYS = (
    (date(2025, 1, 1), "New Year", "Y"),
    (date(2025, 4, 7), "Memorial Day", "Y"),
    (date(2025, 7, 1), "Independence Day", "Y"),
    (date(2025, 12, 25), "Christmas", "Y"),
    (date(1998, 5, 5), "One-off Holiday", "N"),
)


def email_of(key: Column) -> Column:
    padded = F.lpad(key.cast("string"), 9, "0")
    return F.concat(F.lit("customer"), padded, F.lit("@example.rw"))


def asset_key() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def request_seq() -> Column:
    """Order of the requests of one will."""
    day = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date"))
    return (F.col("l_partkey") * 4096 + day) * 10 + F.col("l_linenumber")


class Testbed:
    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark, stored_bytes(spark, folder, "lineitem", "orders"))
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, self.folder, name)

    @property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        email = F.when(
            key % 17 == 0, F.concat(F.lit("customer"), F.lpad(key.cast("string"), 9, "0"))
        ).otherwise(email_of(key))
        segment = F.col("c_mktsegment")
        role = (
            F.when(segment == "BUILDING", "testator")
            .when(segment == "AUTOMOBILE", "executor")
            .when(segment == "MACHINERY", "beneficiary")
            .when(segment == "FURNITURE", "admin")
            .when((segment == "HOUSEHOLD") & (key % 2 == 0), "user")
        )
        phone = F.when(key % 13 == 0, "12345").otherwise(
            F.concat(F.lit("+250 78"), F.lpad(key.cast("string"), 7, "0"))
        )
        return self.table("customer").select(
            key.alias("user_id"),
            F.col("c_name").alias("full_name"),
            email.alias("email"),
            phone.alias("phone_number"),
            F.date_add(F.lit("1960-01-01").cast("date"), (key * 37 % 20000).cast("int")).alias(
                "date_of_birth"
            ),
            F.when(key % 19 == 0, "Kigali")
            .otherwise(F.concat(segment, F.lit(" Street, Kigali")))
            .alias("address"),
            role.alias("initial_role"),
            F.date_add(F.lit("1995-01-01").cast("date"), (key % 2000).cast("int"))
            .cast("timestamp_ntz")
            .alias("created_at"),
        )

    @property
    def wills(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = (
            F.when(F.col("o_orderstatus") == "F", "Executed")
            .when(F.col("o_orderstatus") == "O", "Draft")
            .when(key % 2 == 0, "Approved")
            .otherwise("Executing")
        )
        return self.table("orders").select(
            key.alias("will_id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("Will "), key.cast("string")).alias("title"),
            F.col("o_orderpriority").alias("description"),
            status.alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("last_updated_at"),
        )

    @property
    def assets(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey", "l_linenumber")
        kinds = F.array(
            *[
                F.lit(k)
                for k in (
                    "Real Estate",
                    "Financial",
                    "Vehicle",
                    "Personal",
                    "Business",
                    "Investment",
                    "Other",
                )
            ]
        )
        return lines.agg(
            F.min("l_partkey").alias("part"),
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast(TOTAL).alias("value"),
        ).select(
            asset_key().alias("asset_id"),
            F.col("l_orderkey").alias("will_id"),
            F.concat(F.lit("Asset "), asset_key().cast("string")).alias("name"),
            F.element_at(kinds, (F.col("part") % 7 + 1).cast("int")).alias("asset_type"),
            "value",
        )

    @property
    def beneficiaries(self) -> DataFrame:
        kinds = F.array(
            *[
                F.lit(k)
                for k in ("Spouse", "Child", "Parent", "Sibling", "Friend", "Charity", "Other")
            ]
        )
        return self.table("supplier").select(
            F.col("s_suppkey").alias("beneficiary_id"),
            F.col("s_name").alias("full_name"),
            F.element_at(kinds, F.col("s_nationkey") % 7 + 1).alias("relation"),
            email_of(F.col("s_suppkey") * 3).alias("email"),
        )

    @property
    def executors(self) -> DataFrame:
        key = F.col("o_orderkey")
        many = (key % 4).cast("int")
        rows = (
            self.table("orders")
            .where(many > 0)
            .select(key, "o_custkey", F.explode(F.sequence(F.lit(0), many - 1)).alias("i"))
        )
        i = F.col("i")
        person = (F.col("o_custkey") * 7 + i) % 100
        primary = ((i == 0) & (key % 8 != 5)) | ((i == 1) & (key % 32 == 3))
        return rows.select(
            (key * 10 + i).alias("executor_id"),
            key.alias("will_id"),
            F.concat(F.lit("Executor "), person.cast("string")).alias("full_name"),
            email_of(person).alias("email"),
            F.when(primary, "Y").otherwise("N").alias("is_primary"),
        )

    @property
    def shares(self) -> DataFrame:
        """Pre-aggregated per (asset, beneficiary) before the per-asset count is attached.

        Every asset has a count; as a left join it drops out where percents are not needed.
        """
        parts = (
            self.table("lineitem")
            .groupBy(asset_key().alias("asset_id"), F.col("l_suppkey").alias("beneficiary_id"))
            .agg(
                F.min("l_orderkey").alias("will_id"),
                F.count(F.lit(1)).alias("rows"),
                F.sum((F.col("l_quantity") * 2).cast("decimal(5,2)")).alias("loose"),
            )
        )
        sizes = (
            self.table("lineitem")
            .groupBy(asset_key().alias("asset_id"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        even = F.round(F.lit(100.0) / F.col("n"), 2).cast("decimal(5,2)") * F.col("rows").cast(
            "decimal(18,0)"
        )
        percent = F.when(F.col("will_id") % 5 < 3, even).otherwise(F.col("loose"))
        return attach(parts, sizes, ["asset_id"]).select(
            (F.col("asset_id") * 100000 + F.col("beneficiary_id")).alias("mapping_id"),
            "asset_id",
            "beneficiary_id",
            percent.cast(TOTAL).alias("share_percent"),
        )

    @property
    def transfers(self) -> DataFrame:
        """Of all lines whose order is not open; the shares of open orders are not transferred."""
        orders = self.table("orders").where(F.col("o_orderstatus") != "O").select("o_orderkey")
        grouped = (
            self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
            .groupBy("l_orderkey", "l_linenumber", "l_suppkey")
            .agg(
                F.max("l_shipdate").alias("transfer_date"),
                F.max("l_linestatus").alias("line"),
                F.max("l_returnflag").alias("flag"),
            )
        )
        status = (
            F.when(F.col("line") == "O", "Initiated")
            .when(F.col("flag") == "A", "Failed")
            .otherwise("Completed")
        )
        return grouped.select(
            (asset_key() * 100000 + F.col("l_suppkey")).alias("transfer_id"),
            asset_key().alias("asset_id"),
            F.col("l_suppkey").alias("beneficiary_id"),
            "transfer_date",
            F.concat(F.lit("clerk"), (F.col("l_orderkey") % 10).cast("string")).alias(
                "approved_by"
            ),
            status.alias("transfer_status"),
        )

    @property
    def requests(self) -> DataFrame:
        """Transfer and share requests; every tenth part number names another beneficiary."""
        other = F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)
        return self.table("lineitem").select(
            request_seq().alias("seq"),
            asset_key().alias("asset_id"),
            (F.col("l_suppkey") + other).alias("beneficiary_id"),
            F.col("l_shipdate").alias("transfer_date"),
            (F.col("l_quantity") * 2).cast("decimal(7,2)").alias("share_percent"),
        )

    @property
    def documents(self) -> DataFrame:
        key = F.col("doc_id")
        slot = key % 8
        entity = (
            F.when(slot == 3, "PERSON")
            .when(slot == 1, " asset ")
            .when(slot == 5, "ASSET")
            .when(slot == 7, "will")
            .otherwise("WILL")
        )
        lang = F.col("lang")
        kind = (
            F.when(lang == "en", "PDF")
            .when(lang == "fr", "DOC")
            .when(lang == "de", "JPG")
            .when(lang == "es", "EXE")
            .otherwise("TXT")
        )
        return self.table("documents").select(
            key.alias("document_id"),
            entity.alias("related_entity"),
            F.when(slot.isin(1, 5), key * 10 + key % 9).otherwise(key * 17).alias("entity_id"),
            F.concat(F.lit("Document "), key.cast("string")).alias("title"),
            kind.alias("file_type"),
        )

    @property
    def holidays(self) -> DataFrame:
        return literal_rows(self.spark, HOLIDAYS, "holidays")

    @property
    def audit(self) -> DataFrame:
        kind = F.col("event_type")
        action = (
            F.when(kind == "signup", "INSERT")
            .when(kind == "click", "UPDATE")
            .when(kind == "error", "DELETE")
            .when(kind == "purchase", "PROCEDURE")
            .otherwise("DELETE_ATTEMPT")
        )
        slot = F.col("event_id") % 5
        table = (
            F.when(slot == 0, "WILLS")
            .when(slot == 1, "ASSETS")
            .when(slot == 2, "USERS")
            .when(slot == 3, "TRANSFER_LOGS")
            .otherwise("DOCUMENTS")
        )
        return self.table("events").select(
            F.col("event_id").alias("audit_id"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"),
            action.alias("action"),
            table.alias("action_table"),
            F.col("user_id").alias("record_id"),
            F.lit(None).cast("string").alias("old_values"),
            F.col("props").alias("new_values"),
            F.col("ts").alias("timestamp"),
            F.when(kind == "error", "ERROR")
            .when(F.col("value") < 5, "WARNING")
            .otherwise("SUCCESS")
            .alias("status"),
        )

    @property
    def changes(self) -> DataFrame:
        return self.table("events").select(*change_columns())

    # --- batches fed to the validators and transitions -----------------------------------

    @property
    def signups(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("seq"),
            F.when(key % 23 == 0, "  ").otherwise(F.col("c_name")).alias("full_name"),
            F.when(key % 2 == 0, email_of(key))
            .otherwise(email_of(F.lit(10000000) + F.floor(key / 4)))
            .alias("email"),
            F.when(key % 29 == 0, "guest").otherwise("testator").alias("initial_role"),
        )

    @property
    def approvals(self) -> DataFrame:
        """One approval request per order line; some name unknown wills."""
        will = F.when(F.col("l_partkey") % 50 == 0, -F.col("l_orderkey") - 1).otherwise(
            F.col("l_orderkey")
        )
        return self.table("lineitem").select(request_seq().alias("seq"), will.alias("will_id"))

    @property
    def primary_requests(self) -> DataFrame:
        chosen = F.when(
            F.col("l_partkey") % 100 != 0, F.col("l_orderkey") * 10 + F.col("l_linenumber") % 3
        )
        return self.table("lineitem").select(
            request_seq().alias("seq"), chosen.alias("executor_id")
        )

    @property
    def deletions(self) -> DataFrame:
        """One delete request per order, and a second one for urgent orders."""
        key = F.col("o_orderkey")
        again = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1)).otherwise(F.lit(0))
        asked = self.table("orders").select(
            key, F.explode(F.sequence(F.lit(0), again)).alias("i")
        )
        return asked.select(
            (key * 2 + F.col("i")).cast("long").alias("seq"),
            F.when(key % 97 == 0, F.lit(None).cast("long"))
            .when(key % 89 == 0, -key - 1)
            .otherwise(key)
            .alias("will_id"),
            ((key + F.col("i")) % 3 == 0).alias("force"),
            F.when((key + F.col("i")) % 6 == 0, "DELETE-CONFIRM").alias("confirm_text"),
        )

    @property
    def share_changes(self) -> DataFrame:
        """Changed share rows; some name assets that do not exist."""
        off = F.when(F.col("l_partkey") % 20 == 0, 9).otherwise(0)
        return self.table("lineitem").select(
            (asset_key() + off).alias("asset_id"),
            F.col("l_suppkey").alias("beneficiary_id"),
            F.col("l_shipdate").alias("changed_at"),
        )

    @property
    def new_executors(self) -> DataFrame:
        return self.table("lineitem").select(
            request_seq().alias("seq"),
            F.col("l_orderkey").alias("will_id"),
            F.concat(F.lit("Executor "), F.col("l_suppkey").cast("string")).alias("full_name"),
            email_of(F.col("l_suppkey")).alias("email"),
        )

    @property
    def revised_wills(self) -> DataFrame:
        """A later snapshot of the wills: some changed, some gone, some new."""
        key = F.col("will_id")
        kept = self.wills.where(key % 11 != 0).withColumn(
            "status", F.when(key % 7 == 0, "Approved").otherwise(F.col("status"))
        )
        new = self.wills.where(key % 13 == 0).withColumn("will_id", key + 1000000000000)
        return kept.unionByName(new)

    @property
    def role_updates(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("seq"),
            email_of(key * 5).alias("email"),
            F.when(key % 3 == 0, "admin").otherwise("executor").alias("new_role"),
        )

    @property
    def asset_forms(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("seq"),
            F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("name"),
            F.when(key % 31 == 0, "").otherwise(F.col("p_type")).alias("asset_type"),
            F.when(key % 9 == 0, "abc")
            .when(key % 11 == 0, "-5")
            .when(key % 14 == 0, " ")
            .otherwise(key.cast("string"))
            .alias("value"),
        )

    @property
    def person_forms(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("seq"),
            F.when(key % 10 != 0, F.col("c_name")).alias("full_name"),
            F.when(key % 7 == 0, " ").otherwise("Child").alias("relation"),
            F.when(key % 8 != 0, email_of(key)).alias("email"),
        )

    @property
    def will_forms(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("seq"),
            F.when(key % 12 == 0, " ")
            .otherwise(F.concat(F.lit("Will "), key.cast("string")))
            .alias("title"),
        )


def change_columns() -> list[Column]:
    """Will status changes from event rows, static or streamed."""
    code = F.regexp_extract(F.col("props"), "[0-9]+", 0).cast("int") % 4
    status = (
        F.when(code == 0, "Draft")
        .when(code == 1, "Approved")
        .when(code == 2, "Executing")
        .otherwise("Executed")
    )
    return [
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("will_id"),
        status.alias("new_status"),
        F.col("ts").alias("change_date"),
    ]
