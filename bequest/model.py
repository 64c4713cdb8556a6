"""Fixed values of the estate data model: domains, thresholds and rejection codes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

# --- fixed values: status and flag domains -------------------------------------------------
WILL_STATUSES = ("Draft", "Approved", "Executing", "Executed")
TRANSFER_STATUSES = ("Initiated", "Completed", "Failed")
INITIAL_ROLES = ("testator", "executor", "beneficiary", "admin", "user")
DOCUMENT_ENTITIES = ("WILL", "ASSET")
ASSET_TYPES = ("Real Estate", "Financial", "Vehicle", "Personal", "Business", "Investment", "Other")
RELATIONS = ("Spouse", "Child", "Parent", "Sibling", "Friend", "Charity", "Other")
FILE_TYPES = ("PDF", "DOC", "JPG", "PNG", "TXT")
PROTECTED_STATUSES = ("Approved", "Executing", "Executed")
TRANSFERABLE_STATUSES = ("Approved", "Executing")

# --- fixed values: thresholds ----------------------------------------------------------------
FULL_PERCENT = 100
APPROVE_PERCENT = 90
NEAR_PERCENT = 80
MIN_SHARE = Decimal("0.01")
PAGE_SIZE = 50
RECENT_DAYS = 30
RECENT_ROWS = 20
AUDIT_DAYS = 7
ADULT_AGE = 18
DELETE_CONFIRMATION = "DELETE-CONFIRM"

# --- fixed values: texts of history, audit and calendar rows ({} stands for a value) -----------
TEXT_STATUS = "Status: {}"
TEXT_RELATED = (
    "Related counts - Assets: {}, Executors: {}, Beneficiaries: {}, Documents: {}"
)
TEXT_STATUS_BEFORE = "Status before deletion: {}"
TEXT_DELETED = "Deleted records: {}"
TEXT_INITIATED = "Transfer initiated by {} on {}"
TEXT_TRANSFER = "Transfer from asset {} to Beneficiary #{}"
TEXT_DOCUMENT = 'Added document "{}" to {} ID {}'
TEXT_PRIMARY_BEFORE = "Previous primary executor: ID {}"
TEXT_NO_PRIMARY = "No previous primary executor"
TEXT_RESET = "All reset to non-primary"
TEXT_PRIMARY = "Set executor {} as primary for will {}"
TEXT_WEEKEND = "Weekend transfers blocked"
TEXT_WEEKDAY = "Weekday transfers allowed"

# --- fixed values: patterns ------------------------------------------------------------------
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,4}$"
LOOSE_EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_PATTERN = r"^(\+?250|0)?7[2-9]\d{7}$"

# --- fixed values: rejection codes (negative) and our own form codes (positive) --------------
# code, class, severity, message
CODES = (
    (-20001, "weekend", "warning", "Weekend restriction"),
    (-20002, "holiday", "warning", "Holiday restriction"),
    (-20003, "status", "danger", "Executed wills keep their status"),
    (-20004, "status", "danger", "A draft must be approved before it is executed"),
    (-20005, "allocation", "danger", "Shares of one asset may not exceed 100 %"),
    (-20010, "invalid data", "danger", "The asset id is missing"),
    (-20011, "invalid data", "danger", "The asset is unknown"),
    (-20012, "locked", "danger", "The will has been executed"),
    (-20013, "invalid data", "danger", "The asset has no valid will"),
    (-20020, "allocation", "danger", "Some assets are not fully allocated"),
    (-20021, "approval", "danger", "The will has no executor"),
    (-20022, "executor", "danger", "The will already has a primary executor"),
    (-20023, "invalid data", "danger", "The document target is unknown"),
    (-20030, "invalid data", "danger", "The e-mail address is malformed"),
    (-20031, "locked", "danger", "The will is protected against deletion"),
    (-20091, "approval", "danger", "The will is unknown"),
    (-20092, "approval", "danger", "Only drafts can be approved"),
    (-20093, "approval", "danger", "The will has no executor"),
    (-20094, "approval", "danger", "The will has no primary executor"),
    (-20095, "approval", "danger", "Some assets are allocated below 90 %"),
    (-20099, "validation", "danger", "The transfer could not be validated"),
    (-21001, "invalid data", "danger", "The record does not exist"),
    (-21002, "invalid data", "danger", "The record does not exist"),
    (-21003, "locked", "danger", "The will has been executed"),
    (-21004, "allocation", "danger", "Shares of one asset may not exceed 100 %"),
    (-23001, "invalid data", "danger", "The record does not exist"),
    (-23002, "invalid data", "danger", "The record does not exist"),
    (-23003, "transfer", "danger", "The beneficiary has no share of this asset"),
    (-23004, "transfer", "danger", "The will is neither approved nor executing"),
    (-23005, "transfer", "danger", "The transfer has been completed before"),
    (-24001, "invalid data", "danger", "Documents belong to a WILL or an ASSET"),
    (-24002, "invalid data", "danger", "The document target is unknown"),
    (-25000, "invalid data", "danger", "The executor id is missing"),
    (-25001, "invalid data", "danger", "The executor is unknown"),
    (-26000, "invalid data", "danger", "The will id is missing"),
    (-26001, "invalid data", "danger", "The will is unknown"),
    (-26002, "locked", "danger", "Only drafts can be deleted"),
    (-26004, "confirmation", "danger", "The confirmation text is missing"),
    (-26005, "locked", "danger", "The will could not be deleted"),
    (-12702, "language", "danger", "The language setting is unusable"),
)
GENERIC = ("generic", "danger", "The operation failed")
CODES_SCHEMA = "reject_code int, error_class string, severity string, message string"

# Own codes of form checks, which carry no code in the data model.
FORM_FIELD_MISSING = 1
FORM_EMAIL_TAKEN = 2
FORM_EMAIL_REPEATED = 3
FORM_ROLE_UNKNOWN = 4
FORM_SHARE_INVALID = 5
FORM_VALUE_INVALID = 6
PROFILE_NAME, PROFILE_EMAIL, PROFILE_PHONE, PROFILE_AGE, PROFILE_ADDRESS = 1, 2, 3, 4, 5

# --- table schemas ---------------------------------------------------------------------------
# One amount as entered, and totals that stay exact for one key with very many rows.
MONEY = T.DecimalType(15, 2)
TOTAL = T.DecimalType(18, 2)

SCHEMAS = {
    "users": "user_id long, full_name string, email string, phone_number string, "
    "date_of_birth date, address string, initial_role string, created_at timestamp_ntz",
    "wills": "will_id long, user_id long, title string, description string, status string, "
    "created_at timestamp_ntz, last_updated_at timestamp_ntz",
    "assets": "asset_id long, will_id long, name string, asset_type string, value decimal(15,2)",
    "beneficiaries": "beneficiary_id long, full_name string, relation string, email string",
    "executors": "executor_id long, will_id long, full_name string, email string, is_primary string",
    "shares": "mapping_id long, asset_id long, beneficiary_id long, share_percent decimal(7,2)",
    "transfers": "transfer_id long, asset_id long, beneficiary_id long, "
    "transfer_date timestamp_ntz, approved_by string, transfer_status string",
    "documents": "document_id long, related_entity string, entity_id long, title string, "
    "file_type string",
    "holidays": "holiday_date date, description string, is_recurring string",
    "history": "will_id long, old_status string, new_status string, changed_by string, "
    "change_date timestamp_ntz, reason string",
    "audit": "audit_id long, user_name string, action string, action_table string, "
    "record_id long, old_values string, new_values string, timestamp timestamp_ntz, "
    "status string",
}
