"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bequest.model import EMAIL_PATTERN, LOOSE_EMAIL_PATTERN, PHONE_PATTERN


def filled(template: str, *values: Column) -> Column:
    """A text with the values in the places of {}; a NULL leaves its place empty."""
    parts = [F.lit(part) for part in template.split("{}")]
    return join_text(parts[0], *(c for pair in zip(values, parts[1:]) for c in pair))


def join_text(*parts: Column) -> Column:
    """Concatenation in which a missing part counts as empty."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return blank_to_null(c).isNull()


def normalise(c: Column) -> Column:
    return F.upper(F.trim(c))


def title_case(c: Column) -> Column:
    return F.initcap(F.translate(c, "_", " "))


def shorten(c: Column, length: int = 50) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))
    ).otherwise(text)


def tail_after(c: Column, mark: str) -> Column:
    """Text behind the first `mark`, stripped; the whole text when there is no mark."""
    at = F.instr(c, mark)
    return F.trim(F.when(at > 0, F.substr(c, at + len(mark))).otherwise(c))


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL_PATTERN)


def is_loose_email(c: Column) -> Column:
    return F.trim(c).rlike(LOOSE_EMAIL_PATTERN)


def phone_digits(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(digits.startswith("250"), F.substring(digits, 1, 12)).otherwise(digits)


def is_phone(c: Column) -> Column:
    return phone_digits(c).rlike(PHONE_PATTERN)


def number_in_text(c: Column) -> Column:
    """The leading number once everything but digits, dots and dashes is dropped."""
    kept = F.regexp_replace(c, "[^0-9.-]", "")
    lead = F.regexp_extract(kept, r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    return F.nullif(lead, F.lit("")).try_cast("double")


def document_path(entity: Column, entity_id: Column, title: Column, file_type: Column) -> Column:
    return join_text(
        F.lit("/documents/"),
        F.lower(F.trim(entity)),
        F.lit("_"),
        entity_id,
        F.lit("_"),
        F.replace(title, F.lit(" "), F.lit("_")),
        F.lit("."),
        F.lower(file_type),
    )


def shown_text(*columns: Column) -> Column:
    """What a search looks at: the shown columns side by side, in lower case."""
    return F.lower(F.concat_ws(" ", *[c.cast("string") for c in columns]))


def contains_text(term: str, *columns: Column) -> Column:
    return shown_text(*columns).contains(term.lower())
