"""Validation of structured records and contract objects: derived columns and the first reason for a reject, no row lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum import schemas
from vinculum.functions.text import match_account, match_phone

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def iso_instant(text: Column) -> Column:
    """Timestamp of an ISO text in a session of zone UTC; naive ones are UTC; other shapes and impossible times are null."""
    return F.when(text.rlike(_ISO), F.try_to_timestamp(text))


def check_calls(calls: DataFrame, time: str = "call_time", strict_time: bool = True) -> DataFrame:
    """Calls (caller, callee, a time column, duration) with ``reject``: the first of missing_caller, missing_callee,
    missing_time, same_party, invalid_time (only ISO texts count, unless not ``strict_time``), invalid_duration; null if valid."""
    bad_time = iso_instant(F.col(time)).isNull() if strict_time else F.lit(False)
    d = F.col("duration").try_cast("double")
    reason = (
        F.when(_blank(F.col("caller")), "missing_caller").when(_blank(F.col("callee")), "missing_callee").when(_blank(F.col(time)), "missing_time")
        .when(match_phone(F.col("caller")) == match_phone(F.col("callee")), "same_party").when(bad_time, "invalid_time")
        .when(F.col("duration").isNotNull() & (d.isNull() | (d < 0)), "invalid_duration")
    )
    return calls.withColumn("reject", reason)


def check_transfers(transfers: DataFrame, time: str = "transaction_time", strict_time: bool = True) -> DataFrame:
    """Transfers (sender, recipient, amount, currency, a time column) with ``reject``: the first of missing_sender,
    missing_recipient, same_party, missing_amount, non_positive_amount (NaN passes), invalid_currency, missing_time,
    invalid_time; null if valid."""
    bad_time = iso_instant(F.col(time)).isNull() if strict_time else F.lit(False)
    a = F.col("amount").try_cast("double")
    reason = (
        F.when(_blank(F.col("sender")), "missing_sender").when(_blank(F.col("recipient")), "missing_recipient")
        .when(match_account(F.col("sender")) == match_account(F.col("recipient")), "same_party")
        .when(a.isNull(), "missing_amount").when(a <= 0, "non_positive_amount")
        .when(~F.coalesce(F.upper(F.trim("currency")).rlike("^[A-Z]{3}$"), F.lit(False)), "invalid_currency")
        .when(_blank(F.col(time)), "missing_time").when(bad_time, "invalid_time")
    )
    return transfers.withColumn("reject", reason)


def strict(checked: DataFrame) -> DataFrame:
    """Fails with the first reject met, if there is one; else the rows without the column reject."""
    stop = F.when(F.col("reject").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid record: "), "reject")).cast("boolean"))
    return checked.filter(stop).drop("reject")


def lenient(checked: DataFrame) -> DataFrame:
    """The valid rows."""
    return checked.filter("reject is null").drop("reject")


def relationship_violations(rels: DataFrame) -> DataFrame:
    """Relationships (type, confidence, status, doc, record) with ``violations``, a sorted array of the rules broken."""
    rules = {
        "confidence_out_of_range": ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "missing_provenance": F.col("doc").isNull() & _blank(F.col("record")),
        "unknown_relationship": ~F.coalesce(F.col("type").isin(*schemas.RELATIONSHIP_TYPES), F.lit(False)),
        "unknown_status": ~F.coalesce(F.col("status").isin(*schemas.STATUSES), F.lit(False)),
    }
    return rels.withColumn("violations", F.filter(F.array(*[F.when(bad, name) for name, bad in rules.items()]), lambda x: x.isNotNull()))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n) of keys that hold more than one row; rows with a null key don't count."""
    there = F.lit(True)
    for k in keys:
        there &= F.col(k).isNotNull()
    return df.filter(there).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


#: Names that are no entities.
JUNK_NAMES = ["he", "she", "they", "him", "her", "them", "it", "who", "whom", "his", "their", "its", "this", "that", "these", "those", "someone", "anyone", "nobody", "the", "a", "an", "by", "and", "or"]


def is_junk(name: Column) -> Column:
    """Pronouns and fragments, names of at most one letter and case titles."""
    n = F.lower(F.trim(name))
    return n.isin(*JUNK_NAMES) | (F.length(n) <= 1) | n.startswith("vs.") | n.startswith("state of") | name.isNull()


def safe_details(details: Column, blocked: list[str]) -> Column:
    """A string map without the blocked keys, in any case."""
    return F.map_filter(details, lambda k, _: ~F.lower(k).isin(*[b.lower() for b in blocked]))


def bounded(value, low: int, high: int, name: str) -> int:
    """``value`` if it is an integer within the bounds; booleans and others raise ValueError."""
    if type(value) is not int or not low <= value <= high:
        raise ValueError(f"{name} must be an integer within {low} and {high}")
    return value
