"""Scalar functions over changelog entries, schemas and import jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def operation(lsn: Column, before: Column, after: Column, message_type: Column | None = None) -> Column:
    """IMPORT, INSERT, UPDATE or DELETE of a modification.

    By the images alone an update that carries no old row looks like an insert; ``message_type`` (I, U or D), where it is
    known, settles that.
    """
    by_images = F.when(before.isNull(), "INSERT").when(after.isNull(), "DELETE").otherwise("UPDATE")
    if message_type is not None:
        by_images = F.when(message_type == "I", "INSERT").when(message_type == "U", "UPDATE").when(message_type == "D", "DELETE").otherwise(by_images)
    return F.when(lsn.isNull(), "IMPORT").otherwise(by_images)


def after_or_before(before: Column, after: Column) -> Column:
    return F.coalesce(after, before)


def table_reference(namespace: Column, name: Column) -> Column:
    return F.concat(namespace, F.lit("."), name)


def fingerprint(columns: Column) -> Column:
    """MD5 in hexadecimal over a line key|name|type|modifier of each column. Modifiers count as 0: producers disagree on them."""
    line = F.transform(columns, lambda c: F.concat(c["key"].cast("string"), F.lit("|"), c["name"], F.lit("|"), c["type"].cast("string"), F.lit("|0\n")))
    return F.md5(F.array_join(line, ""))


def primary_key(columns: Column) -> Column:
    """Names of the key columns of a schema, in column order."""
    return F.transform(F.filter(columns, lambda c: c["key"]), lambda c: c["name"])


def parse_lsn(text: Column) -> Column:
    """A log position ``X/Y`` in hexadecimal as a number."""
    part = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("bigint")
    return part(1) * F.lit(1 << 32) + part(2)


def format_lsn(lsn: Column) -> Column:
    return F.concat_ws("/", F.hex(F.shiftright(lsn, 32)), F.hex(lsn.bitwiseAND(F.lit((1 << 32) - 1))))


def retry_delay(errors: Column, interval: float = 5.0, base: float = 3.0, most: float = 3600.0) -> Column:
    """Seconds to wait before a job that failed so often is tried again."""
    return F.least(F.lit(most), F.lit(interval) * F.pow(F.lit(base), errors))


def may_run(errors: Column, last_error_at: Column, now: Column) -> Column:
    """Whether a job has not failed, or long enough ago."""
    waited = last_error_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), retry_delay(errors).cast("decimal(18,6)"))
    return (errors < 1) | F.coalesce(now > waited, F.lit(False))


def import_status(job: Column, expired_at: Column, completed_at: Column, error: Column, cursor: Column) -> Column:
    """inactive (no job), expired, complete, error, scheduled (nothing read yet) or in_progress."""
    return (
        F.when(job.isNull(), "inactive")
        .when(expired_at.isNotNull(), "expired")
        .when(completed_at.isNotNull(), "complete")
        .when(error.isNotNull(), "error")
        .when(cursor.isNull(), "scheduled")
        .otherwise("in_progress")
    )


def rows_processed(status: Column, total: Column) -> Column:
    """Rows processed, none for a table whose import is expired or unknown."""
    return F.when(status.isin("expired", "inactive"), F.lit(0)).otherwise(F.coalesce(total, F.lit(0))).cast("bigint")


def progress(done: Column, total: Column) -> Column:
    """Whole per cent done; 0 of nothing."""
    return F.coalesce(F.floor(F.try_divide(100.0 * done, total)), F.lit(0)).cast("bigint")


def rfc3339(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ssXXX")


def slot_name(name: Column, identifier: Column) -> Column:
    return F.concat(name, F.lit("_"), identifier)


def short_id() -> Column:
    return F.split_part(F.uuid(), F.lit("-"), F.lit(1))


def listed(text: str) -> list[str]:
    """Comma-separated names."""
    return [x.strip() for x in text.split(",") if x.strip()]
