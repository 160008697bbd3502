"""Content types, digests, rotation periods and collection names of the archive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rotation policies and how their period is written.
ROTATION_FORMATS = {"HOURLY": "yyyyMMddHH", "DAILY": "yyyyMMdd", "MONTHLY": "yyyyMM", "YEARLY": "yyyy"}
ROTATION_UNITS = {"HOURLY": "HOUR", "DAILY": "DAY", "MONTHLY": "MONTH", "YEARLY": "YEAR"}
POLICY_ORDER = ["HOURLY", "DAILY", "MONTHLY", "YEARLY", "NONE"]


def mime_of(content_type: Column) -> Column:
    """Text before ``;`` unless it comes first; nothing is trimmed or lower-cased."""
    return F.when(F.instr(content_type, ";") > 1, F.substring_index(content_type, ";", 1)).otherwise(content_type)


def rotation_key(ts: Column, policy: Column) -> Column:
    """The period a time falls in, as text; empty without rotation."""
    out = F.lit("")
    for name, pattern in ROTATION_FORMATS.items():
        out = F.when(policy == name, F.date_format(ts, pattern)).otherwise(out)
    return out


def final_collection_name(name: Column, sub_type: Column, ts: Column, policy: Column) -> Column:
    """Collection name, sub-collection type and rotation key, joined by ``_``."""
    def present(c: Column) -> Column:
        return F.when((c != "") & (c != "UNDEFINED"), c)

    return F.concat_ws("_", name, present(sub_type), present(rotation_key(ts, policy)))


def period_end(ts: Column, policy: Column) -> Column:
    """End of the period a time falls in, NULL without one."""
    out = F.lit(None).cast("timestamp_ntz")
    for name, unit in ROTATION_UNITS.items():
        step = F.make_interval(**{{"HOUR": "hours", "DAY": "days", "MONTH": "months", "YEAR": "years"}[unit]: F.lit(1)})
        end = (F.date_trunc(unit, ts.cast("timestamp")).cast("timestamp_ntz") + step).cast("timestamp_ntz")
        out = F.when(policy == name, end).otherwise(out)
    return out


def finer_policy(a: Column, b: Column) -> Column:
    """The policy that rotates more often."""
    def rank(c: Column) -> Column:
        return F.array_position(F.array(*[F.lit(p) for p in POLICY_ORDER]), c)

    return F.when(rank(a) <= rank(b), a).otherwise(b)


def block_digest(header: Column, payload: Column, cached: Column) -> Column:
    """SHA-1 over header and payload bytes; cached responses are not digested."""
    digest = F.concat(F.lit("sha1:"), F.sha1(F.concat(header.cast("binary"), payload.cast("binary"))))
    return F.when(cached, F.lit("")).otherwise(digest)
