"""Identifiers, hashes and UTC text forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(F.length(strip(value)) == 0, F.lit(True))


def none_null(*values: Column) -> Column:
    return reduce(lambda a, b: a & b, [v.isNotNull() for v in values])


def utc_text(ts: Column, fraction_digits: int = 6) -> Column:
    """ISO-8601 text of an instant in UTC, whatever the session zone is."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    pattern = "yyyy-MM-dd'T'HH:mm:ss" + ("." + "S" * fraction_digits if fraction_digits else "")
    return F.concat(F.date_format(utc, pattern), F.lit("+00:00"))


def iso_text(ts: Column) -> Column:
    """UTC ISO text that shows microseconds only where there are some."""
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, utc_text(ts, 0)).otherwise(utc_text(ts))


def idempotency_key(
    tenant_id: Column,
    platform: Column,
    source_object_id: Column,
    event_type: Column,
    occurred_at: Column,
) -> Column:
    """SHA-256 identity of a logical event, independent of its delivery.

    NULL when any part is NULL: ``concat_ws`` would drop the part and let two
    different events share a key.
    """
    parts = [
        F.lower(strip(tenant_id)),
        F.lower(strip(platform)),
        strip(source_object_id),
        F.lower(strip(event_type)),
        utc_text(occurred_at),
    ]
    return F.when(none_null(*parts), F.sha2(F.concat_ws("|", *parts), 256))


def stable_decision_id(*parts: Column) -> Column:
    """SHA-256 of the trimmed, lower-cased parts; NULL when every part is blank."""
    cleaned = [F.coalesce(F.lower(strip(p)), F.lit("")) for p in parts]
    joined = F.concat_ws("|", *cleaned)
    return F.when(F.length(F.replace(joined, F.lit("|"), F.lit(""))) > 0, F.sha2(joined, 256))


def record_id(*parts: Column) -> Column:
    """SHA-256 of pipe-joined parts as they are (ids of table records)."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def percent_encode(value: Column) -> Column:
    """RFC 3986 percent-encoding that leaves only unreserved characters."""
    encoded = F.url_encode(value)
    for form_encoded, rfc3986 in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form_encoded), F.lit(rfc3986))
    return encoded
