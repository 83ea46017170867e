"""Timestamps written as text by several writers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: date, time, optional fraction, optional zone; digits only are Unix milliseconds
ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?\s*(Z|z|[+-]\d{2}:?\d{2})?$"
MILLIS = r"^\d{12,14}$"


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 of a text timestamp, else null.

    Accepts ISO 8601 with ``T`` or a blank, with or without a fraction (digits beyond the sixth are
    dropped), with ``Z``, ``+02:00``, ``+0530`` or no zone (then UTC), and 12 to 14 digits as Unix
    milliseconds. Null, blank, words and impossible dates give null; the session's zone plays no part.
    """
    t = F.trim(text)
    zone = F.regexp_replace(F.upper(F.regexp_extract(t, ISO, 4)), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    frac = F.substring(F.rpad(F.regexp_extract(t, ISO, 3), 6, "0"), 1, 6)
    clean = F.concat(
        F.regexp_extract(t, ISO, 1), F.lit("T"), F.regexp_extract(t, ISO, 2), F.lit("."), frac,
        F.when(zone == "", "Z").otherwise(zone),
    )
    return F.when(t.rlike(MILLIS), t.try_cast("bigint") * 1000).when(
        t.rlike(ISO), F.unix_micros(clean.try_cast("timestamp"))
    )
