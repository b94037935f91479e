"""Times as stored in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.session import BLANKS

DAY = 86_400_000_000


def time_micros(text: Column) -> Column:
    """Microseconds since 1970 from a calendar date and time (blank or T between them, UTC) or from seconds; null if unreadable."""
    t = F.btrim(text, F.lit(BLANKS))
    calendar = F.when(t.rlike("^\\d{4}-\\d\\d-\\d\\d[ T]\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?Z?$"), F.concat(F.rtrim(F.regexp_replace(t, "Z$", "")), F.lit("Z")))
    seconds = F.when(t.rlike("^\\d{1,11}(\\.\\d+)?$"), t.cast("decimal(24,6)") * 1_000_000)
    return F.coalesce(F.unix_micros(calendar.try_cast("timestamp")), seconds.cast("long"))


def stamp(at: Column) -> Column:
    """An instant as it is stored: date and time in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
