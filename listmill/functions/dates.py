"""Mail dates, wall-clock timestamps and 30-day periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"([0-9]+):([0-9]+):([0-9]+) (\W+[0-9]+)"
_DATE = rf"([0-9]+) (\w+) ([0-9]+) {_TIME}"
_SHORT_YEAR = rf"(?<![0-9])([0-9]{{1,3}}) (\w+) ([0-9]{{1,3}}) {_TIME}"
_FULL_YEAR = rf"([0-9]+) (\w+) ([0-9]{{4}}) {_TIME}"

# Month abbreviations in order (fixed values).
_MONTHS = [
    "jan", "feb", "mar", "apr", "may", "jun",
    "jul", "aug", "sep", "oct", "nov", "dec",
]


def clean_date(header_date: Column) -> Column:
    """Date header to date text, null where the message has to be rejected.

    At least five space-separated parts; a trailing comment is cut; a short year gets
    ``20`` put in front and then only the matched part is kept.
    """
    text = F.regexp_replace(header_date, r" ?[(][^(]*$", "")
    short = F.regexp_substr(text, F.lit(_SHORT_YEAR))
    widened = F.regexp_replace(short, r"^(\S+) (\S+) ", "$1 $2 20")
    usable = (F.size(F.split(header_date, " ")) > 4) & F.rlike(text, F.lit(_DATE))
    return F.when(usable, F.coalesce(widened, text))


def wall_clock(date_text: Column) -> Column:
    """Date text to TIMESTAMP_NTZ; the zone is dropped, never converted.

    The session time zone and its gaps play no part. Null when the text names no real
    moment.
    """
    found = F.regexp_substr(date_text, F.lit(_FULL_YEAR))
    name = F.lower(F.substring(F.regexp_extract(found, _FULL_YEAR, 2), 1, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), name)
    return F.concat(
        F.regexp_extract(found, _FULL_YEAR, 3),
        F.lit("-"),
        month.cast("string"),
        F.lit("-"),
        F.regexp_replace(found, _FULL_YEAR, "$1 $4:$5:$6"),
    ).try_cast("timestamp_ntz")


def period(ts: Column, end_date: Column) -> Column:
    """Signed 30-day buckets between a moment and the end date, truncated to zero."""
    return (F.datediff(F.to_date(ts), end_date) / 30).cast("int")
