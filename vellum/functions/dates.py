"""Spreadsheet serial dates: days since an epoch, the time as their fraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from each epoch to 1970-01-01.
SINCE_1900, SINCE_1904 = 25569, 24107
_DAY = 86_400_000_000


def to_timestamp(serial: Column, date1904: bool = False) -> Column:
    """Timestamp without zone, to the nearest microsecond."""
    days = F.floor(serial)
    micros = F.round((serial - days) * _DAY).cast("long")
    total = (days - (SINCE_1904 if date1904 else SINCE_1900)).cast("long") * _DAY + micros
    return F.timestamp_micros(total).cast("timestamp_ntz")


def to_serial(stamp: Column, date1904: bool = False) -> Column:
    micros = F.unix_micros(stamp.cast("timestamp"))
    return micros / F.lit(float(_DAY)) + (SINCE_1904 if date1904 else SINCE_1900)
