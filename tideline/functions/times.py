"""Time arithmetic of the replay conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First day of the meter time code and the length of one slot.
TIMECODE_START = "2009-01-01"
SLOT_SECONDS = 1800
DAY_SECONDS = 86_400
# Fixed value: spacing of the fixed-rate replay.
EVENT_SPACING_MS = 2


def epoch_millis(text: Column) -> Column:
    return F.unix_millis(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"))


def scaled_offset(value: Column, first: Column, scale: float) -> Column:
    """Elapsed time since ``first``, scaled and cut to a whole number."""
    return ((value - first) * F.lit(float(scale))).cast("bigint")


def fixed_rate_offset(row: Column, scale: float) -> Column:
    """Time of the ``row``-th event (from 0) of a steady 2 ms stream."""
    return (row * EVENT_SPACING_MS * F.lit(float(scale))).cast("bigint")


def timecode_seconds(code: Column) -> Column:
    """``DDDTT`` meter code -> epoch seconds: day DDD from the start, slot TT of 30 min."""
    padded = F.lpad(code.cast("string"), 5, "0")
    day = F.substring(padded, 1, 3).cast("int")
    slot = F.substring(padded, 4, 2).cast("int")
    start = F.unix_timestamp(F.to_timestamp(F.lit(TIMECODE_START), "yyyy-MM-dd"))
    return start + (day - 1) * DAY_SECONDS + (slot - 1) * SLOT_SECONDS


def timecode_offset(seconds: Column, first: Column, scale: float) -> Column:
    return (F.abs(seconds - first) * F.lit(float(scale))).cast("bigint")
