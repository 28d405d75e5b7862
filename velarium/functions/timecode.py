"""Timecodes, frames and intervals as column expressions.

A timecode is `HH:MM:SS.mmm`. Formatters round to milliseconds before they split, so that 59.9996 s becomes 00:01:00.000.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = r"^([01]\d|2[0-3]):([0-5]\d):([0-5]\d)\.(\d{1,6})$"
_LOOSE = r"^(\d{1,2}):([0-5]?\d):([0-5]?\d)(?:\.(\d{1,6}))?$"


def _seconds(c: Column, pattern: str) -> Column:
    part = lambda k: F.regexp_extract(c, pattern, k)
    fraction = F.coalesce(F.try_divide(part(4).try_cast("double"), F.pow(F.lit(10.0), F.length(part(4)).try_cast("double"))), F.lit(0.0))
    return F.when(c.rlike(pattern), part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double") + fraction)


def time_to_seconds(c: Column) -> Column:
    """Seconds of a timecode with a fraction and an hour below 24; null otherwise."""
    return _seconds(c, _STRICT)


def parse_time_safe(c: Column) -> Column:
    """Seconds of a timecode with or without a fraction; null otherwise."""
    return _seconds(c, _LOOSE)


def seconds_to_timecode(c: Column) -> Column:
    ms = F.round(c * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("0") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def frames_to_timestamp(frame: Column, fps: Column) -> Column:
    return seconds_to_timecode(frame / fps)


def gap_text(c: Column) -> Column:
    """A gap in seconds as HH:MM:SS.s."""
    tenths = F.round(c * 10).cast("long")
    return F.format_string("%02d:%02d:%02d.%d", F.floor(tenths / 36000), F.floor(tenths / 600) % 60, F.floor(tenths / 10) % 60, tenths % 10)


def truncated_duration(c: Column) -> Column:
    """A duration as HH:MM:SS.mmm with the milliseconds cut off, not rounded."""
    ms = F.floor(c * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def time_to_frame(seconds: Column, fps: Column) -> Column:
    """The frame at a time, truncated."""
    return F.floor(seconds * fps).cast("long")


def timecode_to_frame(c: Column, fps: Column) -> Column:
    """The frame of a valid timecode, half to even; null for others."""
    return F.bround(time_to_seconds(c) * fps, 0).cast("long")


def fps_of(ratio: Column) -> Column:
    """Frames a second from `a/b` or a number; null where b is 0."""
    return F.try_divide(F.split_part(ratio, F.lit("/"), F.lit(1)).cast("double"), F.coalesce(F.nullif(F.split_part(ratio, F.lit("/"), F.lit(2)), F.lit("")).cast("double"), F.lit(1.0)))


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Positive-length overlap, or containment: touching intervals do not overlap, a point on a boundary does."""
    positive = F.least(a1, b1) > F.greatest(a0, b0)
    return positive | ((b0 >= a0) & (b1 <= a1)) | ((a0 >= b0) & (a1 <= b1))


def even_picks(start: Column, end: Column, n: int) -> Column:
    """n frames evenly inside [start, end]: start + i * (end - start) div (n + 1), i from 1."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: start + F.floor(i * (end - start) / (n + 1)).cast("long"))


def offsets_around(at: Column, offsets: list[float], fps: Column, last: Column) -> Column:
    """Frames at offsets in seconds around a time, held inside [0, last]."""
    return F.transform(F.array(*[F.lit(float(o)) for o in offsets]), lambda o: F.least(F.greatest(F.floor((at + o) * fps), F.lit(0)), last).cast("long"))
