"""The time axis: buckets of the resolution within epochs of the duration, both counted from 0."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.errors import InvalidTime
from tidegrid.params import Params

LAST = 1 << 63
#: Microseconds of the last day that a Python datetime holds, about.
LAST_US = 253_402_214_400 * 10**6


@dataclass(frozen=True)
class Range:
    """Buckets from lo up to but without hi, and the epochs that hold them."""

    lo: int
    hi: int
    first_epoch: int
    last_epoch: int

    @property
    def empty(self) -> bool:
        return self.lo >= self.hi


def ns_range(start: int, end: int, params: Params) -> Range:
    """The half-open range of a query, both ends floored to the resolution.

    An end before the start, or within the first bucket of all time, is an error; a range within one bucket is empty.
    """
    if start < 0 or end < start or end >= LAST or end < params.resolution:
        raise InvalidTime(f"no time range: {start} to {end}")
    lo, hi = start - start % params.resolution, end - end % params.resolution
    return Range(lo, hi, lo - lo % params.duration, (hi - 1) - (hi - 1) % params.duration if hi else 0)


def epoch_of(ns: Column, params: Params) -> Column:
    return ns - ns % F.lit(params.duration)


def bucket_of(ns: Column, params: Params) -> Column:
    return ns - ns % F.lit(params.resolution)


def position(epoch: Column, bucket: Column, params: Params) -> Column:
    return ((bucket - epoch) / F.lit(params.resolution)).cast("int")


def nanoseconds(ts: Column) -> Column:
    """Nanoseconds since 1970-01-01 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) * 1000


def within(ts: Column, span: Range, params: Params) -> Column:
    """Whether a timestamp without zone falls in one of the epochs that a range touches, as bounds that a scan can use."""
    if span.empty:
        return F.lit(False)
    low, high = span.first_epoch // 1000, -(-(span.last_epoch + params.duration) // 1000)
    literal = lambda us: F.expr(f"timestamp_ntz'{datetime(1970, 1, 1) + timedelta(microseconds=us)}'")
    out = ts >= literal(low)
    return out & (ts < literal(high)) if high < LAST_US else out


def ns_within(ns: Column, span: Range, params: Params) -> Column:
    """The same for nanoseconds."""
    return F.lit(False) if span.empty else (ns >= span.first_epoch) & (ns < min(span.last_epoch + params.duration, LAST - 1))
