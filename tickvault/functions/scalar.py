"""Small scalar rules shared by several operators.

Every function returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000

# Fixed value: a ticker file name keeps its stem; the reference removes every
# ".txt" occurrence from the name.
TEXT_SUFFIX = ".txt"
# Fixed value: substrings that mark an error as rate limiting (lower case).
RATE_LIMIT_PATTERN = "rate|too many|429"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_date(d) -> Column:
    if isinstance(d, Column):
        return d.cast(T.DateType())
    if isinstance(d, (_dt.date, _dt.datetime)):
        d = d.isoformat()[:10]
    return F.lit(str(d)[:10]).cast(T.DateType())


def lit_ts(ts) -> Column:
    if isinstance(ts, Column):
        return ts.cast(T.TimestampNTZType())
    if isinstance(ts, _dt.datetime):
        ts = ts.isoformat(sep=" ")
    return F.lit(str(ts)).cast(T.TimestampNTZType())


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode white space.

    ``trim`` only removes blanks, a tab would survive.
    """
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def universe_name(file_name) -> Column:
    """File name -> universe name (every ``.txt`` removed)."""
    return F.replace(_col(file_name), F.lit(TEXT_SUFFIX), F.lit(""))


def nan_to_null(c) -> Column:
    """NaN behaves as missing: Python's ``NaN > 0`` is false, SQLite stores NULL."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def round_half_up(c, digits: int = 2) -> Column:
    """Round to ``digits`` places, halves away from zero for positive values.

    ``floor(x*10^d + 0.5) / 10^d`` gives the same bits in Spark and DuckDB.
    """
    scale = float(10**digits)
    return F.floor(_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def age_days(ts, as_of) -> Column:
    """Whole days of age as Python's ``timedelta.days``: floored, so -1 h is -1."""
    micros = F.timestamp_diff("MICROSECOND", _col(ts).cast(T.TimestampNTZType()), lit_ts(as_of))
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast(T.LongType())


def local_date(ts, exchange_tz, naive_is_utc: bool = True) -> Column:
    """Date of the exchange's wall clock for a landed instant.

    A zone-aware instant (TIMESTAMP) is converted from the session zone; a
    naive value is taken as UTC when ``naive_is_utc``, else as already local.
    The wall clock is kept; nothing is shifted to UTC.
    """
    ts = _col(ts)
    tz = exchange_tz if isinstance(exchange_tz, Column) else F.lit(exchange_tz)
    if naive_is_utc:
        wall = F.convert_timezone(F.lit("UTC"), tz, ts.cast(T.TimestampNTZType()))
    else:
        wall = ts.cast(T.TimestampNTZType())
    return wall.cast(T.DateType())


def local_date_of_instant(ts, exchange_tz) -> Column:
    """Like :func:`local_date` for a zone-aware TIMESTAMP column: the instant's
    wall clock in the session zone, carried to the exchange's zone."""
    tz = exchange_tz if isinstance(exchange_tz, Column) else F.lit(exchange_tz)
    wall = _col(ts).cast(T.TimestampNTZType())
    return F.convert_timezone(F.current_timezone(), tz, wall).cast(T.DateType())


def is_rate_limited(error) -> Column:
    """Rate limit test of the reference: a broad substring match on lower case."""
    return F.coalesce(F.lower(_col(error)).rlike(RATE_LIMIT_PATTERN), F.lit(False))
