"""Explicit schemas of every table the engine reads or writes.

Column labels follow the reference tables (``Ticker``, ``Date``, ``Open`` ...,
``Shares Outstanding`` ...) so a user can switch without renaming; the extra
bookkeeping columns of our own (``Universe``, ``batch_id``, ``seq`` ...) are
snake_case.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference for the same results.
# Canonical bar columns, in publish order.
PRICE_COLUMNS = ["Ticker", "Date", "Open", "High", "Low", "Close", "Volume"]
# Default first date of a full history request and of the backfill scan.
DEFAULT_START = "2000-01-01"
# Days re-read before the last stored bar in update mode.
DEFAULT_LOOKBACK_DAYS = 5
# Minimum gap in whole days for the backfill scan.
DEFAULT_MIN_GAP_DAYS = 7
# Age in whole days after which a free-float row is refreshed.
DEFAULT_STALE_DAYS = 7
# Tries per ticker.
DEFAULT_MAX_RETRY = 3
# Longest stored error text.
ERROR_MAX_CHARS = 500
# Error text stored when a failed ticker has none.
UNKNOWN_ERROR = "Unknown error"
# Tickers per publish in the reference.
DEFAULT_BATCH_SIZE = 10
# Status words of the free-float table.
STATUS_SUCCESS = "SUCCESS"
STATUS_FAILED = "FAILED"
# Free-float table column labels.
FF_SHARES = "Shares Outstanding"
FF_FLOAT = "Float Shares"
FF_PCT = "Free Float (%)"
FF_UPDATED = "Last Updated"

UNIVERSE = T.StructType(
    [
        T.StructField("Universe", T.StringType(), False),
        T.StructField("pos", T.LongType(), False),
        T.StructField("Ticker", T.StringType(), False),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("Ticker", T.StringType(), False),
        T.StructField("Date", T.DateType(), True),
        T.StructField("Open", T.DoubleType(), True),
        T.StructField("High", T.DoubleType(), True),
        T.StructField("Low", T.DoubleType(), True),
        T.StructField("Close", T.DoubleType(), True),
        T.StructField("Volume", T.LongType(), True),
    ]
)

# Stored daily bars: one Parquet table partitioned by Universe.
PRICES_STORED = T.StructType([T.StructField("Universe", T.StringType(), False), *PRICES.fields])

# Append-only log of landed bars; (batch_id, seq) is the write order.
BARS_LOG = T.StructType(
    [
        *PRICES_STORED.fields,
        T.StructField("batch_id", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)

# Per-ticker-year stats written beside each bar version (planning reads
# these instead of the bars); partition columns Universe, year.
TICKER_STATS = T.StructType(
    [
        T.StructField("Ticker", T.StringType(), False),
        T.StructField("first_date", T.DateType(), True),
        T.StructField("last_date", T.DateType(), True),
        T.StructField("n_bars", T.LongType(), False),
        T.StructField("Universe", T.StringType(), False),
    ]
)

COMPANY_INFO = T.StructType(
    [
        T.StructField("sharesOutstanding", T.DoubleType(), True),
        T.StructField("floatShares", T.DoubleType(), True),
    ]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("Universe", T.StringType(), False),
        T.StructField("Ticker", T.StringType(), False),
        T.StructField("attempt", T.IntegerType(), False),
        T.StructField("ok", T.BooleanType(), False),
        T.StructField("payload", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
        T.StructField("started_at", T.TimestampNTZType(), True),
        T.StructField("finished_at", T.TimestampNTZType(), True),
    ]
)

FREE_FLOAT = T.StructType(
    [
        T.StructField("Universe", T.StringType(), False),
        T.StructField("Ticker", T.StringType(), False),
        T.StructField(FF_SHARES, T.DoubleType(), True),
        T.StructField(FF_FLOAT, T.DoubleType(), True),
        T.StructField(FF_PCT, T.DoubleType(), True),
        T.StructField("Status", T.StringType(), True),
        T.StructField("Error", T.StringType(), True),
        T.StructField(FF_UPDATED, T.TimestampNTZType(), True),
    ]
)

# The first free-float job wrote five columns (no Status / Error).
FREE_FLOAT_V1_COLUMNS = ["Ticker", FF_SHARES, FF_FLOAT, FF_PCT, FF_UPDATED]

MARKS = T.StructType(
    [
        T.StructField("Universe", T.StringType(), False),
        T.StructField("run_id", T.StringType(), False),
        T.StructField("Ticker", T.StringType(), False),
    ]
)

# Work plan: one request window per row, end exclusive.
PLAN = T.StructType(
    [
        T.StructField("Universe", T.StringType(), False),
        T.StructField("Ticker", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("start_date", T.DateType(), True),
        T.StructField("end_date", T.DateType(), True),
    ]
)
