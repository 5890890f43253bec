"""Quote normalisation (N1-N7): landed raw quotes -> canonical bar rows.

All steps are projections: no shuffle. Wide multi-ticker frames are turned
long with one ``stack`` generator (the tickers come from the column labels,
so the driver only reads the schema).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.functions.scalar import local_date, local_date_of_instant
from tickvault.schemas import PRICE_COLUMNS, PRICES


def _q(name: str) -> Column:
    """Column by exact label (labels may hold dots, e.g. ``Close_BB.L``)."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip_column_names(df: DataFrame) -> DataFrame:
    """Strip white space around every column label."""
    return df.toDF(*[str(c).strip() for c in df.columns])


# Label layouts of wide landed frames: ``Close_AAA`` and a stringified
# two-level label ``('Close', 'AAA')``.
UNDERSCORE_LABEL = r"^(?P<field>[A-Za-z]+)_(?P<ticker>.+)$"
TUPLE_LABEL = r"^\(\s*'(?P<field>[^']+)'\s*,\s*'(?P<ticker>[^']+)'\s*\)$"


def unstack_wide(
    df: DataFrame,
    id_cols: list[str],
    sep: str | None = None,
    fields=tuple(PRICE_COLUMNS[2:]),
    pattern: str = UNDERSCORE_LABEL,
    drop_empty: bool = False,
) -> DataFrame:
    """One column per (field, ticker) -> one row per (id, Ticker).

    ``pattern`` is a regex with ``field`` and ``ticker`` groups (see
    ``UNDERSCORE_LABEL``, ``TUPLE_LABEL``); ``sep`` is a shortcut for
    ``<Field><sep><Ticker>``. Labels are stripped first; a field missing for
    a ticker is NULL; ``drop_empty`` drops rows with no field at all (a wide
    frame has a cell for every ticker and day). Only the schema is read on the
    driver.
    """
    import re

    df = strip_column_names(df)
    rx = re.compile(rf"^(?P<field>[^{re.escape(sep)}]+){re.escape(sep)}(?P<ticker>.+)$" if sep else pattern)
    tickers: dict[str, dict[str, str]] = {}
    for c in df.columns:
        m = rx.match(c) if c not in id_cols else None
        if m and m.group("field") in fields:
            tickers.setdefault(m.group("ticker"), {})[m.group("field")] = c
    present = [f for f in fields if any(f in m for m in tickers.values())]
    if not tickers:
        return df.select(*id_cols, F.lit(None).cast(T.StringType()).alias("Ticker"), *[F.lit(None).alias(f) for f in present]).filter(F.lit(False))
    args = []
    for t, m in sorted(tickers.items()):
        args.append(F.lit(t))
        for f in present:
            args.append(_q(m[f]).cast(T.DoubleType()) if f in m else F.lit(None).cast(T.DoubleType()))
    gen = F.stack(F.lit(len(tickers)), *args).alias("Ticker", *present)
    long = df.select(*id_cols, gen)
    return long.dropna(how="all", subset=present) if drop_empty else long


def _to_date(c: Column, dtype: T.DataType, exchange_tz) -> Column:
    """Keep the exchange's wall clock; never shift local bars to UTC."""
    if exchange_tz is None:
        if isinstance(dtype, T.TimestampType):
            raise ValueError("an instant has a local date only with exchange_tz; the session zone would shift it")
        return c.cast(T.DateType())
    if isinstance(dtype, T.TimestampType):
        return local_date_of_instant(c, exchange_tz)
    if isinstance(dtype, T.TimestampNTZType):
        return local_date(c, exchange_tz, naive_is_utc=True)
    return c.cast(T.DateType())


def normalize_quotes(
    raw: DataFrame,
    ticker: str | None = None,
    ticker_col: str | None = None,
    date_col: str = "Date",
    exchange_tz=None,
) -> DataFrame:
    """Canonical ``Ticker, Date, Open, High, Low, Close, Volume``.

    ``ticker`` stamps one symbol (single-ticker frame) or ``ticker_col`` names
    the landed symbol column. ``exchange_tz`` (name or column) turns instants
    into local dates; naive timestamps are taken as UTC instants. Columns the
    source lacks are added as NULL; extra columns are dropped.
    """
    df = strip_column_names(raw)
    date_col = date_col.strip()
    dtype = df.schema[date_col].dataType
    sym = F.lit(ticker) if ticker is not None else _q(ticker_col).cast(T.StringType())
    out = []
    for f in PRICES.fields:
        if f.name == "Ticker":
            out.append(sym.alias("Ticker"))
        elif f.name == "Date":
            out.append(_to_date(_q(date_col), dtype, exchange_tz).alias("Date"))
        elif f.name in df.columns:
            out.append(_q(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)
