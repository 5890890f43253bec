"""Apply request windows to landed rows (J7): a range join.

``Ticker`` equal and ``start_date <= Date < end_date``. The plan is written once
(it is read for its size, its overall dates and the join), as one row per
ticker and year holding the windows that touch the year. A plan of counted size
is broadcast: each bar looks its windows up and is never shuffled. A larger one
is cut into the half-years its windows touch and joined on ``(Ticker,
half-year)``, where a bar meets the few windows of its half-year (windows of a
ticker do not overlap, so 184 at most) and a ticker with a third of all bars is
spread over its half-years. (Cut into months, windows of a gappy table are more
rows to shuffle than the bars.) Plans with one window per ticker are not cut; beyond the broadcast
bound their tickers are spread by date over :data:`SALTS` keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.session import ensure_checkpoint_dir, shuffles_dropped

#: A plan of at most this many windows, or keys, (counted) is broadcast: about
#: 100 bytes each in memory, so 50 MB.
BROADCAST_PLAN_ROWS = 500_000
#: Keys a ticker is spread over when a plan of whole windows is shuffled.
SALTS = 16
SALT = "__salt"
#: Months a window is cut into when a plan beyond the broadcast bound is shuffled.
MONTHS = 6


def _month_index(d):
    """The number of the block of :data:`MONTHS` months (a divisor of 12) that a date is in."""
    return F.floor((F.year(d) * 12 + F.month(d) - 1) / MONTHS).cast(T.IntegerType())


def _by_year(plan: DataFrame, keys: list[str], plan_cols: Sequence[str]) -> DataFrame:
    """(keys, __y, __w): windows touching year ``__y`` as an array."""
    window = F.struct(F.col("start_date").alias("__s"), F.col("end_date").alias("__e"), *plan_cols)
    years = F.explode(F.sequence(F.year("start_date"), F.year(F.date_sub("end_date", 1))))
    return plan.select(*keys, window.alias("__w"), years.alias("__y")).groupBy(*keys, "__y").agg(F.collect_list("__w").alias("__w"))


def _by_month(years: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __m, window): one row per window and block of months touched."""
    flat = years.select(*keys, "__y", F.inline("__w"))
    first = F.greatest("__s", F.make_date("__y", F.lit(1), F.lit(1)))
    last = F.least(F.date_sub("__e", 1), F.make_date("__y", F.lit(12), F.lit(31)))
    return flat.withColumn("__m", F.explode(F.sequence(_month_index(first), _month_index(last)))).drop("__y")


def apply_windows(
    raw: DataFrame,
    plan: DataFrame,
    keys: Sequence[str] = ("Ticker",),
    plan_cols: Sequence[str] = (),
    date_col: str = "Date",
    broadcast_max_rows: int = BROADCAST_PLAN_ROWS,
    one_window: bool = False,
    keep_salt: bool = False,
    scratch: str | None = None,
) -> DataFrame:
    """Rows of ``raw`` inside a plan window of the same key.

    ``plan_cols`` are plan columns to carry to the output (e.g. the window
    bounds, to count rows per window). The plan's overall ``[min start, max
    end)`` is a literal filter on ``raw``: a join range is never pushed to a
    scan, a literal one is (row-group skipping, date partition pruning).

    ``one_window`` is for plans with one window per key (fresh, update). Equal
    windows (a ticker listed twice) are then applied once. ``keep_salt`` leaves
    :data:`SALT`, which follows from the date, on rows that were shuffled by it,
    so that a window by ticker and date need not shuffle them again. ``scratch``
    is a folder for the windows, to be removed once the rows have been read; by
    default they are checkpointed.
    """
    keys, d = list(keys), F.col(date_col).cast(T.DateType())
    real = plan.filter("end_date > start_date")
    kept_at = materialise if scratch is None else lambda df: spooled(df, scratch)
    if one_window:
        p = kept_at(real.select(*keys, F.col("start_date").alias("__s"), F.col("end_date").alias("__e")).distinct())
        size, lo, hi = F.count(F.lit(1)), F.min("__s"), F.max("__e")
    else:
        p = kept_at(_by_year(real, keys, plan_cols))
        size = F.sum(F.size("__w"))
        lo, hi = F.min(F.array_min("__w")["__s"]), F.max(F.array_max(F.transform("__w", lambda w: w["__e"])))
    b = p.agg(size.alias("n"), lo.alias("lo"), hi.alias("hi")).first()
    if b.lo is not None:
        raw = raw.filter((d >= F.lit(b.lo)) & (d < F.lit(b.hi)))
    small = (b.n or 0) <= broadcast_max_rows
    columns = [F.col(c) for c in raw.columns]
    if one_window:
        inside = (d >= F.col("__s")) & (d < F.col("__e"))
        if small:
            return raw.join(F.broadcast(p), keys).filter(inside).select(*columns)
        spread = p.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = raw.withColumn(SALT, F.pmod(F.unix_date(d), F.lit(SALTS)))
        kept = [*columns, F.col(SALT)] if keep_salt else columns
        return salted.join(spread.hint("merge"), [*keys, SALT]).filter(inside).select(*kept)
    if small:
        hits = F.filter("__w", lambda w: (d >= w["__s"]) & (d < w["__e"]))
        met = raw.withColumn("__y", F.year(d)).join(F.broadcast(p), [*keys, "__y"])
        return met.select(*columns, F.inline(hits)).drop("__s", "__e")
    met = raw.withColumn("__m", _month_index(d)).join(_by_month(p, keys).hint("merge"), [*keys, "__m"])
    return met.filter((d >= F.col("__s")) & (d < F.col("__e"))).select(*columns, *plan_cols)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of a plan that is read more than once.

    ``checkpoint()`` writes it to the cluster's shared
    ``spark.checkpoint.dir`` (reliable: survives lost executors), so the
    windows join, the report and any size check read it without recomputing
    the gap scan or the stored-state aggregation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def spooled(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path``, compressed by column, and read back: for the
    large tables of a run, whose folder the run removes."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]  # Parquet has no such columns
    with shuffles_dropped(df.sparkSession):
        df.select(*[F.col(f"`{f.name}`") for f in fields]).write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(T.StructType(fields)).parquet(path)
    held = {f.name for f in fields}
    return back.select(*[F.col(f"`{c}`") if c in held else F.lit(None).alias(c) for c in df.columns])
