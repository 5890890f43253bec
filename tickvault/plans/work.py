"""Work plans (J1-J9): which tickers need work, and for which date window.

Every plan is one set-at-a-time join of the universe with stored state; the
reference's per-ticker list membership tests and full-table scans become hash
anti/semi joins and one aggregation. Plan rows are
``(Universe, Ticker, kind, start_date, end_date)`` with ``end_date`` exclusive,
plus whatever ordering columns the caller needs (``pos``).

No plan broadcasts on its own: joins are left to Catalyst and AQE, which
broadcast a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.functions.scalar import age_days, lit_date, lit_ts
from tickvault.operators.gaps import find_gaps
from tickvault.schemas import (
    DEFAULT_LOOKBACK_DAYS,
    DEFAULT_MIN_GAP_DAYS,
    DEFAULT_STALE_DAYS,
    DEFAULT_START,
    FF_UPDATED,
    STATUS_FAILED,
)

KEYS = ("Universe", "Ticker")


def _keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def prune_to_universes(stored: DataFrame, universe: DataFrame) -> DataFrame:
    """Keep only the stored partitions of the universes being planned.

    Stored tables are partitioned by ``Universe``; a literal ``IN`` filter
    becomes a partition filter of the scan, so a run reads only its own
    universes. The names are one per universe list, as the table's manifest
    is one entry per universe at least. An empty universe keeps nothing.
    """
    names = [r[0] for r in universe.select("Universe").distinct().collect()]
    if not names:
        return stored.filter(F.lit(False))
    return stored.filter(F.col("Universe").isin(names))


def plan_fresh(universe: DataFrame, stored: DataFrame, as_of, start=DEFAULT_START, keys: Sequence[str] = KEYS) -> DataFrame:
    """Universe tickers with no stored bar; window ``[start, as_of)``.

    Duplicate universe lines survive (the reference iterates the raw list).
    Anti join, never ``NOT IN``: one NULL stored key would empty the result.
    """
    keys = list(keys)
    return universe.join(_keys(stored, keys), keys, "left_anti").select(
        *universe.columns,
        F.lit("fresh").alias("kind"),
        lit_date(start).alias("start_date"),
        lit_date(as_of).alias("end_date"),
    )


def plan_resume(universe: DataFrame, stored: DataFrame, marks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Universe minus (stored keys ∪ marked keys); a stored row with NULL
    numbers counts as done."""
    keys = list(keys)
    done = stored.select(*keys).union(marks.select(*keys)).distinct()
    return universe.join(done, keys, "left_anti").withColumn("kind", F.lit("resume"))


def plan_stale(
    universe: DataFrame,
    free_float: DataFrame,
    marks: DataFrame | None,
    as_of,
    days: int = DEFAULT_STALE_DAYS,
    force: str | None = None,
    retry_failed: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Tickers due for a free-float refresh.

    Due when not marked in this run and: no stored row, ``Last Updated``
    missing or unparsable, or whole days of age ``>= days`` (age floored like
    ``timedelta.days``). FAILED rows are stamped too, so they are fresh unless
    ``retry_failed``. ``force="all"`` takes every ticker (v2); ``force=
    "ignore_marks"`` skips only the marks (v3).
    """
    keys = list(keys)
    if force not in (None, "all", "ignore_marks"):
        raise ValueError(f"force must be None, 'all' or 'ignore_marks', not {force!r}")
    base = universe
    if marks is not None and force is None:
        base = base.join(_keys(marks, keys), keys, "left_anti")
    if force == "all":
        return base.select(
            *universe.columns,
            F.lit("forced").alias("reason"),
            F.lit(None).cast(T.LongType()).alias("age_days"),
        )

    upd = F.col(FF_UPDATED)
    if not isinstance(free_float.schema[FF_UPDATED].dataType, T.TimestampNTZType):
        upd = upd.cast(T.StringType()).try_cast(T.TimestampNTZType())
    cols = [*keys, upd.alias("__ts"), F.lit(True).alias("__has_row")]
    if retry_failed and "Status" in free_float.columns:
        cols.append((F.col("Status") == STATUS_FAILED).alias("__failed"))
    else:
        cols.append(F.lit(False).alias("__failed"))
    state = free_float.select(*cols)

    age = age_days(F.col("__ts"), lit_ts(as_of))
    reason = (
        F.when(F.col("__has_row").isNull(), F.lit("missing"))
        .when(F.col("__ts").isNull(), F.lit("unparsable"))
        .when(F.col("__failed"), F.lit("failed"))
        .when(age >= F.lit(int(days)), F.lit("stale"))
    )
    return (
        base.join(state, keys, "left")
        .withColumn("reason", reason)
        .withColumn("age_days", age)
        .filter(F.col("reason").isNotNull())
        .select(*universe.columns, "reason", "age_days")
    )


def last_dates(prices: DataFrame, keys: Sequence[str] = KEYS, date_col: str = "Date") -> DataFrame:
    """A2/A3: first and last bar date per ticker (one partial aggregation)."""
    return prices.groupBy(*keys).agg(
        F.min(date_col).cast(T.DateType()).alias("first_date"),
        F.max(date_col).cast(T.DateType()).alias("last_date"),
        F.count(F.lit(1)).alias("n_bars"),
    )


def plan_update(
    universe: DataFrame,
    prices: DataFrame,
    as_of,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    start=DEFAULT_START,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Stored tickers whose last bar is before ``as_of`` -> ``update``
    from ``last - lookback_days``; unstored -> ``new`` from ``start``; window
    ends at ``as_of`` (exclusive). ``kind_rank`` lists updates before new."""
    keys = list(keys)
    last = prices.groupBy(*keys).agg(F.max("Date").cast(T.DateType()).alias("last_date"))
    return plan_update_from_last(universe, last, as_of, lookback_days=lookback_days, start=start, keys=keys)


def plan_update_from_last(
    universe: DataFrame,
    last: DataFrame,
    as_of,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    start=DEFAULT_START,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """J5 from a per-ticker ``last_date`` table (e.g. the stats written with
    each published version), so planning does not scan the bars."""
    keys = list(keys)
    last = last.select(*keys, F.col("last_date").cast(T.DateType()).alias("last_date"))
    as_of_d = lit_date(as_of)
    j = universe.join(last, keys, "left")
    kind = F.when(F.col("last_date").isNull(), F.lit("new")).when(F.col("last_date") < as_of_d, F.lit("update"))
    return (
        j.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .select(
            *universe.columns,
            "kind",
            "last_date",
            F.when(F.col("kind") == "update", F.date_sub("last_date", int(lookback_days)))
            .otherwise(lit_date(start))
            .alias("start_date"),
            as_of_d.alias("end_date"),
            F.when(F.col("kind") == "update", F.lit(0)).otherwise(F.lit(1)).alias("kind_rank"),
        )
    )


def plan_backfill(
    universe: DataFrame,
    prices: DataFrame,
    start=DEFAULT_START,
    min_gap_days: int = DEFAULT_MIN_GAP_DAYS,
    keys: Sequence[str] = KEYS,
    clip_to_start: bool = False,
) -> DataFrame:
    """Universe ⋉ stored, then the gap rules; tickers without rows are skipped.

    One plan row per gap, window ``[gap_start, gap_end + 1)``.
    """
    keys = list(keys)
    # gaps first, then the semi join: the gap rows are far fewer than the bars,
    # so the big side is shuffled once (by ticker-month), not twice
    gaps = find_gaps(prices, start=start, min_gap_days=min_gap_days, keys=keys, clip_to_start=clip_to_start)
    gaps = gaps.join(_keys(universe, keys), keys, "left_semi")
    return gaps.select(
        *keys,
        F.lit("backfill").alias("kind"),
        F.col("gap_start").alias("start_date"),
        F.date_add("gap_end", 1).alias("end_date"),
        "gap_start",
        "gap_end",
    )
