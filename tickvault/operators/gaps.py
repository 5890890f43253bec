"""Date-gap scan (W2-W5) of the backfill mode.

Semantics: per ticker, with its bar dates sorted,
* leading gap: first date more than ``min_gap_days`` after ``start`` ->
  ``[start, first - 1]``;
* interior gap: neighbours more than ``min_gap_days`` apart ->
  ``[prev + 1, next - 1]``, also before ``start`` unless ``clip_to_start``;
* a universe ticker with no bars -> ``[start, as_of]`` (only if a universe
  and ``as_of`` are given);
* no trailing gap (that is the update plan's job).

Plan: dates become one bit mask per (ticker, month) with map-side partial
aggregation, so neither copies of a bar nor a ticker with a third of all rows
ever meet in one task: what is shuffled is at most one row per ticker-month and
map task. The step between months is a ``lag`` over the month rows of a ticker
(twelve a year), the steps inside a month come from the bits. The ``lag`` and
what follows it by ticker run in tasks of :data:`BARS_PER_TASK` bars, whatever
number of shuffle partitions the session has, so a task's memory does not grow
with the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.functions.scalar import lit_date
from tickvault.schemas import DEFAULT_MIN_GAP_DAYS, DEFAULT_START

#: Bars whose months one task sorts by ticker (on average; a month row stands for one or more).
BARS_PER_TASK = 500_000

GAP_COLUMNS = ["gap_start", "gap_end", "gap_days"]


def _month(d):
    return (F.year(d) * 12 + F.month(d) - 1).cast(T.IntegerType())


_GAPS = "array<struct<gap_start:date,gap_end:date>>"


def _gap(begin, end):
    return F.struct(begin.alias("gap_start"), end.alias("gap_end"))


def _inside(n: int):
    """Gaps between the days of one month: set bits more than ``n`` apart."""
    month_start = F.trunc("first", "month")
    days = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda x: F.getbit("bits", x) == 1)

    def pairs(held):
        return F.transform(
            F.filter(F.sequence(F.lit(1), F.size(held) - 1), lambda i: F.get(held, i) - F.get(held, i - 1) > n),
            lambda i: _gap(F.date_add(month_start, F.get(held, i - 1) + 1), F.date_add(month_start, F.get(held, i) - 1)),
        )

    # most months are too short of free days to be looked at
    some = F.datediff("last", "first") - F.bit_count("bits") + 1 >= n
    once = F.flatten(F.transform(F.array(days), pairs))  # the days evaluated once a month
    return F.when(some & (F.bit_count("bits") > 1), once).otherwise(F.array().cast(_GAPS))


def find_gaps(
    bars: DataFrame,
    start=DEFAULT_START,
    min_gap_days: int = DEFAULT_MIN_GAP_DAYS,
    keys: Sequence[str] = ("Ticker",),
    date_col: str = "Date",
    universe: DataFrame | None = None,
    as_of=None,
    clip_to_start: bool = False,
) -> DataFrame:
    """Gaps as rows ``(*keys, gap_start, gap_end, gap_days)``, ends inclusive.

    ``gap_days`` is the inclusive length in days. Copies of a bar count once.
    """
    keys = list(keys)
    n = int(min_gap_days)
    start_d = lit_date(start)
    d = bars.select(*keys, F.col(date_col).cast(T.DateType()).alias("d")).filter(F.col("d").isNotNull())
    months = d.groupBy(*keys, _month(F.col("d")).alias("m")).agg(
        F.min("d").alias("first"),
        F.max("d").alias("last"),
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth("d") - 1)).alias("bits"),
    )
    # the bars are only counted (a Parquet table: from its footers); partial
    # aggregation has shuffled months, not bars, by then
    spark = bars.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-bars.count() // BARS_PER_TASK))
    # by the ticker alone: a universe that is a constant drops out of the window's keys
    months = months.repartition(tasks, keys[-1])
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("m"))
    found = F.when(
        F.datediff("first", F.coalesce("before", start_d)) > n,
        F.array(_gap(F.coalesce(F.date_add("before", 1), start_d), F.date_sub("first", 1))),
    ).otherwise(F.array().cast(_GAPS))
    if n < 30:  # days 1 and 31 are 30 apart
        found = F.concat(found, _inside(n))
    gaps = months.withColumn("before", before).select(*keys, F.inline(found))

    if universe is not None and as_of is not None:
        empty = (
            universe.select(*keys)
            # distinct keys aggregate map-side, so only one row per ticker is shuffled
            .join(d.select(*keys).distinct(), keys, "left_anti")
            .select(*keys, start_d.alias("gap_start"), lit_date(as_of).alias("gap_end"))
        )
        gaps = gaps.unionByName(empty)

    if clip_to_start:
        gaps = gaps.filter(F.col("gap_end") >= start_d).withColumn(
            "gap_start", F.greatest(F.col("gap_start"), start_d)
        )
    return gaps.withColumn("gap_days", (F.datediff("gap_end", "gap_start") + 1).cast(T.LongType()))
