"""Run reports (A4-A10, O3, O4, W6) as DataFrames.

Totals are global aggregations with partial (map-side) aggregation; a count
needed next to a sample is a scalar subquery (``DataFrame.scalar()``), so no
report joins a row set with another row set without a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.functions.scalar import round_half_up
from tickvault.operators.positions import dense_position
from tickvault.schemas import STATUS_FAILED

KEYS = ["Universe", "Ticker"]
# Fixed value: characters of an error shown in a failure listing.
ERROR_DISPLAY_CHARS = 100


def _count(df: DataFrame):
    return df.select(F.count(F.lit(1))).scalar()


def gap_totals(universe: DataFrame, plan: DataFrame) -> DataFrame:
    """Tickers scanned (the whole universe, also those without bars),
    tickers with gaps, total gaps."""
    per_ticker = plan.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return per_ticker.agg(
        F.count(F.lit(1)).alias("tickers_with_gaps"),
        F.coalesce(F.sum("n"), F.lit(0)).cast(T.LongType()).alias("total_gaps"),
    ).select(_count(universe).alias("tickers_scanned"), "tickers_with_gaps", "total_gaps")


def gap_sample(universe: DataFrame, plan: DataFrame, tickers: int = 5, per_ticker: int = 3) -> DataFrame:
    """First ``tickers`` tickers with gaps in universe order, first
    ``per_ticker`` gaps each, ``length_days = end - start`` as printed, and
    how many gaps are not shown."""
    per = plan.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("gaps_of_ticker"))
    pos = universe.groupBy(*KEYS).agg(F.min("pos").alias("pos"))
    # top-k is the feature: TakeOrderedAndProject keeps k rows per task
    first = per.join(pos, KEYS, "inner").orderBy("pos", "Ticker").limit(int(tickers))
    first = first.withColumn("ticker_rank", F.row_number().over(Window.orderBy("pos", "Ticker")).cast(T.LongType()))
    g = plan.join(first, KEYS, "inner")
    w = Window.partitionBy(*KEYS).orderBy("gap_start")
    return (
        g.withColumn("gap_rank", F.row_number().over(w).cast(T.LongType()))
        .filter(F.col("gap_rank") <= int(per_ticker))
        .select(
            "ticker_rank",
            *KEYS,
            "gap_rank",
            "gap_start",
            "gap_end",
            F.datediff("gap_end", "gap_start").cast(T.LongType()).alias("length_days"),
            "gaps_of_ticker",
            F.greatest(F.col("gaps_of_ticker") - int(per_ticker), F.lit(0)).cast(T.LongType()).alias("more_gaps"),
        )
    )


def _failed(j: DataFrame, resolved: DataFrame | None):
    """``j`` with the resolved status, and the test for exhausted tries."""
    if resolved is None:
        return j, F.lit(False)
    j = j.join(resolved.select(*KEYS, "Status").distinct(), KEYS, "left")
    return j, F.coalesce(F.col("Status") == STATUS_FAILED, F.lit(False))


def fetched_counts(fetched: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows fetched per window or ticker (small; materialise it once)."""
    return fetched.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_fetched"))


def fill_outcome(plan: DataFrame, fills: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Per gap window, rows fetched and ``filled`` / ``empty``, or
    ``failed`` where the ticker's tries are exhausted. ``fills`` are the rows,
    or their :func:`fetched_counts` by window."""
    got = fills if "rows_fetched" in fills.columns else fetched_counts(fills, [*KEYS, "start_date"])
    j = plan.select(*KEYS, "start_date", "end_date").join(got, [*KEYS, "start_date"], "left")
    j, failed = _failed(j, resolved)
    n = F.when(failed, F.lit(0)).otherwise(F.coalesce(F.col("rows_fetched"), F.lit(0))).cast(T.LongType())
    return j.select(
        *KEYS,
        "start_date",
        "end_date",
        n.alias("rows_fetched"),
        F.when(failed, F.lit("failed")).when(n > 0, F.lit("filled")).otherwise(F.lit("empty")).alias("outcome"),
    )


def fill_totals(outcome: DataFrame) -> DataFrame:
    """Gaps filled, empty and failed per universe, rows fetched in total."""
    return outcome.groupBy("Universe").agg(
        F.count_if(F.col("outcome") == "filled").alias("filled"),
        F.count_if(F.col("outcome") == "empty").alias("empty"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.sum("rows_fetched").cast(T.LongType()).alias("rows_fetched"),
    )


def failed_gaps(outcome: DataFrame, n: int = 10) -> DataFrame:
    """O3 of a backfill: the first ``n`` failed gaps as ``ticker [start->end]``
    (last day shown) and how many more failed."""
    failed = outcome.filter(F.col("outcome") == "failed")
    more = F.greatest(_count(failed) - F.lit(int(n)), F.lit(0)).cast(T.LongType())
    top = failed.orderBy(*KEYS, "start_date").limit(int(n))
    label = F.concat(
        F.col("Ticker"), F.lit(" ["), F.col("start_date").cast("string"), F.lit("->"),
        F.date_sub("end_date", 1).cast("string"), F.lit("]"),
    )
    rank = F.row_number().over(Window.orderBy(*KEYS, "start_date")).cast(T.LongType())
    return top.select(rank.alias("rank"), label.alias("gap"), more.alias("more_failed"))


def failed_list(resolved: DataFrame, order_key: str = "pos", n: int = 10) -> DataFrame:
    """O3 of a run summary: the first ``n`` failed tickers joined with ``, ``
    and ``... and N more`` (one row; no failure gives an empty list)."""
    failed = resolved.filter(F.col("Status") == STATUS_FAILED)
    top = failed.orderBy(order_key, "Ticker").limit(int(n))
    first = F.array_sort(F.collect_list(F.struct(F.col(order_key).alias("o"), F.col("Ticker").alias("t"))))
    total = _count(failed)
    more = total - F.lit(int(n))
    return top.agg(F.array_join(F.transform(first, lambda x: x["t"]), ", ").alias("failed_list")).select(
        "failed_list",
        F.when(more > 0, F.concat(F.lit("... and "), more.cast("string"), F.lit(" more"))).alias("more"),
        total.alias("failed"),
    )


def work_counts(universe: DataFrame, plan: DataFrame) -> DataFrame:
    """A4 for fresh, resume, stale and backfill runs: listed lines, lines whose
    ticker the plan has work for, and the rest, per universe. As in every
    report a line counts, so a ticker listed twice counts twice."""
    planned = plan.select(*KEYS).distinct().withColumn("planned", F.lit(True))
    return universe.join(planned, KEYS, "left").groupBy("Universe").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("planned").alias("due"),
        F.count_if(F.col("planned").isNull()).alias("done"),
    )


def plan_counts(universe: DataFrame, plan: DataFrame) -> DataFrame:
    """A4: universe size, to update, new, already current — per universe."""
    u = universe.groupBy("Universe").agg(F.count(F.lit(1)).alias("total"))
    p = plan.groupBy("Universe").agg(
        F.count_if(F.col("kind") == "update").alias("to_update"),
        F.count_if(F.col("kind") == "new").alias("new"),
    )
    j = u.join(p, "Universe", "left")
    upd = F.coalesce(F.col("to_update"), F.lit(0)).cast(T.LongType())
    new = F.coalesce(F.col("new"), F.lit(0)).cast(T.LongType())
    return j.select(
        "Universe",
        "total",
        upd.alias("to_update"),
        new.alias("new"),
        (F.col("total") - upd - new).alias("current"),
    )


def update_outcome(plan: DataFrame, fetched: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Per plan row: rows fetched (overlap included), and ``failed`` (tries
    exhausted) / ``success`` (rows) / ``skipped`` (none). A ticker listed twice
    has two plan rows that each report its one fetch: ``fetched`` holds rows of
    distinct windows, or their :func:`fetched_counts` by ticker."""
    got = fetched if "rows_fetched" in fetched.columns else fetched_counts(fetched, KEYS)
    j = plan.select(*KEYS, "kind").join(got, KEYS, "left")
    j, failed = _failed(j, resolved)
    n = F.coalesce(F.col("rows_fetched"), F.lit(0)).cast(T.LongType())
    outcome = F.when(failed, F.lit("failed")).when(n > 0, F.lit("success")).otherwise(F.lit("skipped"))
    return j.select(*KEYS, "kind", F.when(failed, F.lit(0)).otherwise(n).cast(T.LongType()).alias("rows_fetched"), outcome.alias("outcome"))


def outcome_totals(outcome: DataFrame) -> DataFrame:
    """Counts per outcome and universe, rows fetched in total."""
    return outcome.groupBy("Universe").agg(
        F.count_if(F.col("outcome") == "success").alias("success"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.sum("rows_fetched").cast(T.LongType()).alias("rows_fetched"),
    )


def progress(plan: DataFrame, order_key: str, batch_size: int = 10, partition_cols: Sequence[str] = ("Universe",)) -> DataFrame:
    """Running position, percent done (1 decimal) and work batch.

    Positions come from :func:`dense_position`, so a universe is not one task.
    """
    parts = list(partition_cols)
    p = dense_position(plan, parts, order_key, out="position")
    totals = plan.groupBy(*parts).agg(F.count(F.lit(1)).alias("total"))
    p = p.join(totals, parts, "inner")
    return p.withColumn(
        "pct_done", round_half_up(F.col("position") * F.lit(100.0) / F.col("total"), 1)
    ).withColumn("batch", F.floor((F.col("position") - 1) / F.lit(int(batch_size))).cast(T.LongType()))


def resume_progress(
    plan: DataFrame,
    universe: DataFrame,
    done: DataFrame,
    order_key: str = "pos",
    partition_cols: Sequence[str] = ("Universe",),
) -> DataFrame:
    """W6 as the reference prints it after a resume: the position counts on
    from the tickers already done (distinct stored keys of the universe's
    table, also those no longer listed), over the universe size — so it can
    pass 100 %."""
    parts = list(partition_cols)
    p = dense_position(plan, parts, order_key, out="position")
    total = universe.groupBy(*parts).agg(F.count(F.lit(1)).alias("universe_total"))
    offset = done.select(*parts, "Ticker").distinct().groupBy(*parts).agg(F.count(F.lit(1)).alias("done_before"))
    j = p.join(total, parts, "inner").join(offset, parts, "left")
    run_pos = F.coalesce(F.col("done_before"), F.lit(0)) + F.col("position")
    return j.select(
        *plan.columns,
        "position",
        run_pos.cast(T.LongType()).alias("run_position"),
        "universe_total",
        round_half_up(run_pos * F.lit(100.0) / F.col("universe_total"), 1).alias("pct_done"),
    )


def failure_sample(resolved: DataFrame, order_key: str = "pos", n: int = 10) -> DataFrame:
    """O3: first ``n`` failures in processing order (error cut to 100 chars)
    and how many more failed."""
    failed = resolved.filter(F.col("Status") == STATUS_FAILED)
    more = F.greatest(failed.select(F.count(F.lit(1))).scalar() - F.lit(int(n)), F.lit(0)).cast(T.LongType())
    top = failed.orderBy(order_key, "Ticker").limit(int(n))
    return top.select(
        F.row_number().over(Window.orderBy(order_key, "Ticker")).cast(T.LongType()).alias("rank"),
        *KEYS,
        F.substring("Error", 1, ERROR_DISPLAY_CHARS).alias("error_head"),
        more.alias("more_failed"),
    )


def timing(resolved: DataFrame, due: DataFrame) -> DataFrame:
    """A10: tickers done, wall seconds from first start to last finish, mean
    seconds per ticker, tickers left in the plan and the time they need."""
    left = due.select(*KEYS).join(resolved.select(*KEYS), KEYS, "left_anti")
    agg = resolved.agg(
        F.count(F.lit(1)).alias("done"),
        F.min("started_at").alias("t0"),
        F.max("finished_at").alias("t1"),
    )
    secs = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("t1")) / F.lit(1e6)
    mean = secs / F.col("done")
    remaining = _count(left)
    return agg.select(
        "done",
        round_half_up(secs, 3).alias("total_seconds"),
        round_half_up(mean, 3).alias("mean_seconds"),
        remaining.alias("remaining"),
        round_half_up(mean * remaining, 3).alias("eta_seconds"),
    )


def run_summary(
    outcome: DataFrame, plan: DataFrame, stats: DataFrame, resolved: DataFrame | None = None, n: int = 10
) -> DataFrame:
    """Closing summary of a run, one row a universe: lines (or gaps) per
    outcome, the first ``n`` failed tickers in list order joined with ``, `` and
    how many more, rows and tickers now stored, and, if the tries are known,
    seconds in total and per ticker tried. ``outcome`` is
    :func:`update_outcome` or :func:`fill_outcome`; ``stats`` the per-ticker
    counts of the stored table."""
    counts = outcome.groupBy("Universe").agg(
        F.count_if(F.col("outcome").isin("success", "filled")).alias("success"),
        F.count_if(F.col("outcome").isin("skipped", "empty")).alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    # failed lines in list order, or gaps in order of ticker and date
    order = ["pos"] if "pos" in plan.columns else ["start_date"]
    lines = plan.select(*KEYS, *order).join(outcome.filter("outcome = 'failed'").select(*KEYS).distinct(), KEYS, "left_semi")
    rank = F.row_number().over(Window.partitionBy("Universe").orderBy(*order, "Ticker"))
    first = lines.withColumn("rank", rank).filter(F.col("rank") <= int(n)).groupBy("Universe").agg(
        F.array_sort(F.collect_list(F.struct("rank", "Ticker"))).alias("first")
    )
    held = stats.groupBy("Universe").agg(F.sum("n_bars").cast(T.LongType()).alias("table_rows"), F.count(F.lit(1)).alias("table_tickers"))
    out = counts.join(first, "Universe", "left").join(held, "Universe", "left")
    seconds = F.lit(None).cast("double")
    mean = seconds
    if resolved is not None:
        tried = resolved.join(plan.select(*KEYS).distinct(), KEYS, "left_semi").groupBy("Universe").agg(
            F.count(F.lit(1)).alias("tried"), F.min("started_at").alias("t0"), F.max("finished_at").alias("t1")
        )
        out = out.join(tried, "Universe", "left")
        took = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("t1")) / F.lit(1e6)
        seconds, mean = round_half_up(took, 3), round_half_up(took / F.col("tried"), 3)
    return out.select(
        "Universe",
        "success",
        "skipped",
        "failed",
        F.coalesce(F.array_join(F.transform("first", lambda x: x["Ticker"]), ", "), F.lit("")).alias("failed_list"),
        F.greatest(F.col("failed") - int(n), F.lit(0)).cast(T.LongType()).alias("more_failed"),
        F.coalesce("table_rows", F.lit(0)).cast(T.LongType()).alias("table_rows"),
        F.coalesce("table_tickers", F.lit(0)).cast(T.LongType()).alias("table_tickers"),
        seconds.alias("total_seconds"),
        mean.alias("mean_seconds"),
    )


def table_stats(prices: DataFrame, keys: Sequence[str] = ("Universe",)) -> DataFrame:
    """A1/A9 (+A2/A3): rows, distinct tickers, first and last date per universe."""
    per = prices.groupBy(*keys, "Ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min("Date").alias("d0"), F.max("Date").alias("d1")
    )
    return per.groupBy(*keys).agg(
        F.sum("n").cast(T.LongType()).alias("rows"),
        F.count(F.lit(1)).alias("tickers"),
        F.min("d0").alias("first_date"),
        F.max("d1").alias("last_date"),
    )
