"""The three maintenance jobs of the reference as set-at-a-time Spark runs.

``maintain_prices`` (modes ``fresh`` / ``update`` / ``backfill``) and
``maintain_free_float`` read the universe, the stored state and the landed raw
rows, plan the work, take the rows the plan asks for, merge newest-wins and
publish one new snapshot version; the run report is returned as DataFrames.
All clocks are the explicit ``as_of``.

Scale notes: fresh/update plans join the universe with the per-ticker stats
written beside the table (never a scan per ticker, and no scan of the bars);
backfill plans scan only the run's universes. The landed rows meet the plan
through the range join by blocks of months (broadcast only after a count; the
plan's date range is pushed to the scan). Only the landed rows are shuffled
for newest-wins (partial group limit before the exchange); stored rows pass
an anti join. The publish reads and rewrites only the (universe, year)
partitions that fetched rows land in (none: no new version) and commits data
and stats with one manifest, against the version it started from, so neither a
lost executor nor a second run leaves a half table or loses an update.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.operators import freefloat as ffo
from tickvault.operators import reports as rep
from tickvault.operators.merge import merge_latest
from tickvault.plans import work
from tickvault.plans.windows import BROADCAST_PLAN_ROWS, SALT, apply_windows, materialise, spooled
from tickvault.schemas import (
    DEFAULT_LOOKBACK_DAYS,
    DEFAULT_MAX_RETRY,
    DEFAULT_MIN_GAP_DAYS,
    DEFAULT_STALE_DAYS,
    DEFAULT_START,
    FREE_FLOAT,
    PRICES_STORED,
    TICKER_STATS,
)
from tickvault.session import shared_dir
from tickvault.sinks.files import remove
from tickvault.sinks.marks import clear_marks, stored_marks, write_marks
from tickvault.sinks.publish import Snapshot, publish, read_table, snapshot
from tickvault.sources.universe import UniverseSource, read_marks

KEYS = ["Universe", "Ticker"]
BAR_KEYS = ["Universe", "Ticker", "Date"]


# Bars are stored by universe and calendar year: an update run rewrites only
# the years its request windows reach (usually the current one).
BAR_PARTITIONS = ["Universe", "year"]


def bar_stats(bars: DataFrame) -> DataFrame:
    """A1/A2/A3/A9 per ticker and year; written beside every bar version."""
    return bars.groupBy(*BAR_PARTITIONS, "Ticker").agg(
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
        F.count(F.lit(1)).alias("n_bars"),
    )


def ticker_stats(spark: SparkSession, store_root: str, at: Snapshot | None = None) -> DataFrame | None:
    """Per-ticker first/last date and bar count from the stats written beside
    the bars (one row per ticker-year), or None when the table has no stats."""
    st = read_table(spark, store_root, TICKER_STATS, at=at, side="stats")
    if st is None:
        return None
    return st.groupBy("Universe", "Ticker").agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("n_bars").cast(T.LongType()).alias("n_bars"),
    )


def touched_partitions(rows: DataFrame) -> set[tuple[str | None, str | None]]:
    """(Universe, year) partitions that rows land in; like the manifest they
    are one entry a partition, never one a row."""
    years = rows.select("Universe", F.year("Date").cast(T.StringType()).alias("year")).distinct()
    return {(r.Universe, r.year) for r in years.collect()}


def _listed(spark: SparkSession, universe: DataFrame | UniverseSource) -> DataFrame:
    return universe.load(spark) if isinstance(universe, UniverseSource) else universe


@dataclass
class RunResult:
    version: int | None
    plan: DataFrame
    report: DataFrame
    totals: DataFrame
    #: builds one row a universe: outcomes, failures, stored rows, times
    summary: Callable[[], DataFrame] | None = None


def maintain_prices(
    spark: SparkSession,
    universe: DataFrame | UniverseSource,
    landed: DataFrame,
    store_root: str,
    mode: str,
    as_of,
    start=DEFAULT_START,
    min_gap_days: int = DEFAULT_MIN_GAP_DAYS,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    attempts: DataFrame | None = None,
    max_retry: int = DEFAULT_MAX_RETRY,
    run_id: str | None = None,
) -> RunResult:
    """Plan, fetch (from ``landed``), merge and publish the daily-bar table.

    Only the (universe, year) partitions of rows actually fetched are read and
    rewritten; a run that fetches nothing publishes nothing.

    ``landed`` holds normalised bars ``(Universe, Ticker, Date, ...)`` with a
    ``seq`` write order; ``attempts`` (optional) marks tickers whose fetch
    failed after ``max_retry`` tries — their rows are not taken.
    """
    # the version is resolved once; the publish fails if the table moves on meanwhile
    universe = _listed(spark, universe)
    now = snapshot(spark, store_root)
    v0 = now.version if now else None
    by_year = now is None or now.by == BAR_PARTITIONS
    stored = read_table(spark, store_root, PRICES_STORED, at=now) if now else spark.createDataFrame([], PRICES_STORED)
    if mode in ("update", "backfill") and v0 is None:
        # as the reference: these modes need a stored table (run "fresh" first)
        raise ValueError(f"mode={mode!r} needs a stored table at {store_root}; run mode='fresh' first")
    # planning reads only the universes of this run (partition filter), and
    # for fresh/update only the per-ticker stats written with the table
    mine = work.prune_to_universes(stored, universe)
    stats = ticker_stats(spark, store_root, now) if now and by_year else None
    mine_stats = work.prune_to_universes(stats, universe) if stats is not None else None
    if mode == "fresh":
        plan = work.plan_fresh(universe, mine_stats if mine_stats is not None else mine, as_of, start=start)
    elif mode == "update":
        if mine_stats is not None:
            plan = work.plan_update_from_last(universe, mine_stats, as_of, lookback_days=lookback_days, start=start)
        else:
            plan = work.plan_update(universe, mine, as_of, lookback_days=lookback_days, start=start)
    elif mode == "backfill":
        plan = work.plan_backfill(universe, mine, start=start, min_gap_days=min_gap_days)
    else:
        raise ValueError("mode must be 'fresh', 'update' or 'backfill'")

    plan = materialise(plan)
    if plan.isEmpty():
        # nothing missing, stale or gappy: no fetch, no publish (the plan is
        # materialised, so this check reads a few files)
        empty = plan.select(*KEYS).filter(F.lit(False))
        return RunResult(v0, plan, empty, empty.groupBy("Universe").count())
    resolved = None
    take = plan
    if attempts is not None:
        resolved = materialise(ffo.resolve_attempts(attempts, max_retry=max_retry, run_id=run_id))
        failed = resolved.filter(F.col("Status") == "FAILED").select(*KEYS)
        take = materialise(plan.join(failed, KEYS, "left_anti"))
    by = [*KEYS, "start_date"] if mode == "backfill" else KEYS
    scratch = None
    if v0 is not None:
        # the large tables of this run: gone when it ends
        scratch = shared_dir(spark, f"prices/{uuid.uuid4().hex}")
    try:
        windowed = apply_windows(
            landed,
            take,
            keys=KEYS,
            plan_cols=["start_date"],
            one_window=mode != "backfill",
            keep_salt=v0 is None,  # a first load goes from the join into the merge
            scratch=f"{scratch}/windows" if scratch else None,
        )
        dealt_by = [SALT] if SALT in windowed.columns else []
        cols = [f.name for f in PRICES_STORED.fields]
        if v0 is None:
            # a first load is written once, into the table; its report counts the
            # landed rows when it is read
            fetched = windowed
            counts = rep.fetched_counts(fetched, by)
        else:
            # read by the merge, the counts and the partition list: fetched once
            read = {c.lower() for c in [*cols, "seq", "start_date"]}
            fetched = spooled(windowed.select(*[F.col(c) for c in windowed.columns if c.lower() in read]), f"{scratch}/fetched")
            remove(spark, f"{scratch}/windows")
            counts = materialise(rep.fetched_counts(fetched, by))

        def result(version):
            if mode == "backfill":
                report = rep.fill_outcome(plan, counts, resolved)
                totals = rep.fill_totals(report)
            else:
                report = rep.update_outcome(plan, counts, resolved)
                totals = rep.outcome_totals(report)

            def summary():
                held = ticker_stats(spark, store_root, snapshot(spark, store_root, version)) if version is not None else None
                if held is None:  # no table, or one of a layout without statistics
                    held = work.last_dates(stored)
                return rep.run_summary(report, plan, held, resolved)

            return RunResult(version, plan, report, totals, summary)

        touched = touched_partitions(fetched) if v0 is not None else set()
        if v0 is not None and not touched:
            return result(v0)

        batch = (v0 or 0) + 1
        new_rows = fetched.drop("start_date").withColumn("batch_id", F.lit(batch).cast(T.LongType()))
        if "seq" not in new_rows.columns:
            new_rows = new_rows.withColumn("seq", F.lit(0).cast(T.LongType()))
        incremental = by_year and v0 is not None
        if incremental:
            # every other partition stays with the write it came from
            base_part = read_table(spark, store_root, PRICES_STORED, at=now, only=touched.__contains__)
        else:
            base_part = stored if v0 is not None else None
        n_fetched = 0 if v0 is None else counts.agg(F.sum("rows_fetched")).first()[0]
        few = n_fetched <= BROADCAST_PLAN_ROWS
        # a feed's own order may tie; the row hash makes a recomputed task pick the same row
        merged = merge_latest(
            base_part,
            new_rows.select(*cols, "batch_id", "seq", *dealt_by),
            BAR_KEYS,
            ("batch_id", "seq"),
            deterministic_ties=True,
            broadcast_keys=few,
            no_null_keys=True,  # rows of request windows
            dealt_by=dealt_by,
        ).select(*cols)
        if not few:
            # the shuffles of the merge go before the one of the publish is written
            merged = spooled(merged, f"{scratch}/merged")
            remove(spark, f"{scratch}/fetched")
        version = publish(
            merged.withColumn("year", F.year("Date")),
            store_root,
            partition_by=BAR_PARTITIONS,
            sort_within=[F.col("Ticker"), F.asc_nulls_last("Date")],  # O1: missing dates last
            only_partitions=incremental,
            sides={"stats": bar_stats},
            at=now,
            commit_nothing=False,
        )
        return result(version)
    finally:
        if scratch:
            remove(spark, scratch)


def maintain_free_float(
    spark: SparkSession,
    universe: DataFrame | UniverseSource,
    attempts: DataFrame,
    store_root: str,
    as_of,
    marks: DataFrame | None = None,
    days: int = DEFAULT_STALE_DAYS,
    force: str | None = None,
    retry_failed: bool = False,
    max_retry: int = DEFAULT_MAX_RETRY,
    on_failure: str = "replace",
    success_rule: str = "call",
    plan: str = "stale",
    run_id: str | None = None,
    commit_every: int | None = None,
    on_commit: Callable[[int], None] | None = None,
) -> RunResult:
    """Plan -> resolve tries -> free-float rows -> upsert -> publish.

    ``plan="stale"`` is the v2/v3 freshness rule (J3/J4); ``plan="resume"``
    the first version's rule (J2: universe minus stored ∪ marks, any stored
    row is done for ever), usually with ``success_rule="value"`` (C5).

    A run with a ``run_id`` marks the tickers it has processed (K4): the marks
    of a batch are committed with its rows, a later run of the same id takes up
    where this one stopped, and a run that completes, or has nothing to do,
    clears them. ``commit_every`` commits every that many tickers of a universe
    in list order (default: all at once); ``on_commit`` is told each version.
    """
    universe = _listed(spark, universe)
    now = snapshot(spark, store_root)
    whole = read_table(spark, store_root, FREE_FLOAT, at=now) if now else spark.createDataFrame([], FREE_FLOAT)
    stored = work.prune_to_universes(whole, universe)
    if run_id is not None and marks is None:
        marks = read_marks(stored_marks(spark, store_root), run_id=run_id)
    if plan == "stale":
        todo = work.plan_stale(universe, stored, marks, as_of, days=days, force=force, retry_failed=retry_failed)
    elif plan == "resume":
        no_marks = spark.createDataFrame([], "Universe string, Ticker string")
        todo = work.plan_resume(universe, stored, marks if marks is not None else no_marks)
    else:
        raise ValueError("plan must be 'stale' or 'resume'")
    plan = materialise(todo)
    due_attempts = attempts.join(plan.select(*KEYS).distinct(), KEYS, "left_semi")
    resolved = ffo.resolve_attempts(due_attempts, max_retry=max_retry, run_id=run_id if "run_id" in attempts.columns else None)
    rows = ffo.results_to_rows(resolved, as_of=as_of, success_rule=success_rule)
    if commit_every is None:
        rows = rows.withColumn("batch", F.lit(0).cast(T.LongType()))
    else:
        placed = rep.progress(plan, order_key="pos", batch_size=commit_every).groupBy(*KEYS).agg(F.min("batch").alias("batch"))
        rows = rows.join(placed, KEYS)
    # one row per due ticker, read by the upsert (up to three times), the marks
    # and the report: materialised once instead of re-resolving the tries
    rows = materialise(rows)
    version = now.version if now else None
    cols = [f.name for f in FREE_FLOAT.fields]
    batches = rows.groupBy("batch").agg(F.collect_set("Universe").alias("names")).orderBy("batch").collect()
    for batch in batches:  # nothing due or no tries: the table stays as it is
        part = rows.filter(F.col("batch") == batch.batch).drop("batch")
        touched = {(name,) for name in batch.names}
        mine = read_table(spark, store_root, FREE_FLOAT, at=now, only=touched.__contains__) if now else whole
        version = publish(
            ffo.upsert_free_float(mine, part, on_failure=on_failure).select(*cols),
            store_root,
            partition_by=["Universe"],
            sort_within=["Ticker"],
            only_partitions=True,
            beside=(lambda w, part=part: write_marks(part, store_root, run_id, w)) if run_id is not None else None,
            at=now,
        )
        now = snapshot(spark, store_root, version)
        if on_commit is not None:
            on_commit(version)
    if run_id is not None:
        clear_marks(spark, store_root, run_id)
    report = rows.select(*KEYS, "Status", "Error")
    totals = ffo.run_outcome(rows)
    return RunResult(version, plan, report, totals)
