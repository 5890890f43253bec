"""Registered queries: one per operator of the inventory, over the shared tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame; computed
columns carry the same names as the matching DuckDB statement in
:mod:`tickvault.oracle`. Scenario parameters are the fixed values of
:mod:`tickvault.fixtures`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault import fixtures as fx
from tickvault.functions.scalar import lit_ts
from tickvault.operators import freefloat as ffo
from tickvault.operators import reports as rep
from tickvault.operators.gaps import find_gaps
from tickvault.operators.merge import merge_latest, resolve_latest
from tickvault.operators.normalize import normalize_quotes
from tickvault.plans import work
from tickvault.plans.windows import apply_windows
from tickvault.schemas import FF_PCT, FF_UPDATED, STATUS_SUCCESS
from tickvault.sources.universe import prefer_source
from tickvault.sources.store import union_free_float_versions

KEYS = ["Universe", "Ticker"]
BAR_KEYS = ["Universe", "Ticker", "Date"]
PRICE_OUT = ["Universe", "Ticker", "Date", "Open", "High", "Low", "Close", "Volume"]


# ---------------------------------------------------------------- bars

def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Newest write per (Ticker, Date) of the landed log."""
    return resolve_latest(fx.bars_log(spark, sf), BAR_KEYS, fx.BARS_LOG_ORDER).select(*PRICE_OUT)


def _gappy_prices(spark, sf):
    return fx.gappy_log(spark, sf)


def gaps_all(spark: SparkSession, sf: str) -> DataFrame:
    """W2+W3: every leading and interior gap > 30 days from 1995-01-01."""
    return find_gaps(_gappy_prices(spark, sf), start=fx.GAP_START, min_gap_days=fx.GAP_MIN_DAYS, keys=KEYS)


def gaps_with_empty(spark: SparkSession, sf: str) -> DataFrame:
    """As gaps_all plus a whole-range gap for universe tickers with no bars."""
    return find_gaps(
        _gappy_prices(spark, sf),
        start=fx.GAP_START,
        min_gap_days=fx.GAP_MIN_DAYS,
        keys=KEYS,
        universe=fx.parts_universe(spark, sf, shifted=True),
        as_of=fx.UPDATE_AS_OF,
    )


def gaps_clipped(spark: SparkSession, sf: str) -> DataFrame:
    """W2/W3 with ``clip_to_start`` (start 1998-01-01)."""
    return find_gaps(_gappy_prices(spark, sf), start="1998-01-01", min_gap_days=fx.GAP_MIN_DAYS, keys=KEYS, clip_to_start=True)


def gaps_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Tickers scanned (whole universe), tickers with gaps, total gaps."""
    universe = fx.parts_universe(spark, sf, shifted=True)
    plan = work.plan_backfill(universe, _gappy_prices(spark, sf), start=fx.GAP_START, min_gap_days=fx.GAP_MIN_DAYS)
    return rep.gap_totals(universe, plan)


def gaps_sample(spark: SparkSession, sf: str) -> DataFrame:
    """First 5 tickers with gaps (universe order), first 3 gaps each."""
    universe = fx.parts_universe(spark, sf, shifted=True)
    plan = work.plan_backfill(universe, _gappy_prices(spark, sf), start=fx.GAP_START, min_gap_days=fx.GAP_MIN_DAYS)
    return rep.gap_sample(universe, plan, tickers=5, per_ticker=3)


def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per universe of the resolved table: rows, distinct
    tickers, first and last bar date."""
    return rep.table_stats(resolve_latest(fx.bars_log(spark, sf), BAR_KEYS, fx.BARS_LOG_ORDER))


def _job_inputs(spark, sf):
    universe = fx.parts_universe(spark, sf)
    # the feed's own write order: seq then the tie column, one batch per run
    landed = fx.gappy_log(spark, sf).withColumn("seq", F.col("seq") * F.lit(1_000_000) + F.col("seq_tie"))
    landed = landed.drop("batch_id", "seq_tie")
    settled = fx.gappy_stored_log(spark, sf).withColumn("seq", F.col("seq") * F.lit(1_000_000) + F.col("seq_tie"))
    settled = settled.drop("batch_id", "seq_tie")
    return universe, landed, settled


def job_fresh_load(spark: SparkSession, sf: str) -> DataFrame:
    """Price job, fresh mode end to end (J1, J7, W1, K1 by universe-year with
    stats) into a fresh folder under the shared checkpoint dir; the published
    table read back."""
    import uuid

    from tickvault.jobs import maintain_prices
    from tickvault.session import shared_dir
    from tickvault.sources.store import read_prices

    universe, landed, _ = _job_inputs(spark, sf)
    root = shared_dir(spark, f"queries/job_fresh/{uuid.uuid4().hex}")
    maintain_prices(spark, universe, landed, root, "fresh", as_of="2002-01-01", start="1995-01-01")
    return read_prices(spark, root).select(*PRICE_OUT)


def job_update(spark: SparkSession, sf: str) -> DataFrame:
    """Price job, fresh load of the settled feed then an update
    over a universe that also lists tickers no feed has."""
    import uuid

    from tickvault.jobs import maintain_prices
    from tickvault.session import shared_dir
    from tickvault.sources.store import read_prices

    universe, landed, settled = _job_inputs(spark, sf)
    root = shared_dir(spark, f"queries/job_update/{uuid.uuid4().hex}")
    maintain_prices(spark, universe, settled, root, "fresh", as_of="2002-01-01", start="1995-01-01")
    listed = fx.parts_universe(spark, sf, shifted=True)
    maintain_prices(spark, listed, landed, root, "update", as_of="2002-01-01", start="1995-01-01")
    return read_prices(spark, root).select(*PRICE_OUT)


def job_free_float(spark: SparkSession, sf: str) -> DataFrame:
    """Free-float job end to end (J3, C1-C7, K2, K1), the table read back (S7);
    a second run in which nothing is due leaves the version as it is."""
    import uuid

    from tickvault.jobs import maintain_free_float
    from tickvault.session import shared_dir
    from tickvault.sources.store import read_free_float

    universe = fx.customer_universe(spark, sf)
    tries = fx.attempts(spark, sf, universe="customers", prefix="C")
    root = shared_dir(spark, f"queries/job_free_float/{uuid.uuid4().hex}")
    first = maintain_free_float(spark, universe, tries, root, as_of=fx.STALE_AS_OF)
    done = read_free_float(spark, root).select(*KEYS)
    again = maintain_free_float(spark, universe.join(done, KEYS, "left_semi"), tries, root, as_of=fx.STALE_AS_OF)
    assert again.version == first.version, "a run with nothing due must not publish"
    return read_free_float(spark, root)


def job_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Price job, fresh load of the settled feed then a backfill (J6, J7,
    merge into the published table, rewrite of the touched years)."""
    import uuid

    from tickvault.jobs import maintain_prices
    from tickvault.session import shared_dir
    from tickvault.sources.store import read_prices

    universe, landed, settled = _job_inputs(spark, sf)
    root = shared_dir(spark, f"queries/job_backfill/{uuid.uuid4().hex}")
    maintain_prices(spark, universe, settled, root, "fresh", as_of="2002-01-01", start="1995-01-01")
    maintain_prices(
        spark, universe, landed, root, "backfill", as_of="2002-01-01", start="1995-01-01", min_gap_days=fx.GAP_MIN_DAYS
    )
    return read_prices(spark, root).select(*PRICE_OUT)


def first_last_dates(spark: SparkSession, sf: str) -> DataFrame:
    """A2/A3/A1: first and last bar date and bar count per stored ticker."""
    return work.last_dates(resolve_latest(_gappy_prices(spark, sf), BAR_KEYS, fx.BARS_LOG_ORDER))


# ---------------------------------------------------------------- plans

def plan_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with no stored key (stored = customers with a 'P' order)."""
    return work.plan_fresh(fx.customer_universe(spark, sf), fx.pending_order_keys(spark, sf), as_of=fx.UPDATE_AS_OF)


def resume_progress(spark: SparkSession, sf: str) -> DataFrame:
    """W6 after a resume: fresh-plan positions counted on from the stored keys
    (one universe per market segment)."""
    universe = fx.segment_universe(spark, sf)
    stored = fx.pending_segment_keys(spark, sf)
    plan = work.plan_fresh(universe, stored, as_of=fx.UPDATE_AS_OF)
    return rep.resume_progress(plan, universe, stored).select(
        *KEYS, "position", "run_position", "universe_total", "pct_done"
    )


def plan_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Universe minus (stored ∪ marks)."""
    return work.plan_resume(
        fx.customer_universe(spark, sf), fx.pending_order_keys(spark, sf), fx.urgent_open_marks(spark, sf)
    )


def plan_stale(spark: SparkSession, sf: str) -> DataFrame:
    """Users due for refresh at 2024-01-31 12:00 (7 days, marks honoured)."""
    return work.plan_stale(
        fx.users_universe(spark, sf), fx.signup_freshness(spark, sf), fx.signup_marks(spark, sf), as_of=fx.STALE_AS_OF
    )


def plan_stale_ignore_marks(spark: SparkSession, sf: str) -> DataFrame:
    """J4 (v3): marks ignored, freshness still applies."""
    return work.plan_stale(
        fx.users_universe(spark, sf),
        fx.signup_freshness(spark, sf),
        fx.signup_marks(spark, sf),
        as_of=fx.STALE_AS_OF,
        force="ignore_marks",
    )


def plan_stale_retry_failed(spark: SparkSession, sf: str) -> DataFrame:
    """J3 with ``retry_failed``: FAILED rows are due whatever their age."""
    return work.plan_stale(
        fx.users_universe(spark, sf),
        fx.signup_freshness(spark, sf),
        fx.signup_marks(spark, sf),
        as_of=fx.STALE_AS_OF,
        retry_failed=True,
    )


def plan_force_all(spark: SparkSession, sf: str) -> DataFrame:
    """J4 (v2): every ticker."""
    return work.plan_stale(
        fx.users_universe(spark, sf), fx.signup_freshness(spark, sf), fx.signup_marks(spark, sf), as_of=fx.STALE_AS_OF, force="all"
    )


def _update_plan(spark, sf):
    return work.plan_update(
        fx.parts_universe(spark, sf, shifted=True), _gappy_prices(spark, sf), as_of=fx.UPDATE_AS_OF
    )


def plan_update(spark: SparkSession, sf: str) -> DataFrame:
    """Update (last - 5 days) vs new (from 2000-01-01) at 2001-08-01."""
    return _update_plan(spark, sf).drop("pos")


def plan_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of the stored (settled) bars, one plan row per gap."""
    return work.plan_backfill(
        fx.parts_universe(spark, sf, shifted=True),
        fx.gappy_stored_log(spark, sf),
        start=fx.GAP_START,
        min_gap_days=fx.GAP_MIN_DAYS,
    ).drop("gap_start", "gap_end")


def _backfill_fills(spark, sf):
    plan = work.plan_backfill(
        fx.parts_universe(spark, sf, shifted=True),
        fx.gappy_stored_log(spark, sf),
        start=fx.GAP_START,
        min_gap_days=fx.GAP_MIN_DAYS,
    )
    return plan, apply_windows(fx.gappy_log(spark, sf), plan, keys=KEYS, plan_cols=["start_date"])


def apply_backfill_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Landed bars inside the backfill windows (range join)."""
    _, fills = _backfill_fills(spark, sf)
    return fills.select(*PRICE_OUT, "batch_id", "seq", "seq_tie", "start_date")


def apply_update_windows(spark: SparkSession, sf: str) -> DataFrame:
    """J7 on the update plan: bars in ``[start_date, as_of)``."""
    plan = _update_plan(spark, sf)
    return apply_windows(fx.gappy_log(spark, sf), plan, keys=KEYS, plan_cols=["kind"]).select(
        *PRICE_OUT, "batch_id", "seq", "seq_tie", "kind"
    )


def backfill_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """A7 with the failed arm: gaps of tickers whose tries are exhausted."""
    plan, fills = _backfill_fills(spark, sf)
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf, universe="parts", prefix="P"))
    return rep.fill_outcome(plan, fills, resolved)


def backfill_outcome_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps filled / empty / failed and rows fetched per universe."""
    return rep.fill_totals(backfill_outcome(spark, sf))


def failed_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """O3 of a backfill: first 10 failed gaps and how many more."""
    return rep.failed_gaps(backfill_outcome(spark, sf))


def fill_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Per gap, rows fetched and filled/empty."""
    plan, fills = _backfill_fills(spark, sf)
    return rep.fill_outcome(plan, fills)


def backfill_merge(spark: SparkSession, sf: str) -> DataFrame:
    """T4: stored bars and gap fills -> the republished table, by the job's merge."""
    _, fills = _backfill_fills(spark, sf)
    stored = resolve_latest(fx.gappy_stored_log(spark, sf), BAR_KEYS, fx.BARS_LOG_ORDER)
    return merge_latest(stored, fills.drop("start_date"), BAR_KEYS, fx.BARS_LOG_ORDER, no_null_keys=True).select(*PRICE_OUT)


def update_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Planned from the stored table, the 5-day overlap re-read replaces
    stored rows by key, by the job's merge."""
    stored = resolve_latest(fx.gappy_stored_log(spark, sf), BAR_KEYS, fx.BARS_LOG_ORDER)
    plan = work.plan_update(fx.parts_universe(spark, sf, shifted=True), stored, as_of=fx.UPDATE_AS_OF)
    fetched = apply_windows(fx.gappy_log(spark, sf), plan, keys=KEYS, one_window=True)
    return merge_latest(stored, fetched, BAR_KEYS, fx.BARS_LOG_ORDER, no_null_keys=True).select(*PRICE_OUT)


def plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A4: planning counts of the update run."""
    universe = fx.parts_universe(spark, sf, shifted=True)
    return rep.plan_counts(universe, _update_plan(spark, sf))


def plan_counts_fresh(spark: SparkSession, sf: str) -> DataFrame:
    """A4 of a fresh run: listed, due and done tickers."""
    universe = fx.customer_universe(spark, sf)
    return rep.work_counts(universe, plan_fresh(spark, sf))


def plan_counts_stale(spark: SparkSession, sf: str) -> DataFrame:
    """A4 of a free-float run: listed, due and fresh tickers."""
    return rep.work_counts(fx.users_universe(spark, sf), plan_stale(spark, sf))


def update_outcome_dups(spark: SparkSession, sf: str) -> DataFrame:
    """A6 over lists that name every ticker twice: each line reports the
    ticker's one fetch."""
    universe = fx.parts_universe(spark, sf, shifted=True)
    universe = universe.unionByName(universe.withColumn("pos", F.col("pos") + 2 * fx.NO_ROW_OFFSET))
    plan = work.plan_update(universe, _gappy_prices(spark, sf), as_of=fx.UPDATE_AS_OF)
    fetched = apply_windows(fx.gappy_log(spark, sf), plan, keys=KEYS, one_window=True)
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf, universe="parts", prefix="P"))
    return rep.update_outcome(plan, fetched, resolved)


def update_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Per planned ticker: rows fetched and success / skipped / failed."""
    plan = _update_plan(spark, sf)
    fetched = apply_windows(fx.gappy_log(spark, sf), plan, keys=KEYS, one_window=True)
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf, universe="parts", prefix="P"))
    return rep.update_outcome(plan, fetched, resolved)


def update_outcome_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome counts of the update run."""
    return rep.outcome_totals(update_outcome(spark, sf))


def work_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Update plan in order (updates first), position, percent, batch of 10."""
    plan = _update_plan(spark, sf).withColumn(
        "order_key", F.col("kind_rank") * F.lit(1 << 40) + F.col("pos")
    )
    return rep.progress(plan, order_key="order_key", batch_size=10).select(
        *KEYS, "kind", "position", "total", "pct_done", "batch"
    )


# ---------------------------------------------------------------- free float

def free_float(spark: SparkSession, sf: str) -> DataFrame:
    """Free-float percent from company facts."""
    return ffo.with_free_float(fx.company_info(spark, sf))


def free_float_v1_status(spark: SparkSession, sf: str) -> DataFrame:
    """v1 success rule (pct present) and outcome counts."""
    ff = ffo.with_free_float(fx.company_info(spark, sf))
    rows = ff.withColumn("Status", ffo.success_status(F.col(FF_PCT), "value"))
    return ffo.run_outcome(rows)


def attempts_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Rate-limit class and retry waits per try."""
    a = ffo.classify_errors(fx.attempts(spark, sf))
    return a.select(*KEYS, "attempt", "ok", "rate_limited", "retry_wait_min_s", "retry_wait_max_s", "not_before")


def attempts_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Status and error per ticker after at most 3 tries."""
    return ffo.resolve_attempts(fx.attempts(spark, sf)).select(*KEYS, "Status", "Error", "tries", "rate_limited")


def attempts_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """C7 with runs: an old run in which every try failed shares the table with
    the new run, whose good tries and numbers must count."""
    new = fx.attempts(spark, sf, universe="customers", prefix="C").withColumn("run_id", F.lit("new"))
    old = new.withColumn("run_id", F.lit("old")).withColumn("ok", F.lit(False)).withColumn("payload", F.lit(None).cast("string"))
    resolved = ffo.resolve_attempts(old.unionByName(new), run_id="new")
    return ffo.results_to_rows(resolved, as_of=fx.STALE_AS_OF)


def free_float_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved tries -> free_float rows stamped with the run clock."""
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf, universe="customers", prefix="C"))
    return ffo.results_to_rows(resolved, as_of=fx.STALE_AS_OF)


def _upsert(spark, sf, on_failure):
    current = ffo.with_free_float(fx.company_info(spark, sf)).select(
        *KEYS,
        "Shares Outstanding",
        "Float Shares",
        "Free Float (%)",
        F.lit(STATUS_SUCCESS).alias("Status"),
        F.lit(None).cast(T.StringType()).alias("Error"),
        lit_ts("2024-01-01 00:00:00").alias(FF_UPDATED),
    )
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf, universe="customers", prefix="C"))
    incoming = ffo.results_to_rows(resolved, as_of=fx.STALE_AS_OF)
    return ffo.upsert_free_float(current, incoming, on_failure=on_failure)


def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    """K2: full-row replace; FAILED blanks the numbers (reference behaviour)."""
    return _upsert(spark, sf, "replace")


def upsert_keep_last_good(spark: SparkSession, sf: str) -> DataFrame:
    """K2 option: FAILED keeps the newest good numbers."""
    return _upsert(spark, sf, "keep_last_good")


def free_float_versions(spark: SparkSession, sf: str) -> DataFrame:
    """K3: 5-column rows union 7-column rows (Status, Error NULL)."""
    v1 = ffo.with_free_float(fx.company_info(spark, sf)).select(
        *KEYS, "Shares Outstanding", "Float Shares", "Free Float (%)", lit_ts("2023-12-01 00:00:00").alias(FF_UPDATED)
    )
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf))
    v2 = ffo.results_to_rows(resolved, as_of=fx.STALE_AS_OF)
    return union_free_float_versions(v1, v2)


def failure_sample(spark: SparkSession, sf: str) -> DataFrame:
    """O3: first 10 failures in processing order and how many more."""
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf))
    pos = fx.users_universe(spark, sf)
    return rep.failure_sample(resolved.join(pos, KEYS, "inner"), order_key="pos", n=10)


def failed_list(spark: SparkSession, sf: str) -> DataFrame:
    """O3 of a run summary: failed tickers joined, and how many more."""
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf))
    return rep.failed_list(resolved.join(fx.users_universe(spark, sf), KEYS, "inner"))


def run_timing(spark: SparkSession, sf: str) -> DataFrame:
    """A10: total time, mean per ticker, time left for the rest of the plan."""
    resolved = ffo.resolve_attempts(fx.attempts(spark, sf))
    due = work.plan_stale(
        fx.users_universe(spark, sf), fx.signup_freshness(spark, sf), fx.signup_marks(spark, sf), as_of=fx.STALE_AS_OF
    )
    return rep.timing(resolved, due)


# ---------------------------------------------------------------- sources and normalisation

def universe_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Universe text lists (derived from the customer table, written to a
    fresh folder under the shared checkpoint dir) read back with exact order,
    stripping, blank removal and upper-casing."""
    import uuid

    from tickvault.session import shared_dir
    from tickvault.sources.universe import read_universe

    root = fx.write_segment_lists(spark, sf, shared_dir(spark, f"queries/universe_lists/{uuid.uuid4().hex}"))
    return read_universe(spark, root, upper=True)


def universe_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The universes of a folder of lists (derived from the customer table)."""
    import uuid

    from tickvault.session import shared_dir
    from tickvault.sources.universe import list_universes

    root = fx.write_segment_lists(spark, sf, shared_dir(spark, f"queries/universe_listing/{uuid.uuid4().hex}"))
    return list_universes(spark, root)


def prefer_primary(spark: SparkSession, sf: str) -> DataFrame:
    """S3: primary list first, fallback only for keys the primary lacks."""
    primary, fallback = fx.nation_lists(spark, sf)
    return prefer_source(primary, fallback, ["Universe"])


def normalized_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Landed UTC instants -> exchange-local dates, canonical columns."""
    raw = fx.landed_quotes(spark, sf)
    return normalize_quotes(raw, ticker_col="symbol", date_col="ts_utc", exchange_tz=F.col("exchange_tz"))


def normalized_instants(spark: SparkSession, sf: str) -> DataFrame:
    """N3 for zone-aware feeds: the same quotes landed as instants."""
    raw = fx.landed_quotes(spark, sf)
    epoch = F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType())
    instant = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts_utc")))
    return normalize_quotes(
        raw.withColumn("ts_utc", instant), ticker_col="symbol", date_col="ts_utc", exchange_tz=F.col("exchange_tz")
    )


QUERIES = {
    "keep_last": keep_last,
    "gaps_all": gaps_all,
    "gaps_with_empty": gaps_with_empty,
    "gaps_clipped": gaps_clipped,
    "gaps_summary": gaps_summary,
    "gaps_sample": gaps_sample,
    "first_last_dates": first_last_dates,
    "table_stats": table_stats,
    "job_fresh_load": job_fresh_load,
    "job_backfill": job_backfill,
    "job_update": job_update,
    "job_free_float": job_free_float,
    "plan_fresh": plan_fresh,
    "plan_resume": plan_resume,
    "resume_progress": resume_progress,
    "plan_stale": plan_stale,
    "plan_stale_ignore_marks": plan_stale_ignore_marks,
    "plan_stale_retry_failed": plan_stale_retry_failed,
    "plan_force_all": plan_force_all,
    "plan_update": plan_update,
    "plan_backfill": plan_backfill,
    "apply_backfill_windows": apply_backfill_windows,
    "apply_update_windows": apply_update_windows,
    "fill_outcome": fill_outcome,
    "backfill_outcome": backfill_outcome,
    "backfill_outcome_totals": backfill_outcome_totals,
    "failed_gaps": failed_gaps,
    "plan_counts_fresh": plan_counts_fresh,
    "plan_counts_stale": plan_counts_stale,
    "update_outcome_dups": update_outcome_dups,
    "attempts_two_runs": attempts_two_runs,
    "failed_list": failed_list,
    "normalized_instants": normalized_instants,
    "backfill_merge": backfill_merge,
    "update_merge": update_merge,
    "plan_counts": plan_counts,
    "update_outcome": update_outcome,
    "update_outcome_totals": update_outcome_totals,
    "work_batches": work_batches,
    "free_float": free_float,
    "free_float_v1_status": free_float_v1_status,
    "attempts_classified": attempts_classified,
    "attempts_resolved": attempts_resolved,
    "free_float_rows": free_float_rows,
    "upsert_replace": upsert_replace,
    "upsert_keep_last_good": upsert_keep_last_good,
    "free_float_versions": free_float_versions,
    "failure_sample": failure_sample,
    "run_timing": run_timing,
    "universe_lists": universe_lists,
    "universe_listing": universe_listing,
    "prefer_primary": prefer_primary,
    "normalized_quotes": normalized_quotes,
}
