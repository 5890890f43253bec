"""Command line for ``spark-submit`` / ``python -m tickvault``.

The reference's menus and prompts become options; its interactive choices
(which universe file, which mode, backfill year, minimum gap) are arguments.
Every command builds DataFrames and runs the same library functions as the
API; what is printed is a small report (counts, samples), never table data.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.schemas import DEFAULT_MAX_RETRY, DEFAULT_MIN_GAP_DAYS, DEFAULT_STALE_DAYS, DEFAULT_START


def backfill_start(year_text: str | None) -> str:
    """A 4-digit year -> ``YYYY-01-01``; anything else -> the default start."""
    y = (year_text or "").strip()
    return f"{y}-01-01" if re.fullmatch(r"[0-9]{4}", y) else DEFAULT_START


def min_gap(text: str | None) -> int:
    """An integer, else the default of 7 days."""
    try:
        return int((text or "").strip() or DEFAULT_MIN_GAP_DAYS)
    except ValueError:
        return DEFAULT_MIN_GAP_DAYS


def _session() -> SparkSession:
    from tickvault.session import BASE_CONF, ensure_checkpoint_dir

    b = SparkSession.builder.appName("tickvault")
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _universe(spark: SparkSession, path: str, name: str | None, upper: bool) -> DataFrame:
    from tickvault.sources.universe import read_universe

    u = read_universe(spark, path, upper=upper)
    return u.filter(F.col("Universe") == name) if name else u


def _with_universe(landed: DataFrame, universe: DataFrame) -> DataFrame:
    if "Universe" in landed.columns:
        return landed
    return landed.join(universe.select("Universe", "Ticker").distinct(), "Ticker", "inner")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tickvault", description="Keep daily-bar and free-float tables complete and current.")
    sub = p.add_subparsers(dest="cmd", required=True)

    pr = sub.add_parser("prices", help="fresh / update / backfill the daily-bar table")
    pr.add_argument("--universe", required=True, help="folder of *.txt ticker lists")
    pr.add_argument("--universe-name", help="only this list (file stem)")
    pr.add_argument("--landed", required=True, help="landed bars (Parquet): Ticker, Date, Open..Volume, seq")
    pr.add_argument("--store", required=True, help="table root")
    pr.add_argument("--mode", choices=["fresh", "update", "backfill"], required=True)
    pr.add_argument("--as-of", required=True, help="run date (exclusive end of requests)")
    pr.add_argument("--start", default=DEFAULT_START, help="first date of a full history request (fresh / new)")
    pr.add_argument("--backfill-year", help="4-digit year to scan gaps from (default 2000)")
    pr.add_argument("--min-gap", help="minimum gap in days (default 7)")
    pr.add_argument("--attempts", help="fetch tries (Parquet); tickers that failed all tries are skipped")
    pr.add_argument("--max-retry", type=int, default=DEFAULT_MAX_RETRY)
    pr.add_argument("--upper", action="store_true", help="upper-case tickers (the reference's price jobs do not)")

    ff = sub.add_parser("free-float", help="refresh the free-float table")
    ff.add_argument("--universe", required=True)
    ff.add_argument("--universe-name")
    ff.add_argument("--attempts", required=True, help="tries with JSON payload of company facts (Parquet)")
    ff.add_argument("--store", required=True)
    ff.add_argument("--as-of", required=True, help="run clock, e.g. 2024-06-10T08:00:00")
    ff.add_argument("--marks", help="processed marks (Parquet: Universe, run_id, Ticker)")
    ff.add_argument("--run-id")
    ff.add_argument("--update-after-days", type=int, default=DEFAULT_STALE_DAYS)
    ff.add_argument("--max-retry", type=int, default=DEFAULT_MAX_RETRY)
    ff.add_argument("--force-update", action="store_true", help="every ticker (v2 meaning)")
    ff.add_argument("--ignore-marks", action="store_true", help="skip marks, keep the age rule (v3 meaning)")
    ff.add_argument("--retry-failed", action="store_true")
    ff.add_argument("--keep-last-good", action="store_true", help="a FAILED try keeps the last good numbers")
    ff.add_argument("--resume-only", action="store_true", help="first version: skip every stored ticker; success = %% present")

    gp = sub.add_parser("gaps", help="report gaps of the stored bars (A8, O4)")
    gp.add_argument("--universe", required=True)
    gp.add_argument("--universe-name")
    gp.add_argument("--store", required=True)
    gp.add_argument("--backfill-year")
    gp.add_argument("--min-gap")

    ex = sub.add_parser("expire", help="drop old table versions")
    ex.add_argument("--store", required=True)
    ex.add_argument("--keep", type=int, default=2)

    a = p.parse_args(argv)
    spark = spark or _session()

    if a.cmd == "prices":
        from tickvault.jobs import maintain_prices

        universe = _universe(spark, a.universe, a.universe_name, a.upper)
        landed = _with_universe(spark.read.parquet(a.landed), universe)
        attempts = spark.read.parquet(a.attempts) if a.attempts else None
        run = maintain_prices(
            spark,
            universe,
            landed,
            a.store,
            a.mode,
            a.as_of,
            start=backfill_start(a.backfill_year) if a.mode == "backfill" else a.start,
            min_gap_days=min_gap(a.min_gap),
            attempts=attempts,
            max_retry=a.max_retry,
        )
        print(f"published version {run.version}")
        run.totals.show(truncate=False)
    elif a.cmd == "free-float":
        from tickvault.jobs import maintain_free_float
        from tickvault.sources.universe import read_marks

        universe = _universe(spark, a.universe, a.universe_name, True)
        marks = read_marks(spark.read.parquet(a.marks), run_id=a.run_id) if a.marks else None
        force = "all" if a.force_update else ("ignore_marks" if a.ignore_marks else None)
        run = maintain_free_float(
            spark,
            universe,
            spark.read.parquet(a.attempts),
            a.store,
            a.as_of,
            marks=marks,
            days=a.update_after_days,
            force=force,
            retry_failed=a.retry_failed,
            max_retry=a.max_retry,
            on_failure="keep_last_good" if a.keep_last_good else "replace",
            plan="resume" if a.resume_only else "stale",
            success_rule="value" if a.resume_only else "call",
        )
        print(f"published version {run.version}")
        run.totals.show(truncate=False)
    elif a.cmd == "gaps":
        from tickvault.operators import reports as rep
        from tickvault.plans import work
        from tickvault.sources.store import read_prices

        universe = _universe(spark, a.universe, a.universe_name, False)
        prices = work.prune_to_universes(read_prices(spark, a.store), universe)
        plan = work.plan_backfill(universe, prices, start=backfill_start(a.backfill_year), min_gap_days=min_gap(a.min_gap))
        rep.gap_totals(universe, plan).show(truncate=False)
        rep.gap_sample(universe, plan).show(truncate=False)
    elif a.cmd == "expire":
        from tickvault.sinks.expire import expire_snapshots

        print("dropped versions:", expire_snapshots(spark, a.store, keep=a.keep))
    return 0


if __name__ == "__main__":
    sys.exit(main())
