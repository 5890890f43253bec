"""Benchmark the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is fully executed (a no-op write of every row), after one warm-up
run of the whole set; the reported time per query is the best of
``$BENCH_RUNS`` runs (default 3). ``job_*`` entries are end-to-end price jobs
(plan, fetch, merge, publish) over every ticker, best of 2 fresh tables
(``BENCH_JOBS=0`` skips them).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickvault.catalog import QUERIES  # noqa: E402
from tickvault.session import local_session  # noqa: E402

HEADLINE = [
    "keep_last",
    "gaps_all",
    "plan_update",
    "plan_backfill",
    "apply_backfill_windows",
    "backfill_merge",
    "update_merge",
    "plan_stale",
    "attempts_resolved",
    "upsert_replace",
    "work_batches",
    "normalized_quotes",
]


def run(df) -> None:
    # executes the whole plan without collecting rows to the driver
    df.write.format("noop").mode("overwrite").save()


def job_runs(spark, sf_dir: str) -> dict[str, float]:
    """End-to-end price jobs over every part ticker: fresh over the settled
    feed, backfill from the full feed, then update — each plans, fetches,
    merges and publishes a version (with stats) into a fresh folder under the
    shared checkpoint dir."""
    import uuid

    from pyspark.sql import functions as F

    from tickvault import fixtures as fx
    from tickvault.jobs import maintain_prices
    from tickvault.session import shared_dir

    root = shared_dir(spark, f"bench/{uuid.uuid4().hex}/prices")
    universe = fx.parts_universe(spark, sf_dir)
    landed = fx.gappy_log(spark, sf_dir).withColumn("seq", F.col("seq") * 1_000_000 + F.col("seq_tie"))
    landed = landed.drop("batch_id", "seq_tie")
    settled = landed.join(
        fx.gappy_stored_log(spark, sf_dir).select("Ticker", "Date").distinct(), ["Ticker", "Date"], "left_semi"
    )
    out = {}
    for name, kw in [
        ("job_fresh", dict(landed=settled, mode="fresh", as_of="2002-01-01", start="1995-01-01")),
        ("job_backfill", dict(landed=landed, mode="backfill", as_of="2002-01-01", start="1995-01-01", min_gap_days=30)),
        ("job_update", dict(landed=landed, mode="update", as_of="2002-01-01")),
    ]:
        t = time.perf_counter()
        maintain_prices(spark, universe, store_root=root, **kw)
        out[name] = round(time.perf_counter() - t, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    names = [n for n in HEADLINE if n in QUERIES]
    for n in names:  # warm-up: JIT, file listing, Python workers
        run(QUERIES[n](spark, sf_dir))
    times = {}
    for n in names:
        best = None
        for _ in range(runs):
            t = time.perf_counter()
            run(QUERIES[n](spark, sf_dir))
            dt = time.perf_counter() - t
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    if os.environ.get("BENCH_JOBS", "1") == "1":
        best_jobs: dict[str, float] = {}
        for _ in range(2):  # each pass builds a new table from scratch
            for k, v in job_runs(spark, sf_dir).items():
                best_jobs[k] = min(v, best_jobs.get(k, v))
        times.update(best_jobs)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
