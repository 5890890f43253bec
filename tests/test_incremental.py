"""Incremental publish from fetched rows, version checks, outcomes of a run,
one table for stream and job, tries of several runs, zone-aware instants."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tickvault.jobs import maintain_free_float, maintain_prices
from tickvault.operators import freefloat as ffo
from tickvault.operators.normalize import normalize_quotes
from tickvault.schemas import PRICES_STORED, TICKER_STATS
from tickvault.sinks.publish import StaleVersion, current_version, publish, read_table, snapshot
from tickvault.sources.store import read_prices
from tickvault.streaming.bars import append_log, compact, log_batches

BARS = "Universe string, Ticker string, Date date, Close double, seq long"


def bars(spark, *rows):
    df = spark.createDataFrame([(u, t, dt.date.fromisoformat(d), c, 0) for u, t, d, c in rows], BARS)
    for c in ("Open", "High", "Low"):
        df = df.withColumn(c, F.col("Close"))
    return df.withColumn("Volume", F.lit(1).cast("long"))


def universe(spark, *tickers):
    return spark.createDataFrame([("U", k, t) for k, t in enumerate(tickers)], "Universe string, pos long, Ticker string")


@pytest.fixture()
def store(spark, tmp_root):
    root = os.path.join(tmp_root, "prices")
    landed = bars(spark, *[("U", "A", f"{y}-06-01", float(y)) for y in range(2015, 2020)], ("U", "B", "2019-06-01", 1.0))
    maintain_prices(spark, universe(spark, "A", "B"), landed, root, "fresh", as_of="2019-07-01")
    return root


def _changed(spark, root, old, new):
    """Partitions that version ``new`` reads from other files than ``old``."""
    before, after = snapshot(spark, root, old).parts, snapshot(spark, root, new).parts
    return {p for p, w in after.items() if before.get(p) != w}


def test_one_fetched_row_rewrites_one_partition(spark, store):
    landed = bars(spark, ("U", "A", "2019-07-05", 9.0))
    run = maintain_prices(spark, universe(spark, "A", "B", "never-listed"), landed, store, "update", as_of="2019-08-01")
    assert run.version == 2
    assert _changed(spark, store, 1, 2) == {("U", "2019")}
    assert read_prices(spark, store).count() == 7
    out = {r.Ticker: (r.rows_fetched, r.outcome) for r in run.report.collect()}
    assert out == {"A": (1, "success"), "B": (0, "skipped"), "never-listed": (0, "skipped")}


def test_empty_fetch_publishes_nothing(spark, store):
    landed = bars(spark, ("U", "Z", "2019-07-05", 9.0))
    run = maintain_prices(spark, universe(spark, "A", "never-listed"), landed, store, "update", as_of="2019-08-01")
    assert run.version == 1 and current_version(spark, store) == 1
    assert [r.skipped for r in run.totals.collect()] == [2]


def test_a_ticker_listed_twice_is_fetched_once(spark, store):
    landed = bars(spark, ("U", "A", "2019-07-05", 9.0), ("U", "A", "2019-07-06", 9.0), ("U", "A", "2019-07-08", 9.0), ("U", "B", "2019-07-05", 2.0), ("U", "B", "2019-07-06", 2.0))
    run = maintain_prices(spark, universe(spark, "A", "A", "B"), landed, store, "update", as_of="2019-08-01")
    assert run.totals.first().rows_fetched == 8


def test_failed_gaps_are_not_empty(spark, store):
    tries = spark.createDataFrame(
        [("U", "A", k, False, None, "boom", None, None) for k in range(3)],
        "Universe string, Ticker string, attempt int, ok boolean, payload string, error string, started_at timestamp_ntz, finished_at timestamp_ntz",
    )
    landed = bars(spark, ("U", "A", "2016-12-01", 5.0), ("U", "B", "2010-12-01", 5.0))
    run = maintain_prices(spark, universe(spark, "A", "B"), landed, store, "backfill", as_of="2019-08-01", attempts=tries)
    outcomes = {(r.Ticker, r.outcome) for r in run.report.collect()}
    assert outcomes == {("A", "failed"), ("B", "filled")}
    t = run.totals.first()
    assert (t.filled, t.empty, t.rows_fetched) == (1, 0, 1) and t.failed > 0


def test_overlapping_run_does_not_lose_rows(spark, store):
    rows = read_prices(spark, store).withColumn("year", F.year("Date"))
    publish(rows, store, partition_by=["Universe", "year"], only_partitions=True, at=snapshot(spark, store, 1))
    with pytest.raises(StaleVersion):
        publish(rows, store, partition_by=["Universe", "year"], only_partitions=True, at=snapshot(spark, store, 1))
    assert current_version(spark, store) == 2


def test_stream_and_job_keep_one_table(spark, store, tmp_root):
    log = os.path.join(tmp_root, "log")
    append_log(bars(spark, ("U", "A", "2019-07-05", 9.0)), 0, log)
    assert compact(spark, log, store, PRICES_STORED, expire_log=True) == 2
    assert log_batches(spark, log) == []
    assert _changed(spark, store, 1, 2) == {("U", "2019")}
    assert read_table(spark, store, TICKER_STATS, side="stats") is not None
    landed = bars(spark, ("U", "A", "2019-07-04", 8.0), ("U", "B", "2019-07-04", 8.0))
    run = maintain_prices(spark, universe(spark, "A", "B"), landed, store, "update", as_of="2019-08-01")
    assert run.version == 3 and snapshot(spark, store).note == 0
    assert {r.Ticker: r.start_date for r in run.plan.collect()}["A"] == dt.date(2019, 6, 30)
    append_log(bars(spark, ("U", "C", "2018-01-01", 1.0)), 1, log)
    assert compact(spark, log, store, PRICES_STORED) == 4
    assert read_prices(spark, store).count() == 10


def test_tries_of_another_run_do_not_count(spark):
    cols = "run_id string, Universe string, Ticker string, attempt int, ok boolean, payload string, error string, started_at timestamp_ntz, finished_at timestamp_ntz"
    rows = [("old", "U", "A", k, False, None, "boom", None, None) for k in range(3)]
    rows.append(("new", "U", "A", 0, True, '{"sharesOutstanding": 2.0, "floatShares": 1.0}', None, None, None))
    tries = spark.createDataFrame(rows, cols)
    r = ffo.results_to_rows(ffo.resolve_attempts(tries, run_id="new"), as_of="2024-01-01 00:00:00").first()
    assert r.Status == "SUCCESS" and r["Free Float (%)"] == 50.0
    assert ffo.resolve_attempts(tries, run_id="old").first().Status == "FAILED"
    with pytest.raises(ValueError):
        ffo.resolve_attempts(tries)


def test_free_float_publishes_only_when_something_is_due(spark, tmp_root):
    root = os.path.join(tmp_root, "ff")
    tries = spark.createDataFrame(
        [("U", "A", 0, True, '{"sharesOutstanding": 2.0, "floatShares": 1.0}', None, None, None)],
        "Universe string, Ticker string, attempt int, ok boolean, payload string, error string, started_at timestamp_ntz, finished_at timestamp_ntz",
    )
    u = universe(spark, "A")
    assert maintain_free_float(spark, u, tries, root, as_of="2024-01-10 00:00:00").version == 1
    assert maintain_free_float(spark, u, tries, root, as_of="2024-01-11 00:00:00").version == 1
    assert maintain_free_float(spark, u, tries, root, as_of="2024-02-11 00:00:00").version == 2


def test_instants_need_a_zone(spark):
    raw = spark.sql("SELECT 'A' AS s, TIMESTAMP '2024-01-01 20:00:00' AS Date, 1.0D AS Close")
    out = normalize_quotes(raw, ticker_col="s", exchange_tz="Asia/Jakarta").first()
    assert out.Date == dt.date(2024, 1, 2)
    with pytest.raises(ValueError):
        normalize_quotes(raw, ticker_col="s")
