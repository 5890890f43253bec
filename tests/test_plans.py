"""The physical plans keep the properties the design relies on at scale."""

import datetime as dt
import os

from tickvault import catalog
from tickvault import fixtures as fx
from tickvault.operators.gaps import find_gaps
from tickvault.operators.merge import merge_latest, resolve_latest
from tickvault.plans import work
from tickvault.plans.windows import SALT, apply_windows
from tickvault.sinks.publish import publish
from tickvault.sources.store import read_prices

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_wins_limits_before_the_shuffle(spark):
    p = _plan(resolve_latest(fx.bars_log(spark, SF), ["Universe", "Ticker", "Date"], fx.BARS_LOG_ORDER))
    exchange = p.index("Exchange hashpartitioning")
    partial = p.index("Partial")
    assert "WindowGroupLimit" in p and partial > exchange  # printed below = runs before the exchange
    assert p.count("Exchange hashpartitioning") == 1


def test_gap_scan_shuffles_month_masks_only(spark):
    p = _plan(find_gaps(fx.gappy_log(spark, SF), start="1995-01-01", min_gap_days=30, keys=["Universe", "Ticker"]))
    # by ticker and month after partial aggregation, then the month rows by ticker
    assert p.count("Exchange hashpartitioning(") == 2
    first = p.rsplit("Exchange hashpartitioning(", 1)[1]
    assert "_groupingexpression" in first.split("ENSURE", 1)[0] and "HashAggregate" in first
    assert "CartesianProduct" not in p and "SinglePartition" not in p and "SortAggregate" not in p


def test_range_join_is_an_equi_join_on_ticker_month(spark):
    plan = work.plan_backfill(fx.parts_universe(spark, SF), fx.gappy_stored_log(spark, SF), start="1995-01-01", min_gap_days=30)
    p = _plan(apply_windows(fx.gappy_log(spark, SF), plan, keys=["Universe", "Ticker"], broadcast_max_rows=0))
    assert "SortMergeJoin" in p and "__m" in p.split("SortMergeJoin", 1)[1][:200]
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # a counted plan is broadcast, and the bars are not shuffled at all
    p = _plan(apply_windows(fx.gappy_log(spark, SF), plan, keys=["Universe", "Ticker"]))
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p


def test_whole_windows_beyond_the_broadcast_bound_are_salted(spark):
    plan = work.plan_update(fx.parts_universe(spark, SF), fx.gappy_stored_log(spark, SF), as_of="2001-08-01")
    few = apply_windows(fx.gappy_log(spark, SF), plan, keys=["Universe", "Ticker"], one_window=True)
    many = apply_windows(fx.gappy_log(spark, SF), plan, keys=["Universe", "Ticker"], one_window=True, broadcast_max_rows=0)
    assert "BroadcastHashJoin" in _plan(few)
    assert "__salt" in _plan(many).split("SortMergeJoin", 1)[1][:200]
    assert few.count() > 0 and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_gap_scan_deals_tickers_by_the_number_of_bars(spark, monkeypatch):
    bars = fx.gappy_log(spark, SF).cache()
    want = sorted(find_gaps(bars, keys=["Universe", "Ticker"]).collect())
    monkeypatch.setattr("tickvault.operators.gaps.BARS_PER_TASK", 100, raising=False)
    found = find_gaps(bars, keys=["Universe", "Ticker"])
    tasks = -(-bars.count() // 100)
    assert f", {tasks}), REPARTITION_BY_NUM" in _plan(found)
    assert sorted(found.collect()) == want


def test_update_merge_shuffles_stored_bars_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = _plan(catalog.update_merge(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    # the newest-wins window has dealt the stored bars; the join takes them as they are
    stored = p.split("LeftAnti", 1)[1].split("Window [", 1)[0]
    assert "Exchange" not in stored, stored


def test_first_load_is_not_shuffled_between_join_and_newest_wins(spark):
    plan = work.plan_fresh(fx.parts_universe(spark, SF), spark.createDataFrame([], "Universe string, Ticker string"), "2002-01-01", start="1995-01-01")
    log = fx.gappy_log(spark, SF)
    keys = ["Universe", "Ticker"]
    fetched = apply_windows(log, plan, keys=keys, one_window=True, broadcast_max_rows=0, keep_salt=True)
    new = merge_latest(None, fetched, [*keys, "Date"], fx.BARS_LOG_ORDER, deterministic_ties=True, dealt_by=[SALT])
    # the log and the salted plan for the join, none for the window
    assert _plan(new).count("Exchange hashpartitioning") == 2
    plain = apply_windows(log, plan, keys=keys, one_window=True)
    want = merge_latest(None, plain, [*keys, "Date"], fx.BARS_LOG_ORDER, deterministic_ties=True)
    assert new.columns == want.columns
    assert sorted(new.collect()) == sorted(want.collect())


def test_universe_pruning_reaches_the_scan(spark, tmp_root):
    root = os.path.join(tmp_root, "prices")
    rows = [("A", "x", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1), ("B", "y", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "Universe string, Ticker string, Date date, Open double, High double, Low double, Close double, Volume long")
    publish(df, root, partition_by=["Universe"])
    uni = spark.createDataFrame([("A", 1, "x")], "Universe string, pos long, Ticker string")
    pruned = work.prune_to_universes(read_prices(spark, root), uni)
    p = _plan(pruned)
    assert "PartitionFilters: [isnotnull(Universe" in p and "Universe" in p.split("PartitionFilters:", 1)[1][:120]
    assert [r.Universe for r in pruned.collect()] == ["A"]


def test_window_bounds_reach_the_scan(spark, tmp_root):
    landed = os.path.join(tmp_root, "landed")
    fx.gappy_log(spark, SF).write.parquet(landed)
    raw = spark.read.parquet(landed)
    plan = spark.createDataFrame(
        [("parts", "P1", dt.date(2001, 7, 1), dt.date(2001, 8, 1))], "Universe string, Ticker string, start_date date, end_date date"
    )
    p = _plan(apply_windows(raw, plan, keys=["Universe", "Ticker"]))
    pushed = p.split("PushedFilters:", 1)[1][:300]
    assert "GreaterThanOrEqual(Date,2001-07-01)" in pushed and "LessThan(Date,2001-08-01)" in pushed
