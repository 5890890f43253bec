"""What a large backfill keeps on disk at once: one step's shuffles, no run folder."""

import datetime as dt
import functools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tickvault import jobs
from tickvault.jobs import maintain_prices
from tickvault.operators.merge import merge_latest
from tickvault.plans import windows
from tickvault.plans.windows import materialise
from tickvault.session import shared_dir
from tickvault.sources.store import read_prices

KEYS = ["Universe", "Ticker"]
BAR = "Universe string, Ticker string, Date date, Open double, High double, Low double, Close double, Volume long, seq long"


def _shuffle_bytes(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = {}
    for d in dirs:
        for at, _, names in os.walk(d):
            held |= {n: os.path.getsize(os.path.join(at, n)) for n in names if re.fullmatch(r"shuffle_.*\.data", n)}
    return held


def _feed(spark, tickers=40, days=150):
    rng = random.Random(4)
    rows = []
    for t in range(tickers):
        for k in range(days):
            x = [rng.random() for _ in range(4)]
            rows.append(("U", f"T{t}", dt.date(2015, 1, 1) + dt.timedelta(days=9 * k), *x, k, rng.randrange(1 << 40)))
    landed = spark.createDataFrame(rows, BAR).withColumn("note", F.lit("not stored"))
    # a stored bar every two years or so: one long gap after the other
    return landed, landed.filter(F.dayofyear("Date") < 12)


def _runs(spark):
    base = shared_dir(spark, "prices").removeprefix("file://")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def _backfill(spark, root):
    landed, settled = _feed(spark)
    universe = landed.select("Universe", "Ticker").distinct().withColumn("pos", F.lit(1))
    maintain_prices(spark, universe, settled, root, "fresh", as_of="2020-01-01", start="2014-01-01")
    run = maintain_prices(spark, universe, landed, root, "backfill", as_of="2020-01-01", start="2014-01-01", min_gap_days=30)
    return run


@pytest.fixture()
def shuffled(monkeypatch):
    """Every join of a plan or of keys beyond the broadcast bound."""
    monkeypatch.setattr(jobs, "BROADCAST_PLAN_ROWS", 0)
    monkeypatch.setattr(jobs, "apply_windows", functools.partial(windows.apply_windows, broadcast_max_rows=0))


def test_a_large_backfill_holds_the_shuffles_of_one_step(spark, tmp_root, shuffled, monkeypatch):
    held, publish = [], jobs.publish

    def measured(df, *args, **kwargs):
        held.append(_shuffle_bytes(spark))
        return publish(df, *args, **kwargs)

    monkeypatch.setattr(jobs, "publish", measured)
    before = _shuffle_bytes(spark)
    run = _backfill(spark, os.path.join(tmp_root, "prices"))
    left = sum(n for f, n in held[-1].items() if f not in before)
    # 6,000 bars of 50 bytes and more went through the join and the merge by then
    assert left < 50_000, left
    assert sum(r.rows_fetched for r in run.report.collect()) > 4_000


def test_both_ways_give_the_same_table_and_leave_no_run_folder(spark, tmp_root, request):
    before = _runs(spark)
    few = _backfill(spark, os.path.join(tmp_root, "few"))
    request.getfixturevalue("shuffled")
    many = _backfill(spark, os.path.join(tmp_root, "many"))
    rows = [sorted(map(tuple, read_prices(spark, os.path.join(tmp_root, r)).collect())) for r in ("few", "many")]
    assert rows[0] == rows[1] and len(rows[0]) > 4_000
    # the reports are read after the runs' folders have gone
    assert sorted(map(tuple, few.report.collect())) == sorted(map(tuple, many.report.collect()))
    assert sorted(map(tuple, few.totals.collect())) == sorted(map(tuple, many.totals.collect()))
    assert _runs(spark) == before


def test_a_failed_backfill_leaves_no_run_folder(spark, tmp_root, monkeypatch):
    before = _runs(spark)

    def fails(*args, only_partitions, **kwargs):
        if only_partitions:
            raise RuntimeError("disk full")
        return publish(*args, only_partitions=only_partitions, **kwargs)

    publish = jobs.publish
    monkeypatch.setattr(jobs, "publish", fails)
    with pytest.raises(RuntimeError, match="disk full"):
        _backfill(spark, os.path.join(tmp_root, "prices"))
    assert _runs(spark) == before


def test_a_long_window_is_shuffled_as_few_rows(spark):
    rows = [("U", "A", dt.date(2000, 1, 15), dt.date(2001, 1, 11))]
    plan = spark.createDataFrame(rows, "Universe string, Ticker string, start_date date, end_date date")
    cut = windows._by_month(windows._by_year(plan, KEYS, []), KEYS)
    assert cut.count() == 3  # half-years; 13 months


def test_keys_of_a_merge_take_no_window(spark):
    keys = [*KEYS, "Date"]
    landed, settled = _feed(spark, 3, 20)
    new = materialise(landed.drop("note").withColumn("batch_id", F.lit(1).cast("long")))
    merged = merge_latest(settled.drop("note", "seq"), new.union(new), keys, no_null_keys=True)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 1
    assert merged.count() == 60


def test_columns_without_a_type_are_spooled(spark, tmp_root):
    df = spark.range(2).select(F.lit(None).alias("a"), "id", F.lit(None).alias("b.c"))
    back = windows.spooled(df, os.path.join(tmp_root, "spool"))
    assert back.columns == df.columns and sorted(map(tuple, back.collect())) == [(None, 0, None), (None, 1, None)]
