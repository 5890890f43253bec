"""Normalisation (N1, N7), marks (S8, K4), universe cache (K5), views, S3."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tickvault import fixtures as fx
from tickvault.operators.normalize import normalize_quotes, unstack_wide
from tickvault.jobs import maintain_free_float
from tickvault.schemas import FREE_FLOAT
from tickvault.sinks.marks import clear_marks, stored_marks, write_marks
from tickvault.sinks.publish import publish
from tickvault.sources.store import read_current
from tickvault.sources.universe import (
    UniverseSource,
    cache_universe,
    prefer_source,
    read_cached,
    read_marks,
    read_universe,
)
from tickvault.views import register_views

SF = "/root/testdata/sf0.001"


def test_unstack_wide(spark):
    wide = spark.createDataFrame(
        [(dt.date(2020, 1, 2), 1.0, 2.0, 10.0, 3.0)],
        "Date date, `Close_AAA` double, ` Open_AAA ` double, `Volume_AAA` double, `Close_BB.L` double",
    )
    long = unstack_wide(wide, ["Date"])
    rows = {r.Ticker: r for r in long.collect()}
    assert set(rows) == {"AAA", "BB.L"}
    assert (rows["AAA"].Open, rows["AAA"].Close, rows["AAA"].Volume) == (2.0, 1.0, 10.0)
    assert rows["BB.L"].Open is None and rows["BB.L"].Close == 3.0
    canon = normalize_quotes(long, ticker_col="Ticker")
    assert canon.columns == ["Ticker", "Date", "Open", "High", "Low", "Close", "Volume"]
    assert canon.filter("Ticker = 'AAA'").first().Volume == 10


def test_normalize_single_ticker_and_empty(spark):
    raw = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1, 17, 0), 5.0, 7)], "` Date ` timestamp_ntz, ` Close ` double, Volume long"
    )
    out = normalize_quotes(raw, ticker="BBCA.JK", date_col="Date", exchange_tz="Asia/Jakarta").first()
    assert (out.Ticker, out.Date, out.Close, out.Open) == ("BBCA.JK", dt.date(2020, 1, 2), 5.0, None)
    assert normalize_quotes(raw.limit(0), ticker="X").count() == 0


def test_marks_roundtrip(spark, tmp_root):
    root = os.path.join(tmp_root, "t")
    rows = spark.createDataFrame([("u", "A")], "Universe string, Ticker string")
    m = spark.createDataFrame([("u", " A "), ("u", ""), ("u", "B"), ("v", "C")], "Universe string, Ticker string")
    assert stored_marks(spark, root).count() == 0
    publish(rows, root, beside=lambda w: write_marks(m, root, "run-1", w))
    publish(rows, root, beside=lambda w: write_marks(m.limit(1), root, "run-2", w))
    write_marks(m, root, "run-1", "f" * 32)  # its write was never committed
    back = read_marks(stored_marks(spark, root), universe="u", run_id="run-1")
    assert sorted(r.Ticker for r in back.collect()) == ["A", "B"]
    assert "PartitionFilters" in back._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    clear_marks(spark, root, "run-1")
    assert [r.run_id for r in stored_marks(spark, root).collect()] == ["run-2"]
    with pytest.raises(ValueError):
        clear_marks(spark, root, "../data")


TRIES = "Universe string, Ticker string, attempt int, ok boolean, payload string, error string, started_at timestamp_ntz, finished_at timestamp_ntz"


def test_killed_run_is_resumed_and_its_marks_cleared(spark, tmp_root):
    root = os.path.join(tmp_root, "ff")
    listed = spark.createDataFrame([("u", i, f"T{i}") for i in range(10)], "Universe string, pos long, Ticker string")
    tries = spark.createDataFrame(
        [("u", f"T{i}", 0, i % 3 > 0, '{"sharesOutstanding": 2.0, "floatShares": 1.0}', "boom", None, None) for i in range(10)], TRIES
    )

    class Killed(Exception):
        pass

    def kill(version):
        if version == 2:
            raise Killed

    run = dict(run_id="r1", days=0, commit_every=3)
    with pytest.raises(Killed):
        maintain_free_float(spark, listed, tries, root, as_of="2024-01-01 00:00:00", on_commit=kill, **run)
    assert read_current(spark, root, FREE_FLOAT).count() == 6
    assert sorted(r.Ticker for r in stored_marks(spark, root).collect()) == [f"T{i}" for i in range(6)]
    # days=0: every stored row is due again, only the marks keep them out
    done = maintain_free_float(spark, listed, tries, root, as_of="2024-01-02 00:00:00", **run)
    assert sorted(r.Ticker for r in done.plan.collect()) == [f"T{i}" for i in range(6, 10)]
    stamps = {r.Ticker: r["Last Updated"].day for r in read_current(spark, root, FREE_FLOAT).collect()}
    assert stamps == {f"T{i}": 1 if i < 6 else 2 for i in range(10)}
    assert stored_marks(spark, root).count() == 0
    # a complete run starts afresh; another run's marks do not count
    assert maintain_free_float(spark, listed, tries, root, as_of="2024-01-03 00:00:00", **run).plan.count() == 10


def test_universe_source_falls_back_and_caches(spark, tmp_root):
    cache = os.path.join(tmp_root, "cache")
    cols = "Universe string, pos long, Ticker string"
    remote = spark.createDataFrame([("x", 1, "X1"), ("x", 2, "X2"), ("y", 1, "Y1"), ("z", 1, "Z1")], cols)
    none = spark.createDataFrame([], cols)
    cache_universe(spark.createDataFrame([("x", 1, "OLD")], cols), cache)

    def names(source):
        return sorted((r.Universe, r.Ticker) for r in source.load(spark).collect())

    # a cached list is preferred, a missing one is fetched and cached
    assert names(UniverseSource(cache, remote, ["x", "y"])) == [("x", "OLD"), ("y", "Y1")]
    assert names(UniverseSource(cache, none, ["x", "y"])) == [("x", "OLD"), ("y", "Y1")]
    # without names: the cached lists, or all remote ones while there is no cache
    assert names(UniverseSource(cache, remote)) == [("x", "OLD"), ("y", "Y1")]
    assert len(names(UniverseSource(os.path.join(tmp_root, "new"), remote))) == 4
    assert read_cached(spark, os.path.join(tmp_root, "new")).count() == 4
    with pytest.raises(ValueError):
        UniverseSource(cache, none, ["nowhere"]).load(spark)


def test_cache_universe(spark, tmp_root):
    d = os.path.join(tmp_root, "lists")
    os.makedirs(d)
    with open(os.path.join(d, "x.txt"), "w") as f:
        f.write("a\nb\n")
    with open(os.path.join(d, "y.txt"), "w") as f:
        f.write("c\n")
    root = os.path.join(tmp_root, "cache")
    cache_universe(read_universe(spark, d), root)
    cache_universe(read_universe(spark, d).filter("Universe = 'y'").withColumn("Ticker", F.lit("Z")), root)
    got = sorted((r.Universe, r.Ticker) for r in spark.read.parquet(root).collect())
    assert got == [("x", "A"), ("x", "B"), ("y", "Z")]  # only y replaced


def test_prefer_source(spark):
    primary, fallback = fx.nation_lists(spark, SF)
    out = prefer_source(primary, fallback)
    per = {r.Universe: r.source for r in out.select("Universe", "source").distinct().collect()}
    assert per == {"R0": "primary", "R1": "primary", "R2": "primary", "R3": "fallback", "R4": "fallback"}
    assert out.count() == 25


def test_views(spark, tmp_root):
    root = os.path.join(tmp_root, "prices")
    bars = fx.gappy_log(spark, SF).select("Universe", "Ticker", "Date", "Open", "High", "Low", "Close", "Volume")
    publish(bars.dropDuplicates(["Universe", "Ticker", "Date"]), root, partition_by=["Universe"])
    assert "prices" in register_views(spark, prices_root=root)
    n = spark.sql("SELECT count(DISTINCT Ticker) AS n FROM prices").first().n
    assert n == bars.select("Ticker").distinct().count()


def test_unstack_tuple_labels(spark):
    from tickvault.operators.normalize import TUPLE_LABEL

    wide = spark.createDataFrame(
        [(dt.date(2020, 1, 2), 1.5, 100.0)], "Date date, `('Close', 'BBCA.JK')` double, `('Volume', 'BBCA.JK')` double"
    )
    r = unstack_wide(wide, ["Date"], pattern=TUPLE_LABEL).first()
    assert (r.Ticker, r.Close, r.Volume) == ("BBCA.JK", 1.5, 100.0)
