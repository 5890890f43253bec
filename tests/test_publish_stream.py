"""Snapshot publish, crash safety, stream ≡ batch, end-to-end jobs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tickvault import fixtures as fx
from tickvault.jobs import maintain_free_float, maintain_prices
from tickvault.operators.merge import resolve_latest
from tickvault.schemas import PRICES_STORED
from tickvault.sinks.expire import expire_snapshots, list_versions
from tickvault.sinks.publish import StaleVersion, current_version, publish, read_table, snapshot
from tickvault.sources.store import read_current, read_prices
from tickvault.streaming.bars import compact, read_live, stream_landed

SF = "/root/testdata/sf0.001"
COLS = [f.name for f in PRICES_STORED.fields]


def _rows(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_publish_versions_and_crash(spark, tmp_root):
    root = os.path.join(tmp_root, "prices")
    assert read_prices(spark, root).count() == 0  # no table -> no data
    df = resolve_latest(fx.bars_log(spark, SF), ["Universe", "Ticker", "Date"], fx.BARS_LOG_ORDER).select(*COLS)
    v1 = publish(df, root, partition_by=["Universe"], sort_within=["Ticker", "Date"])
    assert v1 == 1 and read_prices(spark, root).count() == df.count()
    # a crashed publish: files that no marker names -> readers keep v=1
    lost = os.path.join(root, "data", "w=" + "0" * 32, "Universe=x")
    os.makedirs(lost)
    with open(os.path.join(lost, "part-0.parquet"), "wb") as f:
        f.write(b"garbage")
    os.utime(os.path.join(lost, "part-0.parquet"), (1_600_000_000, 1_600_000_000))
    # one that died while writing its marker
    os.makedirs(os.path.join(root, "log", "_" + "1" * 32))
    assert current_version(spark, root) == 1
    assert read_prices(spark, root).count() == df.count()
    v2 = publish(df.limit(5), root)
    assert v2 == 2 and current_version(spark, root) == 2
    assert expire_snapshots(spark, root, keep=1) == [1]
    assert list_versions(spark, root) == [2] and not os.path.exists(os.path.dirname(lost))
    assert read_prices(spark, root).count() == 5
    assert publish(df, root, partition_by=["Universe"]) == 3  # numbers go on


def test_corrupt_snapshot_raises(spark, tmp_root):
    root = os.path.join(tmp_root, "prices")
    publish(spark.createDataFrame([("A", "x")], "Universe string, Ticker string"), root)
    (w,) = snapshot(spark, root).parts.values()
    for f in os.listdir(os.path.join(root, "data", f"w={w}")):
        with open(os.path.join(root, "data", f"w={w}", f), "wb") as out:
            out.write(b"not parquet")
    with pytest.raises(Exception):
        read_prices(spark, root).count()
    for f in os.listdir(os.path.join(root, "log", "v=1")):
        with open(os.path.join(root, "log", "v=1", f), "wb") as out:
            out.write(b"not parquet")
    with pytest.raises(Exception):
        snapshot(spark, root)


def test_of_two_writers_of_one_version_one_commits(spark, tmp_root, monkeypatch):
    """Both pass the check, both write; the rename of the marker decides."""
    from tickvault.sinks import publish as mod

    root = os.path.join(tmp_root, "t")
    a = spark.createDataFrame([("A", "x")], "Universe string, Ticker string")
    publish(a, root, partition_by=["Universe"])
    real, other = mod.rename_new, spark.createDataFrame([("B", "y")], "Universe string, Ticker string")

    def late(session, source, target):
        monkeypatch.setattr(mod, "rename_new", real)
        assert publish(other, root, partition_by=["Universe"], only_partitions=True, at=snapshot(spark, root, 1)) == 2
        return real(session, source, target)

    monkeypatch.setattr(mod, "rename_new", late)
    with pytest.raises(StaleVersion):
        publish(a.union(other), root, partition_by=["Universe"], only_partitions=True, at=snapshot(spark, root, 1))
    assert sorted(map(tuple, read_table(spark, root, a.schema).collect())) == [("A", "x"), ("B", "y")]
    assert list_versions(spark, root) == [1, 2]


def test_partition_values_of_every_kind(spark, tmp_root):
    root = os.path.join(tmp_root, "t")
    names = ["a/b", "a b", "007", None, "x=1", "%41", "ä\\c", "1e3"]
    df = spark.createDataFrame([(n, y, i) for i, n in enumerate(names) for y in (2020, None)], "Universe string, year int, n int")
    publish(df, root, partition_by=["Universe", "year"])
    again = df.filter("Universe in ('a/b', '007') or Universe is null").withColumn("n", F.col("n") + 100)
    publish(again.filter("year is null"), root, partition_by=["Universe", "year"], only_partitions=True)
    got = sorted(map(str, map(tuple, read_table(spark, root, df.schema).collect())))
    hit = {"a/b", "007", None}
    want = sorted(str((n, y, i + (100 if y is None and n in hit else 0))) for i, n in enumerate(names) for y in (2020, None))
    assert got == want
    one = read_table(spark, root, df.schema, only=lambda part: part == ("a/b", None)).collect()
    assert [tuple(r) for r in one] == [("a/b", None, 100)]


def test_stream_equals_batch(spark, tmp_root):
    landing = os.path.join(tmp_root, "landing")
    log = fx.bars_log(spark, SF)
    # land the log as 3 files, one per batch_id value, in batch order
    for b in range(3):
        log.filter(F.col("batch_id") == b).drop("batch_id").coalesce(1).write.parquet(os.path.join(landing, f"f{b}"))
    files = sorted(
        os.path.join(dp, f) for dp, _, fs in os.walk(landing) for f in fs if f.endswith(".parquet")
    )
    flat = os.path.join(tmp_root, "flat")
    os.makedirs(flat)
    for i, p in enumerate(files):
        os.rename(p, os.path.join(flat, f"{i:03d}.parquet"))
        os.utime(os.path.join(flat, f"{i:03d}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(flat).schema
    log_root, table_root = os.path.join(tmp_root, "log"), os.path.join(tmp_root, "table")
    q = stream_landed(
        spark, flat, schema, log_root, checkpoint=os.path.join(tmp_root, "cp"), max_files_per_trigger=1,
        transform=lambda df: df.withColumn("seq", F.col("seq") * 1_000_000 + F.col("seq_tie")).drop("seq_tie"),
    )
    q.awaitTermination()
    live = read_live(spark, log_root, table_root, PRICES_STORED)
    v = compact(spark, log_root, table_root, PRICES_STORED)
    assert v == 1
    batch = resolve_latest(log, ["Universe", "Ticker", "Date"], fx.BARS_LOG_ORDER)
    assert _rows(read_current(spark, table_root, PRICES_STORED)) == _rows(batch)
    assert _rows(live) == _rows(batch)
    # nothing new -> no new version
    assert compact(spark, log_root, table_root, PRICES_STORED) == 1


def test_maintain_prices_modes(spark, tmp_root):
    root = os.path.join(tmp_root, "prices")
    universe = fx.parts_universe(spark, SF)
    landed = fx.gappy_log(spark, SF).withColumn("seq", F.col("seq") * 1_000_000 + F.col("seq_tie")).drop("batch_id", "seq_tie")
    settled = landed.join(
        fx.gappy_stored_log(spark, SF).select("Ticker", "Date").distinct(), ["Ticker", "Date"], "left_semi"
    )
    # fresh run over the settled feed
    r1 = maintain_prices(spark, universe, settled, root, "fresh", as_of="2002-01-01", start="1995-01-01")
    n1 = read_prices(spark, root).count()
    assert r1.version == 1 and n1 == settled.select("Ticker", "Date").distinct().count()
    # backfill from the full feed: stored rows plus feed rows inside the gap
    # windows of the stored rows (checked with a plain loop)
    from tests.test_properties import brute_gaps

    base = [(r.Ticker, r.Date) for r in read_prices(spark, root).select("Ticker", "Date").collect()]
    gaps = brute_gaps(base, dt.date(1995, 1, 1), 30)
    feed = {(r.Ticker, r.Date) for r in landed.select("Ticker", "Date").collect()}
    want = set(base) | {(t, d) for t, d in feed for (gt, s, e) in gaps if gt == t and s <= d <= e}
    r2 = maintain_prices(spark, universe, landed, root, "backfill", as_of="2002-01-01", start="1995-01-01", min_gap_days=30)
    assert r2.version == 2
    got = {(r.Ticker, r.Date) for r in read_prices(spark, root).select("Ticker", "Date").collect()}
    assert got == want and len(got) > n1
    # a second backfill from the same feed finds nothing more to take
    maintain_prices(spark, universe, landed, root, "backfill", as_of="2002-01-01", start="1995-01-01", min_gap_days=30)
    assert read_prices(spark, root).count() == len(want)
    full = len(want)
    # update: every stored ticker re-reads [last - 5 days, as_of); new tickers from 2000-01-01
    last = {}
    for t, d in got:
        last[t] = max(last.get(t, d), d)
    as_of = dt.date(2002, 1, 1)
    uni = {r.Ticker for r in universe.collect()}
    want_u = set(got)
    for t, d in feed:
        lo = last[t] - dt.timedelta(days=5) if t in last else dt.date(2000, 1, 1)
        if t in uni and lo <= d < as_of and (t not in last or last[t] < as_of):
            want_u.add((t, d))
    r3 = maintain_prices(spark, universe, landed, root, "update", as_of="2002-01-01")
    got_u = {(r.Ticker, r.Date) for r in read_prices(spark, root).select("Ticker", "Date").collect()}
    assert got_u == want_u and len(got_u) >= full
    tot = r3.totals.first()
    assert tot.failed == 0 and tot.success + tot.skipped == r3.plan.count()


def test_maintain_free_float(spark, tmp_root):
    root = os.path.join(tmp_root, "ff")
    universe = fx.users_universe(spark, SF)
    attempts = fx.attempts(spark, SF)
    r1 = maintain_free_float(spark, universe, attempts, root, as_of="2024-02-01 00:00:00")
    t1 = read_current(spark, root, r1.report.schema if False else __import__("tickvault.schemas", fromlist=["FREE_FLOAT"]).FREE_FLOAT)
    n_users = attempts.select("Ticker").distinct().count()
    assert t1.count() == n_users
    # a day later nothing is stale: the plan is only the universe rows without data
    r2 = maintain_free_float(spark, universe, attempts, root, as_of="2024-02-02 00:00:00")
    reasons = {r.reason for r in r2.plan.select("reason").distinct().collect()}
    assert reasons == {"missing"}
    # eight days later every stored row is stale again
    r3 = maintain_free_float(spark, universe, attempts, root, as_of="2024-02-09 00:00:00")
    assert r3.plan.filter("reason = 'stale'").count() == n_users


def test_publish_only_partitions(spark, tmp_root):
    root = os.path.join(tmp_root, "t")
    a = spark.createDataFrame([("A", "x", 1), ("B", "y", 2)], "Universe string, Ticker string, n int")
    publish(a, root, partition_by=["Universe"])
    b = spark.createDataFrame([("B", "z", 3)], "Universe string, Ticker string, n int")
    v2 = publish(b, root, partition_by=["Universe"], only_partitions=True)
    got = sorted(tuple(r) for r in read_current(spark, root, a.schema).collect())
    assert got == [("A", "x", 1), ("B", "z", 3)]
    # v=1 still holds universe A, so expiring keeps it
    assert expire_snapshots(spark, root, keep=1) == []
    v3 = publish(a, root, partition_by=["Universe"])
    assert expire_snapshots(spark, root, keep=1) == [1, v2]
    assert sorted(tuple(r) for r in read_current(spark, root, a.schema).collect()) == [("A", "x", 1), ("B", "y", 2)]
    assert v3 == 3


def test_compact_touches_only_landed_universes(spark, tmp_root):
    from tickvault.streaming.bars import append_log

    schema = PRICES_STORED
    rows = [("A", "x", dt.date(2020, 1, 1), 1.0), ("B", "y", dt.date(2020, 1, 1), 2.0)]
    cols = "Universe string, Ticker string, Date date, Close double"
    log_root, table_root = os.path.join(tmp_root, "log"), os.path.join(tmp_root, "table")
    append_log(spark.createDataFrame(rows, cols).withColumn("seq", F.lit(0).cast("long")), 0, log_root)
    assert compact(spark, log_root, table_root, schema) == 1
    append_log(spark.createDataFrame([("B", "y", dt.date(2020, 1, 1), 3.0)], cols).withColumn("seq", F.lit(0).cast("long")), 1, log_root)
    assert compact(spark, log_root, table_root, schema) == 2
    before, after = snapshot(spark, table_root, 1).parts, snapshot(spark, table_root).parts
    assert set(after) == {("A", "2020"), ("B", "2020")}
    assert {p for p in after if after[p] != before[p]} == {("B", "2020")}
    got = {r.Universe: r.Close for r in read_current(spark, table_root, schema).collect()}
    assert got == {"A": 1.0, "B": 3.0}


def test_prices_guards(spark, tmp_root):
    root = os.path.join(tmp_root, "prices")
    universe = fx.parts_universe(spark, SF)
    landed = fx.gappy_log(spark, SF).withColumn("seq", F.col("seq") * 1_000_000 + F.col("seq_tie")).drop("batch_id", "seq_tie")
    with pytest.raises(ValueError):
        maintain_prices(spark, universe, landed, root, "update", as_of="2002-01-01")
    assert maintain_prices(spark, universe, landed, root, "fresh", as_of="2002-01-01", start="1995-01-01").version == 1
    # everything stored: the fresh plan is empty, nothing is republished
    again = maintain_prices(spark, universe, landed, root, "fresh", as_of="2002-01-01", start="1995-01-01")
    assert again.version == 1 and again.plan.count() == 0 and list_versions(spark, root) == [1]


def test_free_float_resume_mode(spark, tmp_root):
    from tickvault.schemas import FREE_FLOAT

    root = os.path.join(tmp_root, "ff1")
    universe = fx.users_universe(spark, SF)
    attempts = fx.attempts(spark, SF)
    r1 = maintain_free_float(spark, universe, attempts, root, as_of="2024-02-01 00:00:00", plan="resume", success_rule="value")
    stored = read_current(spark, root, FREE_FLOAT)
    n = stored.count()
    assert n == attempts.select("Ticker").distinct().count()
    # v1 rule: status follows the percentage
    bad = stored.filter("(Status = 'SUCCESS') <> (`Free Float (%)` IS NOT NULL)").count()
    assert bad == 0
    # a second run much later plans only the universe rows never stored
    r2 = maintain_free_float(spark, universe, attempts, root, as_of="2025-01-01 00:00:00", plan="resume")
    assert r2.plan.count() == universe.count() - n


def test_stats_side_table_tracks_the_bars(spark, tmp_root):
    from tickvault.jobs import ticker_stats
    from tickvault.schemas import TICKER_STATS

    root = os.path.join(tmp_root, "prices")
    universe = fx.parts_universe(spark, SF)
    landed = fx.gappy_log(spark, SF).withColumn("seq", F.col("seq") * 1_000_000 + F.col("seq_tie")).drop("batch_id", "seq_tie")
    settled = landed.join(fx.gappy_stored_log(spark, SF).select("Ticker", "Date").distinct(), ["Ticker", "Date"], "left_semi")

    def same():
        bars = read_prices(spark, root)
        want = sorted(
            tuple(r)
            for r in bars.groupBy("Universe", "Ticker")
            .agg(F.min("Date").alias("f"), F.max("Date").alias("l"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        got = sorted(tuple(r) for r in ticker_stats(spark, root).select("Universe", "Ticker", "first_date", "last_date", "n_bars").collect())
        return got == want and len(got) > 0

    maintain_prices(spark, universe, settled, root, "fresh", as_of="2002-01-01", start="1995-01-01")
    assert same()
    maintain_prices(spark, universe, landed, root, "update", as_of="2002-01-01")
    assert same()
    # the update reached only the years of its windows: 2001 was rewritten,
    # earlier years still point at version 1
    first, parts = snapshot(spark, root, 1).parts, snapshot(spark, root).parts
    assert any(w != first[p] for p, w in parts.items() if p[1] == "2001")
    assert all(w == first[p] for p, w in parts.items() if p[1] == "1996")
    # a table published without stats: planning falls back to the bars
    plain = os.path.join(tmp_root, "plain")
    publish(read_prices(spark, root), plain, partition_by=["Universe"])
    assert read_table(spark, plain, TICKER_STATS, side="stats") is None


def test_layout_migration_and_guard(spark, tmp_root):
    root = os.path.join(tmp_root, "prices")
    universe = fx.parts_universe(spark, SF)
    landed = fx.gappy_log(spark, SF).withColumn("seq", F.col("seq") * 1_000_000 + F.col("seq_tie")).drop("batch_id", "seq_tie")
    settled = landed.join(fx.gappy_stored_log(spark, SF).select("Ticker", "Date").distinct(), ["Ticker", "Date"], "left_semi")
    # an older table laid out by universe only
    old = settled.dropDuplicates(["Universe", "Ticker", "Date"]).select(*COLS)
    publish(old, root, partition_by=["Universe"])
    with pytest.raises(ValueError):
        publish(old.limit(1), root, partition_by=["Universe", "year"], only_partitions=True)
    n_old = read_prices(spark, root).count()
    run = maintain_prices(spark, universe, landed, root, "update", as_of="2002-01-01")
    assert snapshot(spark, root).by == ["Universe", "year"]
    assert read_prices(spark, root).count() >= n_old and run.version == 2


def test_stream_compacts_every_batch(spark, tmp_root):
    landing = os.path.join(tmp_root, "landing")
    log = fx.bars_log(spark, SF).withColumn("seq", F.col("seq") * 1_000_000 + F.col("seq_tie")).drop("seq_tie")
    for b in range(3):
        log.filter(F.col("batch_id") == b).drop("batch_id").coalesce(1).write.parquet(os.path.join(landing, f"b{b}"))
    flat = os.path.join(tmp_root, "flat")
    os.makedirs(flat)
    files = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(landing) for f in fs if f.endswith(".parquet"))
    for i, p in enumerate(files):
        os.rename(p, os.path.join(flat, f"{i:03d}.parquet"))
        os.utime(os.path.join(flat, f"{i:03d}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    schema = spark.read.parquet(flat).schema
    log_root, table_root = os.path.join(tmp_root, "log"), os.path.join(tmp_root, "table")
    q = stream_landed(
        spark, flat, schema, log_root, checkpoint=os.path.join(tmp_root, "cp"), max_files_per_trigger=1,
        compact_every=1, table_root=table_root, table_schema=PRICES_STORED,
    )
    q.awaitTermination()
    assert list_versions(spark, table_root) == [1, 2, 3]
    batch = resolve_latest(fx.bars_log(spark, SF), ["Universe", "Ticker", "Date"], fx.BARS_LOG_ORDER)
    assert _rows(read_current(spark, table_root, PRICES_STORED)) == _rows(batch)


def test_published_files_are_ordered(spark, tmp_root):
    import glob

    import pyarrow.parquet as pq

    root = os.path.join(tmp_root, "t")
    df = fx.gappy_log(spark, SF).select(*COLS).withColumn("year", F.year("Date"))
    publish(df, root, partition_by=["Universe", "year"], sort_within=[F.col("Ticker"), F.asc_nulls_last("Date")])
    files = glob.glob(os.path.join(root, "data", "w=*", "Universe=*", "year=*", "*.parquet"))
    assert files
    for f in files:
        t = pq.read_table(f, columns=["Ticker", "Date"]).to_pandas()
        assert t[["Ticker", "Date"]].apply(tuple, axis=1).is_monotonic_increasing


def test_expire_keeps_versions_sides_point_to(spark, tmp_root):
    from tickvault.schemas import TICKER_STATS

    root = os.path.join(tmp_root, "t")
    rows = [("A", "x", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1), ("B", "y", dt.date(2021, 1, 1), 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "Universe string, Ticker string, Date date, Open double, High double, Low double, Close double, Volume long")
    from tickvault.jobs import bar_stats

    df = df.withColumn("year", F.year("Date"))
    publish(df, root, partition_by=["Universe", "year"], sides={"stats": bar_stats})
    publish(df.filter("Universe = 'B'"), root, partition_by=["Universe", "year"], only_partitions=True, sides={"stats": bar_stats})
    assert expire_snapshots(spark, root, keep=1) == []  # v=1 still holds A's rows and stats
    st = read_table(spark, root, TICKER_STATS, side="stats", keep_partition_columns=True)
    assert sorted((r.Universe, r.Ticker) for r in st.collect()) == [("A", "x"), ("B", "y")]
    assert read_prices(spark, root).count() == 2
