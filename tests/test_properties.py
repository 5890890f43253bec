"""Operators against brute-force loops on random small inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickvault.operators.gaps import find_gaps
from tickvault.operators.merge import resolve_latest
from tickvault.operators.positions import dense_position
from tickvault.plans.windows import apply_windows

BASE = dt.date(2000, 1, 1)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def brute_gaps(rows, start, n):
    """The reference rule as a plain loop over sorted dates per ticker."""
    out = []
    by = {}
    for t, d in rows:
        by.setdefault(t, []).append(d)
    for t, ds in by.items():
        ds = sorted(ds)
        if (ds[0] - start).days > n:
            out.append((t, start, ds[0] - dt.timedelta(days=1)))
        for a, b in zip(ds, ds[1:]):
            if (b - a).days > n:
                out.append((t, a + dt.timedelta(days=1), b - dt.timedelta(days=1)))
    return sorted(out)


dates = st.integers(min_value=-40, max_value=900).map(lambda k: BASE + dt.timedelta(days=k))
bar_rows = st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), dates), min_size=1, max_size=60)


@SETTINGS
@given(rows=bar_rows, n=st.integers(min_value=0, max_value=40))
def test_gaps_match_loop(spark, rows, n):
    rows = rows + rows[: len(rows) // 3]  # duplicates on purpose
    df = spark.createDataFrame([("u", t, d) for t, d in rows], "Universe string, Ticker string, Date date")
    got = sorted((r.Ticker, r.gap_start, r.gap_end) for r in find_gaps(df, start=BASE, min_gap_days=n, keys=["Universe", "Ticker"]).collect())
    assert got == brute_gaps(rows, BASE, n)


@SETTINGS
@given(keys=st.lists(st.integers(min_value=0, max_value=5000), min_size=1, max_size=80, unique=True))
def test_dense_position_is_row_number(spark, keys):
    df = spark.createDataFrame([("g" + str(k % 3), k) for k in keys], "grp string, k long")
    got = {(r.grp, r.k): r.position for r in dense_position(df, ["grp"], "k", bucket_size=16).collect()}
    want = {
        (r.grp, r.k): r.rn
        for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy("k"))).collect()
    }
    assert got == want


windows = st.lists(
    st.tuples(st.sampled_from(["A", "B"]), st.integers(min_value=0, max_value=400), st.integers(min_value=0, max_value=120)),
    min_size=1,
    max_size=8,
)


@SETTINGS
@given(rows=bar_rows, wins=windows)
def test_apply_windows_is_range_join(spark, rows, wins):
    # non-overlapping windows per ticker, as plans produce
    plan, last = [], {}
    for t, s, ln in sorted(wins):
        s = max(s, last.get(t, -100))
        e = s + ln
        last[t] = e
        plan.append(("u", t, BASE + dt.timedelta(days=s), BASE + dt.timedelta(days=e)))
    raw = spark.createDataFrame([("u", t, d, i) for i, (t, d) in enumerate(rows)], "Universe string, Ticker string, Date date, seq long")
    p = spark.createDataFrame(plan, "Universe string, Ticker string, start_date date, end_date date")
    want = sorted(i for i, (t, d) in enumerate(rows) for (_, pt, s, e) in plan if pt == t and s <= d < e)
    for bound in (250_000, 0):  # broadcast, and shuffled by month
        got = sorted(r.seq for r in apply_windows(raw, p, keys=["Universe", "Ticker"], broadcast_max_rows=bound).collect())
        assert got == want


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 3), st.integers(0, 4), st.integers(0, 99)), min_size=1, max_size=40))
def test_resolve_latest_matches_keep_last(spark, rows):
    # write order = (batch, position in list); pandas keep="last" semantics
    seen = {}
    ordered = sorted(enumerate(rows), key=lambda x: (x[1][2], x[0]))
    for i, (t, d, b, v) in ordered:
        seen[(t, d)] = v
    df = spark.createDataFrame([(t, d, b, i, v) for i, (t, d, b, v) in enumerate(rows)], "Ticker string, d int, batch_id long, seq long, v int")
    got = {(r.Ticker, r.d): r.v for r in resolve_latest(df, ["Ticker", "d"]).collect()}
    assert got == seen


def test_plan_invariants(spark):
    """SURVEY §5: windows of a ticker never overlap; fresh plan ∩ stored = ∅."""
    from tickvault import fixtures as fx
    from tickvault.plans import work

    sf = "/root/testdata/sf0.001"
    plan = work.plan_backfill(fx.parts_universe(spark, sf), fx.gappy_stored_log(spark, sf), start="1995-01-01", min_gap_days=7)
    w = Window.partitionBy("Universe", "Ticker").orderBy("start_date")
    overlaps = plan.withColumn("prev_end", F.lag("end_date").over(w)).filter(F.col("prev_end") > F.col("start_date"))
    assert plan.count() > 0 and overlaps.count() == 0
    stored = fx.pending_order_keys(spark, sf)
    fresh = work.plan_fresh(fx.customer_universe(spark, sf), stored, as_of="2001-08-01")
    assert fresh.count() > 0 and fresh.join(stored, ["Universe", "Ticker"], "inner").count() == 0


@SETTINGS
@given(
    stored=st.lists(st.tuples(st.sampled_from("AB"), st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 99)), max_size=15),
    landed=st.lists(st.tuples(st.sampled_from("ABC"), st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 2), st.integers(0, 99)), max_size=25),
)
def test_merge_latest_equals_resolve_over_union(spark, stored, landed):
    from tickvault.operators.merge import merge_latest

    # a published table holds one row per key
    uniq = {}
    for t, d, v in stored:
        uniq[(t, d)] = v
    s_df = spark.createDataFrame([(t, d, v) for (t, d), v in uniq.items()], "Ticker string, d int, v int")
    l_df = spark.createDataFrame([(t, d, b, i, v) for i, (t, d, b, v) in enumerate(landed)], "Ticker string, d int, batch_id long, seq long, v int")
    got = sorted(merge_latest(s_df, l_df, ["Ticker", "d"]).collect(), key=lambda r: (r.Ticker, -1 if r.d is None else r.d))
    want = dict(uniq)
    for i, (t, d, b, v) in sorted(enumerate(landed), key=lambda x: (x[1][2], x[0])):
        want[(t, d)] = v
    assert [(r.Ticker, r.d, r.v) for r in got] == sorted(((t, d, v) for (t, d), v in want.items()), key=lambda x: (x[0], -1 if x[1] is None else x[1]))
