"""Literal golden cases (FIXTURES.md §3)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tickvault.functions import free_float_pct, local_date
from tickvault.operators import freefloat as ffo
from tickvault.operators.gaps import find_gaps
from tickvault.operators.merge import merge_latest, resolve_latest
from tickvault.plans import work
from tickvault.schemas import ATTEMPTS, FREE_FLOAT
from tickvault.sources.store import union_free_float_versions
from tickvault.sources.universe import list_universes, read_universe

D = dt.date.fromisoformat


def test_universe_lines(spark, tmp_root):
    with open(os.path.join(tmp_root, "demo.txt"), "wb") as f:
        f.write(b"aa.x\r\n  bb.x \r\n\r\n\tcc.x\r\ndd.x")
    rows = read_universe(spark, tmp_root).orderBy("pos").collect()
    assert [r.Ticker for r in rows] == ["AA.X", "BB.X", "CC.X", "DD.X"]
    assert {r.Universe for r in rows} == {"demo"}
    raw = read_universe(spark, tmp_root, upper=False).orderBy("pos").collect()
    assert [r.Ticker for r in raw] == ["aa.x", "bb.x", "cc.x", "dd.x"]


def test_universe_files(spark, tmp_root):
    for name, body in [("land2k1.txt", "Q\nQ\n"), ("b.TO.txt", "X\n"), ("readme.md", "nope\n")]:
        with open(os.path.join(tmp_root, name), "w") as f:
            f.write(body)
    names = [r.Universe for r in list_universes(spark, tmp_root).collect()]
    assert names == ["b.TO", "land2k1"]  # readme.md ignored, code-point order
    u = read_universe(spark, tmp_root)
    assert sorted(r.Ticker for r in u.filter("Universe = 'land2k1'").collect()) == ["Q", "Q"]
    assert u.filter("Universe = 'readme'").count() == 0


@pytest.mark.parametrize(
    "so,fs,want",
    [(100.0, 25.0, 25.0), (0.0, 5.0, None), (-10.0, 5.0, None), (100.0, 0.0, None), (100.0, None, None),
     (float("nan"), 5.0, None), (100.0, -5.0, -5.0), (3.0, 1.0, 33.33), (100.0, float("nan"), None)],
)
def test_free_float_pct(spark, so, fs, want):
    df = spark.createDataFrame([(so, fs)], "so double, fs double")
    got = df.select(free_float_pct("so", "fs").alias("p")).first().p
    assert got == want


def test_age_rule(spark):
    as_of = "2024-01-31 12:00:00"
    ff = spark.createDataFrame(
        [
            ("u", "A", "2024-01-24 12:00:01"),  # 6 d 23:59:59 -> fresh
            ("u", "B", "2024-01-24 12:00:00"),  # 7 d -> due
            ("u", "C", None),  # NULL -> due
            ("u", "D", "bad"),  # unparsable -> due
            ("u", "F", "2024-02-05 00:00:00"),  # future -> fresh
        ],
        "Universe string, Ticker string, `Last Updated` string",
    )
    uni = spark.createDataFrame([("u", i, t) for i, t in enumerate("ABCDEF")], "Universe string, pos long, Ticker string")
    due = {r.Ticker: r.reason for r in work.plan_stale(uni, ff, None, as_of).collect()}
    assert due == {"B": "stale", "C": "unparsable", "D": "unparsable", "E": "missing"}


def _bars(spark, rows):
    return spark.createDataFrame(
        [("u", t, D(d)) for t, d in rows], "Universe string, Ticker string, Date date"
    )


def _gaps(df, **kw):
    return sorted((r.Ticker, str(r.gap_start), str(r.gap_end)) for r in find_gaps(df, keys=["Universe", "Ticker"], **kw).collect())


def test_leading_gap(spark):
    assert _gaps(_bars(spark, [("A", "2000-01-08")]), start="2000-01-01", min_gap_days=7) == []
    assert _gaps(_bars(spark, [("A", "2000-01-09")]), start="2000-01-01", min_gap_days=7) == [
        ("A", "2000-01-01", "2000-01-08")
    ]


def test_interior_gap(spark):
    assert _gaps(_bars(spark, [("A", "2020-01-01"), ("A", "2020-01-08")]), start="2020-01-01", min_gap_days=7) == []
    assert _gaps(_bars(spark, [("A", "2020-01-01"), ("A", "2020-01-09")]), start="2020-01-01", min_gap_days=7) == [
        ("A", "2020-01-02", "2020-01-08")
    ]
    # no trailing gap; neighbours before start still count
    assert _gaps(_bars(spark, [("A", "1999-01-01"), ("A", "1999-03-01")]), start="2000-01-01", min_gap_days=7) == [
        ("A", "1999-01-02", "1999-02-28")
    ]


def test_merge_newest_wins_idempotent(spark):
    schema = "Universe string, Ticker string, Date date, Close double, batch_id long, seq long"
    stored = spark.createDataFrame([("u", "A", D("2020-01-01"), 1.0)], "Universe string, Ticker string, Date date, Close double")
    batch = spark.createDataFrame([("u", "A", D("2020-01-01"), 2.0, 1, 0)], schema)
    once = merge_latest(stored, batch, ("Universe", "Ticker", "Date"))
    twice = merge_latest(once, batch, ("Universe", "Ticker", "Date"))
    assert [(r.Ticker, r.Close) for r in twice.collect()] == [("A", 2.0)]


def test_upsert_failure_modes(spark):
    cur = spark.createDataFrame(
        [("u", "A", 100.0, 25.0, 25.0, "SUCCESS", None, dt.datetime(2024, 1, 1))],
        FREE_FLOAT,
    )
    inc = spark.createDataFrame(
        [("u", "A", None, None, None, "FAILED", "boom", dt.datetime(2024, 2, 1))],
        FREE_FLOAT,
    )
    r = ffo.upsert_free_float(cur, inc, "replace").first()
    assert (r["Shares Outstanding"], r["Free Float (%)"], r.Status) == (None, None, "FAILED")
    k = ffo.upsert_free_float(cur, inc, "keep_last_good").first()
    assert (k["Shares Outstanding"], k["Free Float (%)"], k.Status, k.Error) == (100.0, 25.0, "FAILED", "boom")


def test_update_plan(spark):
    prices = spark.createDataFrame(
        [("u", "A", D("2024-06-07")), ("u", "B", D("2024-06-10"))], "Universe string, Ticker string, Date date"
    )
    uni = spark.createDataFrame([("u", 0, "A"), ("u", 1, "B"), ("u", 2, "C")], "Universe string, pos long, Ticker string")
    got = {r.Ticker: (r.kind, str(r.start_date), str(r.end_date)) for r in work.plan_update(uni, prices, "2024-06-10").collect()}
    assert got == {"A": ("update", "2024-06-02", "2024-06-10"), "C": ("new", "2000-01-01", "2024-06-10")}


def _att(spark, rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("u", k, a, ok, '{"sharesOutstanding": 10.0, "floatShares": 5.0}' if ok else None, e, t, t) for k, a, ok, e in rows],
        ATTEMPTS,
    )


def test_attempts(spark):
    a = _att(
        spark,
        [
            ("A", 0, False, "x"), ("A", 1, True, None), ("A", 2, True, None),
            ("B", 0, False, "e1"), ("B", 1, False, "e2"), ("B", 2, False, "e3"), ("B", 3, True, None),
            ("C", 0, False, "y" * 600),
            ("D", 0, False, ""),
        ],
    )
    got = {r.Ticker: r for r in ffo.resolve_attempts(a).collect()}
    assert got["A"].Status == "SUCCESS" and got["A"].tries == 2 and got["A"].Error is None
    assert got["B"].Status == "FAILED" and got["B"].Error == "e3" and got["B"].tries == 3
    assert len(got["C"].Error) == 500
    assert got["D"].Error == "Unknown error"
    rows = {r.Ticker: r for r in ffo.results_to_rows(ffo.resolve_attempts(a), as_of="2024-01-02").collect()}
    assert rows["A"]["Free Float (%)"] == 50.0 and rows["B"]["Shares Outstanding"] is None


def test_rate_limit_waits(spark):
    a = _att(spark, [("A", 0, False, "HTTP 429"), ("A", 2, False, "Too Many Requests"), ("B", 0, False, "oops"), ("B", 2, False, "oops")])
    got = {(r.Ticker, r.attempt): (r.rate_limited, r.retry_wait_min_s, r.retry_wait_max_s) for r in ffo.classify_errors(a).collect()}
    assert got[("A", 0)] == (True, 30, 30)
    assert got[("A", 2)] == (True, 90, 90)  # also after the last try
    assert got[("B", 0)] == (False, 3, 7)
    assert got[("B", 2)] == (False, 0, 0)  # no wait after the last try


def test_zone_keeps_local_date(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 17, 0),)], "ts timestamp_ntz")
    assert df.select(local_date("ts", "Asia/Jakarta").alias("d")).first().d == D("2020-01-02")
    assert df.select(local_date("ts", "America/New_York").alias("d")).first().d == D("2020-01-01")


def test_five_column_union(spark):
    v1 = spark.createDataFrame(
        [("u", "A", 1.0, 1.0, 100.0, dt.datetime(2024, 1, 1))],
        "Universe string, Ticker string, `Shares Outstanding` double, `Float Shares` double, `Free Float (%)` double, `Last Updated` timestamp_ntz",
    )
    v2 = spark.createDataFrame([("u", "B", 1.0, 1.0, 100.0, "SUCCESS", None, dt.datetime(2024, 1, 1))], FREE_FLOAT)
    rows = {r.Ticker: r for r in union_free_float_versions(v1, v2).collect()}
    assert rows["A"].Status is None and rows["A"].Error is None and rows["B"].Status == "SUCCESS"


def test_resolve_latest_nulls_group(spark):
    df = spark.createDataFrame(
        [("A", None, 1.0, 0, 0), ("A", None, 2.0, 0, 1)], "Ticker string, Date date, Close double, batch_id long, seq long"
    )
    out = resolve_latest(df, ["Ticker", "Date"]).collect()
    assert [(r.Ticker, r.Close) for r in out] == [("A", 2.0)]


def test_universe_order_across_splits(spark, tmp_root):
    lines = [f"t{i:03d}" for i in range(300)]
    lines[17] = "  "  # blank line dropped
    lines[40] = lines[39]  # duplicate kept
    with open(os.path.join(tmp_root, "big.txt"), "w") as f:
        f.write("\r\n".join(lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(tmp_root).rdd.getNumPartitions() > 10  # many input splits
        u = read_universe(spark, tmp_root, upper=False)
        got = [(r.pos, r.Ticker) for r in u.orderBy("pos").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [t.strip() for t in lines if t.strip()]
    assert [t for _, t in got] == want
    assert [p for p, _ in got] == list(range(1, len(want) + 1))


def test_upsert_keep_last_good_across_batches(spark):
    t = dt.datetime(2024, 1, 1)
    cur = spark.createDataFrame(
        [("u", "A", 10.0, 1.0, 10.0, "SUCCESS", None, t), ("u", "Z", 5.0, 5.0, 100.0, "SUCCESS", None, t)], FREE_FLOAT
    )
    inc = spark.createDataFrame(
        [
            ("u", "A", 20.0, 2.0, 10.0, "SUCCESS", None, t, 1, 0),
            ("u", "A", None, None, None, "FAILED", "boom", t, 2, 0),
            ("u", "B", None, None, None, "FAILED", "x", t, 1, 0),
        ],
        "Universe string, Ticker string, `Shares Outstanding` double, `Float Shares` double, `Free Float (%)` double, "
        "Status string, Error string, `Last Updated` timestamp_ntz, batch_id long, seq long",
    )
    got = {r.Ticker: r for r in ffo.upsert_free_float(cur, inc, "keep_last_good").collect()}
    assert (got["A"]["Shares Outstanding"], got["A"].Status, got["A"].Error) == (20.0, "FAILED", "boom")
    assert got["B"]["Shares Outstanding"] is None and got["Z"]["Shares Outstanding"] == 5.0
    rep = {r.Ticker: r for r in ffo.upsert_free_float(cur, inc, "replace").collect()}
    assert rep["A"]["Shares Outstanding"] is None and rep["Z"]["Free Float (%)"] == 100.0 and len(rep) == 3


def test_universe_lists_across_part_files(spark, tmp_root):
    from tickvault import fixtures as fx

    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        root = fx.write_segment_lists(spark, "/root/testdata/sf0.001", os.path.join(tmp_root, "lists"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    seg = sorted(d for d in os.listdir(root) if d.startswith("Universe="))[0]
    assert len([f for f in os.listdir(os.path.join(root, seg)) if f.endswith(".txt")]) > 1
    u = read_universe(spark, root)
    got = {}
    for r in u.orderBy("Universe", "pos").collect():
        got.setdefault(r.Universe, []).append((r.pos, r.Ticker))
    cust = fx.table(spark, "/root/testdata/sf0.001", "customer").collect()
    for name, rows in got.items():
        keys_sorted = sorted(c.c_custkey for c in cust if c.c_mktsegment == name)
        assert [t for _, t in rows] == [f"C{k}" for k in keys_sorted]
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))


def test_resolve_latest_deterministic_ties(spark):
    rows = [("A", 1, 0, 0, float(v)) for v in range(20)]  # all tie on (batch_id, seq)
    df = spark.createDataFrame(rows, "Ticker string, d int, batch_id long, seq long, v double")
    picks = {
        resolve_latest(df.repartition(n), ["Ticker", "d"], deterministic_ties=True).first().v for n in (1, 3, 7)
    }
    assert len(picks) == 1
