"""Command line: backfill settings and a full prices + gaps + free-float run."""

import os

from pyspark.sql import functions as F

from tickvault import fixtures as fx
from tickvault.cli import backfill_start, main, min_gap
from tickvault.sources.store import read_prices

SF = "/root/testdata/sf0.001"


def test_backfill_settings():
    assert backfill_start("1998") == "1998-01-01"
    assert backfill_start("98") == "2000-01-01"
    assert backfill_start(" abcd ") == "2000-01-01"
    assert backfill_start(None) == "2000-01-01"
    assert min_gap("30") == 30 and min_gap("x") == 7 and min_gap("") == 7


def test_cli_runs(spark, tmp_root, capsys):
    lists = os.path.join(tmp_root, "lists")
    os.makedirs(lists)
    parts = [r.Ticker for r in fx.parts_universe(spark, SF).orderBy("pos").collect()]
    with open(os.path.join(lists, "parts.txt"), "w") as f:
        f.write("\r\n".join(parts))
    landed = os.path.join(tmp_root, "landed")
    fx.gappy_log(spark, SF).withColumn("seq", F.col("seq") * 1_000_000 + F.col("seq_tie")).drop(
        "Universe", "batch_id", "seq_tie"
    ).write.parquet(landed)
    store = os.path.join(tmp_root, "prices")
    args = ["prices", "--universe", lists, "--landed", landed, "--store", store, "--as-of", "2002-01-01"]
    assert main([*args, "--mode", "fresh", "--start", "1995-01-01"], spark=spark) == 0
    n = read_prices(spark, store).count()
    assert n == fx.gappy_log(spark, SF).select("Ticker", "Date").distinct().count()
    assert main([*args, "--mode", "backfill", "--backfill-year", "1995", "--min-gap", "30"], spark=spark) == 0
    assert read_prices(spark, store).count() == n  # complete feed: nothing to fill
    assert main(["gaps", "--universe", lists, "--store", store, "--backfill-year", "1995", "--min-gap", "30"], spark=spark) == 0
    out = capsys.readouterr().out
    assert "published version 1" in out and "tickers_scanned" in out
    att = os.path.join(tmp_root, "attempts")
    fx.attempts(spark, SF).write.parquet(att)
    users = os.path.join(tmp_root, "users")
    os.makedirs(users)
    with open(os.path.join(users, "users.txt"), "w") as f:
        f.write("\n".join(r.Ticker for r in fx.attempts(spark, SF).select("Ticker").distinct().collect()))
    ff = os.path.join(tmp_root, "ff")
    assert main(["free-float", "--universe", users, "--attempts", att, "--store", ff, "--as-of", "2024-02-01 00:00:00"], spark=spark) == 0
    assert main(["expire", "--store", store, "--keep", "1"], spark=spark) == 0


def test_recommended_conf():
    from tickvault.session import recommended_conf

    c = recommended_conf(total_input_bytes=100 << 40)
    assert c["spark.sql.autoBroadcastJoinThreshold"] == "10MB"
    assert c["spark.sql.adaptive.enabled"] == "true"
    assert int(c["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert "spark.ui.enabled" not in c


def test_cli_free_float_resume_only(spark, tmp_root, capsys):
    att = os.path.join(tmp_root, "attempts")
    fx.attempts(spark, SF).write.parquet(att)
    users = os.path.join(tmp_root, "users")
    os.makedirs(users)
    with open(os.path.join(users, "users.txt"), "w") as f:
        f.write("\n".join(r.Ticker for r in fx.attempts(spark, SF).select("Ticker").distinct().collect()))
    ff = os.path.join(tmp_root, "ff")
    args = ["free-float", "--universe", users, "--attempts", att, "--store", ff, "--as-of", "2024-02-01 00:00:00", "--resume-only"]
    assert main(args, spark=spark) == 0
    out = capsys.readouterr().out
    assert "published version 1" in out and "success" in out
