"""Registered queries over several runs, stored state and landed files, with
their DuckDB statements: resumed streams and runs, universes taken from a cache
or a remote source, wide and raw inputs, SQL text over the views, run summaries.

As in :mod:`tickvault.catalog`, each takes ``(spark, sf_dir)``; tables it
publishes go to a fresh folder under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickvault import fixtures as fx
from tickvault import oracle as o
from tickvault.jobs import maintain_free_float, maintain_prices
from tickvault.operators import freefloat as ffo
from tickvault.operators.normalize import TUPLE_LABEL, normalize_quotes, unstack_wide
from tickvault.plans import work
from tickvault.plans.windows import materialise
from tickvault.schemas import FREE_FLOAT, PRICES_STORED
from tickvault.session import shared_dir
from tickvault.sinks.marks import stored_marks, write_marks
from tickvault.sinks.publish import publish, snapshot
from tickvault.sources.store import read_current, read_free_float, read_prices
from tickvault.sources.universe import UniverseSource, cache_universe, read_marks
from tickvault.streaming.bars import compact, log_batches, stream_landed
from tickvault.views import LAST_UPDATED, STORED_TICKERS, TABLES, register_views

KEYS = ["Universe", "Ticker"]
PRICE_OUT = ["Universe", "Ticker", "Date", "Open", "High", "Low", "Close", "Volume"]
FF_OUT = [f.name for f in FREE_FLOAT.fields]
SECOND_AS_OF = "2024-02-01 12:00:00"


def _root(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"queries/{name}/{uuid.uuid4().hex}")


# ---------------------------------------------------------------- streams

#: The feed's own order; micro-batches may cut it anywhere.
FEED_ORDER = ("src_batch", "seq", "seq_tie")


def _to_log(landed: DataFrame) -> DataFrame:
    bars = fx.bars_log_from_lineitem(landed).withColumnRenamed("batch_id", "src_batch")
    return bars.select(*PRICE_OUT, *FEED_ORDER)


def _streamed(spark: SparkSession, sf: str, root: str) -> None:
    """Three landings of the line items through two starts of one stream: the
    second start takes up at the first one's checkpoint, in micro-batches of a
    landing's files, and the log is compacted into a table."""
    lineitem = fx.table(spark, sf, "lineitem")

    def land(batch: int) -> int:
        lineitem.filter(F.col("l_orderkey") % 3 == batch).write.mode("append").parquet(f"{root}/landing")
        return len(spark.read.schema(lineitem.schema).parquet(f"{root}/landing").inputFiles())

    def run(files: int) -> None:
        query = stream_landed(
            spark, f"{root}/landing", lineitem.schema, f"{root}/log",
            checkpoint=f"{root}/checkpoint", max_files_per_trigger=files, transform=_to_log,
        )
        query.awaitTermination()

    first = land(0)
    run(first)
    assert log_batches(spark, f"{root}/log") == [0]
    second = land(1) - first
    land(2)
    run(second)
    # the files of the first start were not read again
    assert log_batches(spark, f"{root}/log")[:3] == [0, 1, 2]
    compact(spark, f"{root}/log", f"{root}/table", PRICES_STORED, order=FEED_ORDER)


def stream_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Several files, three micro-batches, a stop and a restart from the
    checkpoint; the compacted table equals keep_last."""
    root = _root(spark, "stream_keep_last")
    _streamed(spark, sf, root)
    return read_current(spark, f"{root}/table", PRICES_STORED).select(*PRICE_OUT)


def stream_then_update(spark: SparkSession, sf: str) -> DataFrame:
    """The table a stream keeps, then updated by the job from a feed
    that restates its last days."""
    root = _root(spark, "stream_then_update")
    _streamed(spark, sf, root)
    universe = fx.table(spark, sf, "supplier").select(
        F.lit("suppliers").alias("Universe"),
        F.col("s_suppkey").cast("long").alias("pos"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("Ticker"),
    )
    feed = fx.bars_log(spark, sf).withColumn("seq", F.col("seq") * F.lit(1_000_000) + F.col("seq_tie"))
    feed = feed.withColumn("Close", F.col("Close") * F.lit(2.0)).drop("batch_id", "seq_tie")
    maintain_prices(spark, universe, feed, f"{root}/table", "update", as_of="2002-01-01", start="1995-01-01")
    return read_prices(spark, f"{root}/table").select(*PRICE_OUT)


# ---------------------------------------------------------------- marks

class _Killed(Exception):
    """Stands for the loss of the driver."""


def run_killed_and_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """K4: a free-float run that commits in thirds dies after the first; the
    next run of the same id does the rest and clears the marks. Every stored
    row is due (``days=0``), so only the marks keep the first third as it is.
    ``was_marked`` is the state the resumed run found."""
    root = _root(spark, "run_killed_and_resumed")
    universe = fx.customer_universe(spark, sf)
    tries = fx.attempts(spark, sf, universe="customers", prefix="C")
    run = {"run_id": "refresh-1", "days": 0, "commit_every": -(-universe.count() // 3)}

    def die(version: int) -> None:
        raise _Killed(version)

    try:
        maintain_free_float(spark, universe, tries, root, as_of=fx.STALE_AS_OF, on_commit=die, **run)
    except _Killed:
        pass
    found = materialise(read_marks(stored_marks(spark, root), universe="customers", run_id="refresh-1"))
    maintain_free_float(spark, universe, tries, root, as_of=SECOND_AS_OF, **run)
    left = stored_marks(spark, root).select(F.count(F.lit(1))).scalar()
    marked = found.select(*KEYS).distinct().withColumn("was_marked", F.lit(True))
    return read_free_float(spark, root).join(marked, KEYS, "left").select(
        *FF_OUT, F.coalesce("was_marked", F.lit(False)).alias("was_marked"), left.alias("marks_left")
    )


def marks_of_a_run(spark: SparkSession, sf: str) -> DataFrame:
    """The marks of one universe and run out of several, stripped, blank
    lines dropped; only that run's and universe's folder is read."""
    root = _root(spark, "marks_of_a_run")
    urgent = fx.table(spark, sf, "orders").filter("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    padded = F.concat(F.lit("  C"), F.col("o_custkey").cast("string"), F.lit("\t "))
    lines = urgent.select(
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("customers")).otherwise(F.lit("others")).alias("Universe"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(" \t ")).otherwise(padded).alias("Ticker"),
    )
    done = fx.pending_order_keys(spark, sf).distinct()
    publish(done, root, beside=lambda w: write_marks(lines, root, "run-1", w))
    publish(done, root, beside=lambda w: write_marks(lines.filter("Universe = 'others'"), root, "run-2", w))
    return read_marks(stored_marks(spark, root), universe="customers", run_id="run-1")


# ---------------------------------------------------------------- universe sources (S3, K5)

LOCAL, REMOTE = "BUILDING", "MACHINERY"


def universe_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """S3/K5 through the free-float job: one universe is cached (an older list,
    half of its tickers), the other comes from the remote lists and is cached
    on the way. A second run finds both in the cache, with no remote at all."""
    root = _root(spark, "universe_fallback")
    remote = fx.segment_universe(spark, sf)
    cache_universe(remote.filter((F.col("Universe") == LOCAL) & (F.col("pos") % 2 == 0)), f"{root}/lists")
    tries = fx.attempts(spark, sf, universe="customers", prefix="C").drop("Universe")
    tries = tries.join(remote.select("Universe", "Ticker"), "Ticker")
    source = UniverseSource(f"{root}/lists", remote, [LOCAL, REMOTE])
    maintain_free_float(spark, source, tries, f"{root}/table", as_of=fx.STALE_AS_OF)
    offline = UniverseSource(f"{root}/lists", remote.filter(F.lit(False)), [LOCAL, REMOTE])
    maintain_free_float(spark, offline, tries, f"{root}/table", as_of=SECOND_AS_OF, days=0)
    return read_free_float(spark, f"{root}/table")


# ---------------------------------------------------------------- inputs

def wide_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """One frame for all tickers, a column per (field, ticker) with
    two-level labels, back to one bar a row (a ticker without quotes on a day
    has none)."""
    li, s, n = (fx.table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    price = F.col("l_extendedprice")
    quotes = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    fields = {
        "Open": F.min(price * (F.lit(1.0) - F.col("l_discount"))),
        "High": F.max(price * (F.lit(1.0) + F.col("l_tax"))),
        "Low": F.min(price * (F.lit(1.0) - F.col("l_discount") - F.col("l_tax"))),
        "Close": F.max(price),
        "Volume": F.sum(F.col("l_quantity").cast("long")),
    }
    wide = quotes.groupBy(F.col("l_shipdate").cast("date").alias("Date")).pivot("n_name").agg(
        *[agg.alias(field) for field, agg in fields.items()]
    )
    labels = [c if c == "Date" else "('{1}', '{0}')".format(*c.rsplit("_", 1)) for c in wide.columns]
    long = unstack_wide(wide.toDF(*labels), ["Date"], pattern=TUPLE_LABEL, drop_empty=True)
    return normalize_quotes(long, ticker_col="Ticker")


def _raw_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows as text: ISO instants, dates alone, nonsense, blanks, NULL."""
    k = F.substring("Ticker", 2, 20).cast("long")
    text = (
        F.when(k % 7 == 0, F.lit("not a date"))
        .when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 13 == 0, F.lit(""))
        .when(k % 17 == 0, F.lit("2024-13-45 00:00:00"))
        .when(k % 5 == 0, F.date_format("Last Updated", "yyyy-MM-dd"))
        .otherwise(F.date_format("Last Updated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    )
    return fx.signup_freshness(spark, sf).withColumn("Last Updated", text)


def plan_stale_raw_text(spark: SparkSession, sf: str) -> DataFrame:
    """J3 where ``Last Updated`` is raw text: what does not parse is due."""
    return work.plan_stale(fx.users_universe(spark, sf), _raw_freshness(spark, sf), None, as_of=fx.STALE_AS_OF)


def free_float_nan(spark: SparkSession, sf: str) -> DataFrame:
    """NaN in either input counts as missing, before any arithmetic."""
    key, nan = F.substring("Ticker", 2, 20).cast("long"), F.lit(float("nan"))
    info = fx.company_info(spark, sf).withColumns(
        {
            "sharesOutstanding": F.when(key % 13 == 0, nan).otherwise(F.col("sharesOutstanding")),
            "floatShares": F.when(key % 17 == 0, nan).otherwise(F.col("floatShares")),
        }
    )
    return ffo.with_free_float(info)


# ---------------------------------------------------------------- published tables (O1, SQL surface, summary)

def _fresh_prices(spark: SparkSession, sf: str, root: str):
    feed = fx.gappy_log(spark, sf).withColumn("seq", F.col("seq") * F.lit(1_000_000) + F.col("seq_tie"))
    feed = feed.drop("batch_id", "seq_tie")
    return maintain_prices(spark, fx.parts_universe(spark, sf), feed, root, "fresh", as_of="2002-01-01", start="1995-01-01")


def order_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """O1: the published files read back with each bar's row number in its
    file; per universe and year the bars, and those that stand behind a later
    one of their file."""
    root = _root(spark, "order_in_files")
    _fresh_prices(spark, sf, root)
    writes = sorted(set(snapshot(spark, root).parts.values()))
    rows = spark.read.option("basePath", f"{root}/data").parquet(*[f"{root}/data/w={w}" for w in writes])
    placed = rows.select("Universe", "year", "Ticker", "Date", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # a bar and the row before it in the file, without a window over the file
    before = placed.select("file", (F.col("row") + 1).alias("row"), F.struct("Ticker", "Date").alias("before"))
    pairs = placed.join(before, ["file", "row"], "left")
    return pairs.groupBy(F.col("Universe").cast("string").alias("Universe"), F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count_if(F.col("before") >= F.struct("Ticker", "Date")).alias("out_of_order"),
    )


def _free_float_views(spark: SparkSession, sf: str, name: str) -> None:
    root = _root(spark, name)
    universe = fx.customer_universe(spark, sf)
    maintain_free_float(spark, universe, fx.attempts(spark, sf, universe="customers", prefix="C"), root, as_of=fx.STALE_AS_OF)
    register_views(spark, free_float_root=root, universe=universe)


def sql_last_updated(spark: SparkSession, sf: str) -> DataFrame:
    """§2.11: ``Last Updated`` of a ticker, for all listed tickers at once."""
    _free_float_views(spark, sf, "sql_last_updated")
    return spark.sql(LAST_UPDATED)


def sql_stored_tickers(spark: SparkSession, sf: str) -> DataFrame:
    """§2.11: ``SELECT Ticker FROM free_float``."""
    _free_float_views(spark, sf, "sql_stored_tickers")
    return spark.sql(STORED_TICKERS)


def sql_tables(spark: SparkSession, sf: str) -> DataFrame:
    """§2.11: which tables exist (here with the rows they hold)."""
    _free_float_views(spark, sf, "sql_tables")
    return spark.sql(TABLES)


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of an update run: outcomes, stored rows, failed list, times."""
    root = _root(spark, "run_summary")
    _fresh_prices(spark, sf, root)
    feed = fx.gappy_log(spark, sf).withColumn("seq", F.col("seq") * F.lit(1_000_000) + F.col("seq_tie"))
    tries = fx.attempts(spark, sf, universe="parts", prefix="P")
    run = maintain_prices(
        spark, fx.parts_universe(spark, sf, shifted=True), feed.drop("batch_id", "seq_tie"), root, "update",
        as_of="2002-01-01", start="1995-01-01", attempts=tries,
    )
    return run.summary()


QUERIES = {
    "stream_keep_last": stream_keep_last,
    "stream_then_update": stream_then_update,
    "run_killed_and_resumed": run_killed_and_resumed,
    "marks_of_a_run": marks_of_a_run,
    "universe_fallback": universe_fallback,
    "wide_quotes": wide_quotes,
    "plan_stale_raw_text": plan_stale_raw_text,
    "free_float_nan": free_float_nan,
    "order_in_files": order_in_files,
    "sql_last_updated": sql_last_updated,
    "sql_stored_tickers": sql_stored_tickers,
    "sql_tables": sql_tables,
    "run_summary": run_summary,
}


# ---------------------------------------------------------------- DuckDB statements

_SECOND = f"TIMESTAMP '{SECOND_AS_OF}'"
_STREAMED = o._latest(o.BARS_S)
_RESTATED = o._feed_latest(
    f"""SELECT b.* FROM ({o.BARS_S}) b JOIN (
    SELECT Universe, Ticker, max(Date) - 5 AS start_date FROM ({_STREAMED}) GROUP BY ALL
    HAVING max(Date) < DATE '2002-01-01') p
  ON b.Universe = p.Universe AND b.Ticker = p.Ticker AND b.Date >= p.start_date AND b.Date < DATE '2002-01-01'"""
)
_FF_NUMBERS = '"Shares Outstanding", "Float Shares", "Free Float (%)"'
_CUSTOMER_ROWS = f"SELECT * FROM ({o._ff_rows('customers', 'C')}) r JOIN (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS t, c_custkey, c_mktsegment FROM customer) c ON c.t = r.Ticker"
_RAW_TEXT = f"""SELECT Universe, Ticker, CASE WHEN k % 7 = 0 THEN 'not a date' WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN ''
  WHEN k % 17 = 0 THEN '2024-13-45 00:00:00' WHEN k % 5 = 0 THEN strftime(lu, '%Y-%m-%d')
  ELSE strftime(lu, '%Y-%m-%dT%H:%M:%S.%f') END AS raw
FROM (SELECT *, CAST(substr(Ticker, 2) AS BIGINT) AS k FROM ({o.FF_SIGNUP}))"""
_LISTED_FF = f"SELECT r.* FROM ({o._ff_rows('customers', 'C')}) r WHERE EXISTS (SELECT 1 FROM ({o.U_CUST}) u WHERE u.Ticker = r.Ticker)"
_NAN_INFO = f"""SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN so END AS so, CASE WHEN c_custkey % 17 <> 0 THEN fs END AS fs FROM ({o.INFO})"""

# the update run of run_summary: a ticker whose tries are spent fetches nothing
_LAST = f"SELECT Universe, Ticker, max(Date) AS last_date FROM ({o._feed_latest(o.BARS_P)}) GROUP BY ALL"
_SUMMARY_PLAN = f"""SELECT u.Universe, u.pos, u.Ticker, COALESCE(l.last_date - 5, DATE '1995-01-01') AS start_date
FROM ({o.U_PARTS}) u LEFT JOIN ({_LAST}) l ON u.Universe = l.Universe AND u.Ticker = l.Ticker
WHERE l.last_date IS NULL OR l.last_date < DATE '2002-01-01'"""
_SUMMARY_OUT = f"""SELECT p.Universe, p.pos, p.Ticker, r.Status, r.started_at, r.finished_at,
  CASE WHEN r.Status = 'FAILED' THEN 'failed' WHEN EXISTS (SELECT 1 FROM ({o.BARS_P}) b WHERE b.Ticker = p.Ticker
    AND b.Date >= p.start_date AND b.Date < DATE '2002-01-01') THEN 'success' ELSE 'skipped' END AS outcome
FROM ({_SUMMARY_PLAN}) p LEFT JOIN ({o._resolved('parts', 'P')}) r ON r.Ticker = p.Ticker"""

SQL = {
    "stream_keep_last": _STREAMED,
    "stream_then_update": f"""SELECT {o.PRICE_OUT} FROM ({_STREAMED}) s
WHERE NOT EXISTS (SELECT 1 FROM ({_RESTATED}) f WHERE f.Universe = s.Universe AND f.Ticker = s.Ticker AND f.Date = s.Date)
UNION ALL SELECT Universe, Ticker, Date, Open, High, Low, Close * CAST(2 AS DOUBLE) AS Close, Volume FROM ({_RESTATED})""",
    "run_killed_and_resumed": f"""SELECT Universe, Ticker, {_FF_NUMBERS}, Status, Error,
  CASE WHEN first THEN {o.AS_OF_TS} ELSE {_SECOND} END AS "Last Updated", first AS was_marked, CAST(0 AS BIGINT) AS marks_left
FROM (SELECT r.*, p.first FROM ({_CUSTOMER_ROWS}) r JOIN (
    SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) <= ceil((SELECT count(*) FROM customer) / 3.0) AS first FROM customer) p
  ON p.c_custkey = r.c_custkey)""",
    "marks_of_a_run": """SELECT 'customers' AS Universe, 'run-1' AS run_id, 'C' || CAST(o_custkey AS VARCHAR) AS Ticker
FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""",
    "universe_fallback": f"""SELECT c_mktsegment AS Universe, Ticker, {_FF_NUMBERS}, Status, Error, {_SECOND} AS "Last Updated"
FROM ({_CUSTOMER_ROWS}) WHERE (c_mktsegment = '{LOCAL}' AND c_custkey % 2 = 0) OR c_mktsegment = '{REMOTE}'""",
    "wide_quotes": f"""SELECT n_name AS Ticker, CAST(l_shipdate AS DATE) AS Date,
  min(l_extendedprice * ({o.ONE} - l_discount)) AS Open, max(l_extendedprice * ({o.ONE} + l_tax)) AS High,
  min(l_extendedprice * ({o.ONE} - l_discount - l_tax)) AS Low, max(l_extendedprice) AS Close,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS Volume
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "plan_stale_raw_text": f"""SELECT Universe, pos, Ticker, reason, age_days FROM (
  SELECT Universe, pos, Ticker, age_days, CASE WHEN NOT has_row THEN 'missing' WHEN lu IS NULL THEN 'unparsable' WHEN age_days >= 7 THEN 'stale' END AS reason
  FROM (SELECT u.Universe, u.pos, u.Ticker, f.Ticker IS NOT NULL AS has_row, TRY_CAST(raw AS TIMESTAMP) AS lu,
      CAST(floor(date_diff('microsecond', TRY_CAST(raw AS TIMESTAMP), {o.AS_OF_TS}) / 86400000000.0) AS BIGINT) AS age_days
    FROM ({o.U_USERS}) u LEFT JOIN ({_RAW_TEXT}) f ON u.Universe = f.Universe AND u.Ticker = f.Ticker))
WHERE reason IS NOT NULL""",
    "free_float_nan": f"""SELECT 'customers' AS Universe, 'C' || CAST(c_custkey AS VARCHAR) AS Ticker,
  so AS "Shares Outstanding", fs AS "Float Shares", {o._pct('so', 'fs')} AS "Free Float (%)" FROM ({_NAN_INFO})""",
    "order_in_files": f"""SELECT Universe, CAST(year(Date) AS INTEGER) AS year, count(*) AS n_bars, CAST(0 AS BIGINT) AS out_of_order
FROM ({o._feed_latest(o.BARS_P)}) GROUP BY 1, 2""",
    "sql_last_updated": f"""SELECT Universe, Ticker, "Last Updated" FROM ({_LISTED_FF})""",
    "sql_stored_tickers": f"SELECT Ticker FROM ({_LISTED_FF})",
    "sql_tables": f"SELECT 'free_float' AS name, (SELECT count(*) FROM ({_LISTED_FF})) AS rows",
    "run_summary": f"""WITH out AS ({_SUMMARY_OUT}),
f AS (SELECT Ticker, pos FROM out WHERE outcome = 'failed'),
t AS (SELECT date_diff('microsecond', min(started_at), max(finished_at)) / 1e6 AS s, count(*) AS n FROM out WHERE Status IS NOT NULL)
SELECT 'parts' AS Universe, count(*) FILTER (WHERE outcome = 'success') AS success,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  COALESCE((SELECT string_agg(Ticker, ', ' ORDER BY pos, Ticker) FROM (SELECT * FROM f ORDER BY pos, Ticker LIMIT 10)), '') AS failed_list,
  greatest((SELECT count(*) FROM f) - 10, 0) AS more_failed,
  (SELECT count(*) FROM ({o._feed_latest(o.BARS_P)})) AS table_rows,
  (SELECT count(DISTINCT Ticker) FROM ({o._feed_latest(o.BARS_P)})) AS table_tickers,
  (SELECT floor(s * 1000.0 + 0.5) / 1000.0 FROM t) AS total_seconds,
  (SELECT floor(s / n * 1000.0 + 0.5) / 1000.0 FROM t) AS mean_seconds
FROM out""",
}
