"""DuckDB statements equal to the registered queries of :mod:`tickvault.catalog`.

They run on the pre-registered views of the shared tables and state each
rule directly in SQL (window ``lag`` for gaps, ``row_number`` for newest
wins, ...), independently of the Spark plans, so a match is a real check.
"""

from __future__ import annotations

ONE = "CAST(1 AS DOUBLE)"


def _bars(universe: str, prefix: str, keycol: str, tiecol: str, where: str = "") -> str:
    return f"""SELECT '{universe}' AS Universe, '{prefix}' || CAST({keycol} AS VARCHAR) AS Ticker,
  CAST(l_shipdate AS DATE) AS Date,
  l_extendedprice * ({ONE} - l_discount) AS Open,
  l_extendedprice * ({ONE} + l_tax) AS High,
  l_extendedprice * ({ONE} - l_discount - l_tax) AS Low,
  l_extendedprice AS Close,
  CAST(l_quantity AS BIGINT) AS Volume,
  l_orderkey % 3 AS batch_id,
  l_orderkey * 8 + l_linenumber AS seq,
  {tiecol} AS seq_tie
FROM lineitem {where}"""


BARS_S = _bars("suppliers", "S", "l_suppkey", "l_partkey")
BARS_P = _bars("parts", "P", "l_partkey", "l_suppkey")
BARS_P_STORED = _bars("parts", "P", "l_partkey", "l_suppkey", "WHERE l_linestatus = 'F'")
PRICE_OUT = "Universe, Ticker, Date, Open, High, Low, Close, Volume"

U_PARTS = """SELECT 'parts' AS Universe, p_partkey AS pos, 'P' || CAST(p_partkey AS VARCHAR) AS Ticker FROM part
UNION ALL
SELECT 'parts', p_partkey + 1000000, 'P' || CAST(p_partkey + 1000000 AS VARCHAR) FROM part"""

U_CUST = "SELECT 'customers' AS Universe, c_custkey AS pos, 'C' || CAST(c_custkey AS VARCHAR) AS Ticker FROM customer"
PENDING = "SELECT DISTINCT 'customers' AS Universe, 'C' || CAST(o_custkey AS VARCHAR) AS Ticker FROM orders WHERE o_orderstatus = 'P'"
URGENT = (
    "SELECT DISTINCT 'customers' AS Universe, 'C' || CAST(o_custkey AS VARCHAR) AS Ticker FROM orders "
    "WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"
)

U_USERS = """SELECT 'users' AS Universe, user_id AS pos, 'U' || CAST(user_id AS VARCHAR) AS Ticker FROM (SELECT DISTINCT user_id FROM events)
UNION ALL
SELECT 'users', user_id + 1000000, 'U' || CAST(user_id + 1000000 AS VARCHAR) FROM (SELECT DISTINCT user_id FROM events)"""
FF_SIGNUP = """SELECT 'users' AS Universe, 'U' || CAST(user_id AS VARCHAR) AS Ticker, max(ts) AS lu,
  CASE WHEN user_id % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS Status
FROM events WHERE event_type = 'signup' GROUP BY user_id"""
MARKS_USERS = """SELECT 'users' AS Universe, 'U' || CAST(user_id AS VARCHAR) AS Ticker
FROM (SELECT user_id, arg_min(event_type, ts) AS first_type FROM events GROUP BY user_id) WHERE first_type = 'purchase'"""

AS_OF_TS = "TIMESTAMP '2024-01-31 12:00:00'"


def _gaps(src: str, start: str = "1995-01-01", n: int = 30) -> str:
    return f"""SELECT Universe, Ticker, gap_start, gap_end, date_diff('day', gap_start, gap_end) + 1 AS gap_days FROM (
  SELECT Universe, Ticker, COALESCE(prev + 1, DATE '{start}') AS gap_start, Date - 1 AS gap_end
  FROM (SELECT Universe, Ticker, Date, lag(Date) OVER (PARTITION BY Universe, Ticker ORDER BY Date) AS prev
        FROM ({src}) WHERE Date IS NOT NULL)
  WHERE date_diff('day', COALESCE(prev, DATE '{start}'), Date) > {n})"""


GAPS_P = _gaps(BARS_P)
GAPS_STORED = _gaps(BARS_P_STORED)
BACKFILL_PLAN = f"SELECT Universe, Ticker, 'backfill' AS kind, gap_start AS start_date, gap_end + 1 AS end_date FROM ({GAPS_STORED})"

def _update_plan(src: str) -> str:
    return f"""SELECT Universe, pos, Ticker, kind, last_date,
  CASE WHEN kind = 'update' THEN last_date - 5 ELSE DATE '2000-01-01' END AS start_date,
  DATE '2001-08-01' AS end_date,
  CASE WHEN kind = 'update' THEN 0 ELSE 1 END AS kind_rank
FROM (
  SELECT u.Universe, u.pos, u.Ticker, l.last_date,
    CASE WHEN l.last_date IS NULL THEN 'new' WHEN l.last_date < DATE '2001-08-01' THEN 'update' END AS kind
  FROM ({U_PARTS}) u LEFT JOIN (SELECT Universe, Ticker, max(Date) AS last_date FROM ({src}) GROUP BY Universe, Ticker) l
    ON u.Universe = l.Universe AND u.Ticker = l.Ticker)
WHERE kind IS NOT NULL"""


UPDATE_PLAN = _update_plan(BARS_P)

ERR_TEXT = """CASE event_id % 4 WHEN 0 THEN 'HTTP 429 Too Many Requests' WHEN 1 THEN 'Rate limit exceeded, slow down'
  WHEN 2 THEN '' ELSE 'No quotes for this symbol' END"""


def _attempts(universe: str, prefix: str) -> str:
    return f"""SELECT '{universe}' AS Universe, '{prefix}' || CAST(user_id AS VARCHAR) AS Ticker, user_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS attempt,
  event_type IN ('purchase', 'signup') AS ok,
  CASE WHEN event_type IN ('purchase', 'signup') THEN NULL ELSE {ERR_TEXT} END AS error,
  ts AS started_at,
  ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS finished_at
FROM events"""


def _resolved(universe: str, prefix: str) -> str:
    return f"""WITH a AS ({_attempts(universe, prefix)}),
s AS (SELECT *, min(CASE WHEN ok THEN attempt END) OVER (PARTITION BY Universe, Ticker) AS ok_at FROM a WHERE attempt < 3),
sp AS (SELECT * FROM s WHERE ok_at IS NULL OR attempt <= ok_at),
le AS (SELECT Universe, Ticker, error AS last_error FROM (
        SELECT *, row_number() OVER (PARTITION BY Universe, Ticker ORDER BY attempt DESC) AS rn FROM sp WHERE NOT ok) WHERE rn = 1)
SELECT sp.Universe, sp.Ticker, min(sp.user_id) AS user_id,
  CASE WHEN min(ok_at) IS NOT NULL THEN 'SUCCESS' ELSE 'FAILED' END AS Status,
  CASE WHEN min(ok_at) IS NULL THEN COALESCE(NULLIF(substr(max(le.last_error), 1, 500), ''), 'Unknown error') END AS Error,
  count(*) AS tries,
  count(*) FILTER (WHERE NOT ok AND regexp_matches(lower(error), 'rate|too many|429')) AS rate_limited,
  min(started_at) AS started_at, max(finished_at) AS finished_at
FROM sp LEFT JOIN le ON sp.Universe = le.Universe AND sp.Ticker = le.Ticker
GROUP BY sp.Universe, sp.Ticker"""


INFO = """SELECT c_custkey, c_acctbal AS so,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 OR c_custkey % 97 = 0 THEN CAST(0 AS DOUBLE)
       ELSE c_acctbal * (c_custkey % 97) / CAST(101 AS DOUBLE) END AS fs
FROM customer"""


def _pct(so: str, fs: str) -> str:
    raw = f"CASE WHEN {so} > 0 AND {fs} IS NOT NULL AND {fs} <> 0 THEN {fs} / {so} * CAST(100 AS DOUBLE) END"
    return f"CASE WHEN ({raw}) <> 0 THEN floor(({raw}) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) END"


FREE_FLOAT = f"""SELECT 'customers' AS Universe, 'C' || CAST(c_custkey AS VARCHAR) AS Ticker,
  so AS "Shares Outstanding", fs AS "Float Shares", {_pct('so', 'fs')} AS "Free Float (%)"
FROM ({INFO})"""


def _ff_rows(universe: str, prefix: str) -> str:
    return f"""SELECT r.Universe, r.Ticker,
  CASE WHEN r.Status = 'SUCCESS' THEN i.so END AS "Shares Outstanding",
  CASE WHEN r.Status = 'SUCCESS' THEN i.fs END AS "Float Shares",
  CASE WHEN r.Status = 'SUCCESS' THEN {_pct('i.so', 'i.fs')} END AS "Free Float (%)",
  r.Status, r.Error, {AS_OF_TS} AS "Last Updated"
FROM ({_resolved(universe, prefix)}) r LEFT JOIN ({INFO}) i ON i.c_custkey = r.user_id"""


CURRENT_FF = f"""SELECT Universe, Ticker, "Shares Outstanding", "Float Shares", "Free Float (%)", 'SUCCESS' AS Status,
  CAST(NULL AS VARCHAR) AS Error, TIMESTAMP '2024-01-01 00:00:00' AS "Last Updated" FROM ({FREE_FLOAT})"""

FF_COLS = 'Universe, Ticker, "Shares Outstanding", "Float Shares", "Free Float (%)", Status, Error, "Last Updated"'


def _stale(marks: bool, retry_failed: bool) -> str:
    mark_filter = f"WHERE (u.Universe, u.Ticker) NOT IN (SELECT (Universe, Ticker) FROM ({MARKS_USERS}))" if marks else ""
    failed = "WHEN Status = 'FAILED' THEN 'failed'" if retry_failed else ""
    return f"""SELECT Universe, pos, Ticker, reason, age_days FROM (
  SELECT Universe, pos, Ticker, age_days,
    CASE WHEN NOT has_row THEN 'missing' WHEN lu IS NULL THEN 'unparsable' {failed}
         WHEN age_days >= 7 THEN 'stale' END AS reason
  FROM (
    SELECT u.Universe, u.pos, u.Ticker, f.lu, f.Status, f.Ticker IS NOT NULL AS has_row,
      CAST(floor(date_diff('microsecond', f.lu, {AS_OF_TS}) / 86400000000.0) AS BIGINT) AS age_days
    FROM ({U_USERS}) u LEFT JOIN ({FF_SIGNUP}) f ON u.Universe = f.Universe AND u.Ticker = f.Ticker
    {mark_filter}))
WHERE reason IS NOT NULL"""


FILLS = f"""SELECT b.*, p.start_date FROM ({BARS_P}) b JOIN ({BACKFILL_PLAN}) p
  ON b.Universe = p.Universe AND b.Ticker = p.Ticker AND b.Date >= p.start_date AND b.Date < p.end_date"""
UPDATE_FETCH = f"""SELECT b.*, p.kind FROM ({BARS_P}) b JOIN ({UPDATE_PLAN}) p
  ON b.Universe = p.Universe AND b.Ticker = p.Ticker AND b.Date >= p.start_date AND b.Date < p.end_date"""

UPDATE_OUTCOME = f"""SELECT p.Universe, p.Ticker, p.kind,
  CAST(CASE WHEN r.Status = 'FAILED' THEN 0 ELSE COALESCE(f.n, 0) END AS BIGINT) AS rows_fetched,
  CASE WHEN r.Status = 'FAILED' THEN 'failed' WHEN COALESCE(f.n, 0) > 0 THEN 'success' ELSE 'skipped' END AS outcome
FROM ({UPDATE_PLAN}) p
LEFT JOIN (SELECT Universe, Ticker, count(*) AS n FROM ({UPDATE_FETCH}) GROUP BY Universe, Ticker) f
  ON p.Universe = f.Universe AND p.Ticker = f.Ticker
LEFT JOIN ({_resolved('parts', 'P')}) r ON p.Universe = r.Universe AND p.Ticker = r.Ticker"""


def _latest(src: str, cols: str = PRICE_OUT) -> str:
    return f"""SELECT {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY Universe, Ticker, Date ORDER BY batch_id DESC, seq DESC, seq_tie DESC) AS rn
  FROM ({src})) WHERE rn = 1"""


def _feed_latest(src: str) -> str:
    """Newest row per bar key in the feed's own order (seq, then the tie)."""
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY Universe, Ticker, Date ORDER BY seq * 1000000 + seq_tie DESC) AS rn
  FROM ({src})) WHERE rn = 1"""


JOB_STORED = _feed_latest(BARS_P_STORED)
JOB_GAP_PLAN = f"""SELECT Universe, Ticker, gap_start AS start_date, gap_end + 1 AS end_date FROM ({_gaps(JOB_STORED)})"""
JOB_FILLS = _feed_latest(
    f"""SELECT b.* FROM ({BARS_P}) b JOIN ({JOB_GAP_PLAN}) p
  ON b.Universe = p.Universe AND b.Ticker = p.Ticker AND b.Date >= p.start_date AND b.Date < p.end_date"""
)

JOB_UPDATED = _feed_latest(
    f"""SELECT b.* FROM ({BARS_P}) b JOIN (
    SELECT u.Universe, u.Ticker, COALESCE(l.last_date - 5, DATE '1995-01-01') AS start_date
    FROM ({U_PARTS}) u LEFT JOIN (SELECT Universe, Ticker, max(Date) AS last_date FROM ({JOB_STORED}) GROUP BY ALL) l
      ON u.Universe = l.Universe AND u.Ticker = l.Ticker
    WHERE l.last_date IS NULL OR l.last_date < DATE '2002-01-01') p
  ON b.Universe = p.Universe AND b.Ticker = p.Ticker AND b.Date >= p.start_date AND b.Date < DATE '2002-01-01'"""
)

BACKFILL_OUTCOME = f"""SELECT p.Universe, p.Ticker, p.start_date, p.end_date,
  CAST(CASE WHEN r.Status = 'FAILED' THEN 0 ELSE COALESCE(f.n, 0) END AS BIGINT) AS rows_fetched,
  CASE WHEN r.Status = 'FAILED' THEN 'failed' WHEN COALESCE(f.n, 0) > 0 THEN 'filled' ELSE 'empty' END AS outcome
FROM ({BACKFILL_PLAN}) p LEFT JOIN (SELECT Universe, Ticker, start_date, count(*) AS n FROM ({FILLS}) GROUP BY ALL) f
  ON p.Universe = f.Universe AND p.Ticker = f.Ticker AND p.start_date = f.start_date
LEFT JOIN ({_resolved('parts', 'P')}) r ON p.Universe = r.Universe AND p.Ticker = r.Ticker"""


def _work_counts(universe: str, plan: str) -> str:
    return f"""SELECT u.Universe, count(*) AS total, count(p.Ticker) AS due, count(*) - count(p.Ticker) AS done
FROM ({universe}) u
LEFT JOIN (SELECT DISTINCT Universe, Ticker FROM ({plan})) p ON p.Universe = u.Universe AND p.Ticker = u.Ticker
GROUP BY u.Universe"""


FAILED_USERS = f"""SELECT r.Ticker, u.pos FROM ({_resolved('users', 'U')}) r JOIN ({U_USERS}) u
  ON r.Universe = u.Universe AND r.Ticker = u.Ticker WHERE r.Status = 'FAILED'"""

SQL: dict[str, str] = {
    "keep_last": _latest(BARS_S),
    "gaps_all": GAPS_P,
    "gaps_with_empty": f"""{GAPS_P}
UNION ALL
SELECT u.Universe, u.Ticker, DATE '1995-01-01', DATE '2001-08-01', date_diff('day', DATE '1995-01-01', DATE '2001-08-01') + 1
FROM ({U_PARTS}) u WHERE NOT EXISTS (SELECT 1 FROM ({BARS_P}) b WHERE b.Universe = u.Universe AND b.Ticker = u.Ticker)""",
    "gaps_clipped": f"""SELECT Universe, Ticker, greatest(gap_start, DATE '1998-01-01') AS gap_start, gap_end,
  date_diff('day', greatest(gap_start, DATE '1998-01-01'), gap_end) + 1 AS gap_days
FROM ({_gaps(BARS_P, start='1998-01-01')}) WHERE gap_end >= DATE '1998-01-01'""",
    "gaps_summary": f"""SELECT (SELECT count(*) FROM ({U_PARTS})) AS tickers_scanned,
  count(DISTINCT (Universe, Ticker)) AS tickers_with_gaps, count(*) AS total_gaps FROM ({GAPS_P})""",
    "gaps_sample": f"""WITH g AS ({GAPS_P}),
per AS (SELECT Universe, Ticker, count(*) AS gaps_of_ticker FROM g GROUP BY Universe, Ticker),
pos AS (SELECT Universe, Ticker, min(pos) AS pos FROM ({U_PARTS}) GROUP BY Universe, Ticker),
fr AS (SELECT *, row_number() OVER (ORDER BY pos, Ticker) AS ticker_rank FROM (
        SELECT per.*, pos.pos FROM per JOIN pos ON per.Universe = pos.Universe AND per.Ticker = pos.Ticker
        ORDER BY pos.pos, per.Ticker LIMIT 5)),
s AS (SELECT g.*, fr.ticker_rank, fr.gaps_of_ticker,
        row_number() OVER (PARTITION BY g.Universe, g.Ticker ORDER BY g.gap_start) AS gap_rank
      FROM g JOIN fr ON g.Universe = fr.Universe AND g.Ticker = fr.Ticker)
SELECT ticker_rank, Universe, Ticker, gap_rank, gap_start, gap_end, date_diff('day', gap_start, gap_end) AS length_days,
  gaps_of_ticker, greatest(gaps_of_ticker - 3, 0) AS more_gaps
FROM s WHERE gap_rank <= 3""",
    "table_stats": f"""SELECT Universe, count(*) AS rows, count(DISTINCT Ticker) AS tickers, min(Date) AS first_date,
  max(Date) AS last_date FROM ({_latest(BARS_S)}) GROUP BY Universe""",
    "job_fresh_load": f"SELECT {PRICE_OUT} FROM ({_feed_latest(BARS_P)})",
    "job_update": f"""SELECT {PRICE_OUT} FROM ({JOB_STORED}) s
WHERE NOT EXISTS (SELECT 1 FROM ({JOB_UPDATED}) f WHERE f.Universe = s.Universe AND f.Ticker = s.Ticker AND f.Date = s.Date)
UNION ALL SELECT {PRICE_OUT} FROM ({JOB_UPDATED})""",
    "job_free_float": f"""SELECT {FF_COLS} FROM ({_ff_rows('customers', 'C')}) r
WHERE EXISTS (SELECT 1 FROM ({U_CUST}) u WHERE u.Ticker = r.Ticker)""",
    "job_backfill": f"""SELECT {PRICE_OUT} FROM ({JOB_STORED}) s
WHERE NOT EXISTS (SELECT 1 FROM ({JOB_FILLS}) f WHERE f.Universe = s.Universe AND f.Ticker = s.Ticker AND f.Date = s.Date)
UNION ALL SELECT {PRICE_OUT} FROM ({JOB_FILLS})""",
    "first_last_dates": f"""SELECT Universe, Ticker, min(Date) AS first_date, max(Date) AS last_date, count(DISTINCT Date) AS n_bars
FROM ({BARS_P}) GROUP BY Universe, Ticker""",
    "plan_fresh": f"""SELECT u.*, 'fresh' AS kind, DATE '2000-01-01' AS start_date, DATE '2001-08-01' AS end_date
FROM ({U_CUST}) u WHERE NOT EXISTS (SELECT 1 FROM ({PENDING}) s WHERE s.Universe = u.Universe AND s.Ticker = u.Ticker)""",
    "resume_progress": f"""WITH u AS (SELECT c_mktsegment AS Universe, c_custkey AS pos, 'C' || CAST(c_custkey AS VARCHAR) AS Ticker FROM customer),
s AS (SELECT DISTINCT c.c_mktsegment AS Universe, 'C' || CAST(o.o_custkey AS VARCHAR) AS Ticker
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P'),
p AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.Universe = u.Universe AND s.Ticker = u.Ticker)),
d AS (SELECT Universe, count(*) AS done_before FROM s GROUP BY Universe),
t AS (SELECT Universe, count(*) AS universe_total FROM u GROUP BY Universe),
q AS (SELECT p.Universe, p.Ticker, row_number() OVER (PARTITION BY p.Universe ORDER BY p.pos) AS position FROM p)
SELECT q.Universe, q.Ticker, q.position, COALESCE(d.done_before, 0) + q.position AS run_position, t.universe_total,
  floor((COALESCE(d.done_before, 0) + q.position) * CAST(100 AS DOUBLE) / t.universe_total * CAST(10 AS DOUBLE)
        + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS pct_done
FROM q JOIN t ON q.Universe = t.Universe LEFT JOIN d ON q.Universe = d.Universe""",
    "plan_resume": f"""SELECT u.*, 'resume' AS kind FROM ({U_CUST}) u
WHERE NOT EXISTS (SELECT 1 FROM ({PENDING} UNION {URGENT}) s WHERE s.Universe = u.Universe AND s.Ticker = u.Ticker)""",
    "plan_stale": _stale(marks=True, retry_failed=False),
    "plan_stale_ignore_marks": _stale(marks=False, retry_failed=False),
    "plan_stale_retry_failed": _stale(marks=True, retry_failed=True),
    "plan_force_all": f"SELECT Universe, pos, Ticker, 'forced' AS reason, CAST(NULL AS BIGINT) AS age_days FROM ({U_USERS})",
    "plan_update": f"SELECT Universe, Ticker, kind, last_date, start_date, end_date, kind_rank FROM ({UPDATE_PLAN})",
    "plan_backfill": BACKFILL_PLAN,
    "apply_backfill_windows": f"SELECT {PRICE_OUT}, batch_id, seq, seq_tie, start_date FROM ({FILLS})",
    "apply_update_windows": f"SELECT {PRICE_OUT}, batch_id, seq, seq_tie, kind FROM ({UPDATE_FETCH})",
    "fill_outcome": f"""SELECT p.Universe, p.Ticker, p.start_date, p.end_date, COALESCE(f.n, 0) AS rows_fetched,
  CASE WHEN COALESCE(f.n, 0) > 0 THEN 'filled' ELSE 'empty' END AS outcome
FROM ({BACKFILL_PLAN}) p LEFT JOIN (SELECT Universe, Ticker, start_date, count(*) AS n FROM ({FILLS}) GROUP BY ALL) f
  ON p.Universe = f.Universe AND p.Ticker = f.Ticker AND p.start_date = f.start_date""",
    "backfill_merge": _latest(
        f"""SELECT Universe, Ticker, Date, Open, High, Low, Close, Volume, batch_id - 10 AS batch_id, seq, seq_tie FROM ({BARS_P_STORED})
UNION ALL SELECT Universe, Ticker, Date, Open, High, Low, Close, Volume, batch_id, seq, seq_tie FROM ({FILLS})"""
    ),
    "update_merge": _latest(
        f"""SELECT Universe, Ticker, Date, Open, High, Low, Close, Volume, batch_id, seq, seq_tie FROM ({BARS_P_STORED})
UNION ALL SELECT Universe, Ticker, Date, Open, High, Low, Close, Volume, batch_id + 10, seq, seq_tie FROM (
  SELECT b.* FROM ({BARS_P}) b JOIN ({_update_plan(BARS_P_STORED)}) p
    ON b.Universe = p.Universe AND b.Ticker = p.Ticker AND b.Date >= p.start_date AND b.Date < p.end_date)"""
    ),
    "plan_counts": f"""SELECT u.Universe, u.total, COALESCE(p.to_update, 0) AS to_update, COALESCE(p.new, 0) AS new,
  u.total - COALESCE(p.to_update, 0) - COALESCE(p.new, 0) AS current
FROM (SELECT Universe, count(*) AS total FROM ({U_PARTS}) GROUP BY Universe) u
LEFT JOIN (SELECT Universe, count(*) FILTER (WHERE kind = 'update') AS to_update, count(*) FILTER (WHERE kind = 'new') AS new
           FROM ({UPDATE_PLAN}) GROUP BY Universe) p ON u.Universe = p.Universe""",
    "update_outcome": UPDATE_OUTCOME,
    "update_outcome_totals": f"""SELECT Universe, count(*) FILTER (WHERE outcome = 'success') AS success,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  CAST(sum(rows_fetched) AS BIGINT) AS rows_fetched FROM ({UPDATE_OUTCOME}) GROUP BY Universe""",
    "work_batches": f"""SELECT Universe, Ticker, kind, position, total,
  floor(position * CAST(100 AS DOUBLE) / total * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS pct_done,
  CAST(floor((position - 1) / 10) AS BIGINT) AS batch
FROM (SELECT *, row_number() OVER (PARTITION BY Universe ORDER BY kind_rank * 1099511627776 + pos) AS position,
        count(*) OVER (PARTITION BY Universe) AS total FROM ({UPDATE_PLAN}))""",
    "free_float": FREE_FLOAT,
    "free_float_v1_status": f"""SELECT Universe, count(*) FILTER (WHERE "Free Float (%)" IS NOT NULL) AS success,
  count(*) FILTER (WHERE "Free Float (%)" IS NULL) AS failed, count(*) AS total FROM ({FREE_FLOAT}) GROUP BY Universe""",
    "attempts_classified": f"""SELECT Universe, Ticker, attempt, ok, rate_limited, retry_wait_min_s, retry_wait_max_s,
  finished_at + to_seconds(retry_wait_min_s) AS not_before
FROM (SELECT *, NOT ok AND COALESCE(regexp_matches(lower(error), 'rate|too many|429'), false) AS rate_limited,
  CAST(CASE WHEN ok THEN 0 WHEN COALESCE(regexp_matches(lower(error), 'rate|too many|429'), false) THEN (attempt + 1) * 30
       WHEN attempt >= 2 THEN 0 ELSE 3 END AS BIGINT) AS retry_wait_min_s,
  CAST(CASE WHEN ok THEN 0 WHEN COALESCE(regexp_matches(lower(error), 'rate|too many|429'), false) THEN (attempt + 1) * 30
       WHEN attempt >= 2 THEN 0 ELSE 7 END AS BIGINT) AS retry_wait_max_s
  FROM ({_attempts('users', 'U')}))""",
    "attempts_resolved": f"SELECT Universe, Ticker, Status, Error, tries, rate_limited FROM ({_resolved('users', 'U')})",
    "free_float_rows": _ff_rows("customers", "C"),
    "upsert_replace": f"""SELECT {FF_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY Universe, Ticker ORDER BY b DESC) AS rn FROM (
    SELECT *, -1 AS b FROM ({CURRENT_FF}) UNION ALL SELECT *, 0 AS b FROM ({_ff_rows('customers', 'C')})))
WHERE rn = 1""",
    "upsert_keep_last_good": f"""WITH cur AS ({CURRENT_FF}), inc AS ({_ff_rows('customers', 'C')})
SELECT c.Universe, c.Ticker,
  CASE WHEN i.Ticker IS NULL THEN c."Shares Outstanding" WHEN i.Status = 'FAILED' THEN c."Shares Outstanding" ELSE i."Shares Outstanding" END AS "Shares Outstanding",
  CASE WHEN i.Ticker IS NULL THEN c."Float Shares" WHEN i.Status = 'FAILED' THEN c."Float Shares" ELSE i."Float Shares" END AS "Float Shares",
  CASE WHEN i.Ticker IS NULL THEN c."Free Float (%)" WHEN i.Status = 'FAILED' THEN c."Free Float (%)" ELSE i."Free Float (%)" END AS "Free Float (%)",
  COALESCE(i.Status, c.Status) AS Status,
  CASE WHEN i.Ticker IS NULL THEN c.Error ELSE i.Error END AS Error,
  CASE WHEN i.Ticker IS NULL THEN c."Last Updated" ELSE i."Last Updated" END AS "Last Updated"
FROM cur c LEFT JOIN inc i ON c.Universe = i.Universe AND c.Ticker = i.Ticker""",
    "free_float_versions": f"""SELECT Universe, Ticker, "Shares Outstanding", "Float Shares", "Free Float (%)",
  CAST(NULL AS VARCHAR) AS Status, CAST(NULL AS VARCHAR) AS Error, TIMESTAMP '2023-12-01 00:00:00' AS "Last Updated"
FROM ({FREE_FLOAT})
UNION ALL SELECT {FF_COLS} FROM ({_ff_rows('users', 'U')})""",
    "failure_sample": f"""WITH f AS (SELECT r.*, u.pos FROM ({_resolved('users', 'U')}) r JOIN ({U_USERS}) u
             ON r.Universe = u.Universe AND r.Ticker = u.Ticker WHERE r.Status = 'FAILED')
SELECT row_number() OVER (ORDER BY pos, Ticker) AS rank, Universe, Ticker, substr(Error, 1, 100) AS error_head,
  greatest((SELECT count(*) FROM f) - 10, 0) AS more_failed
FROM (SELECT * FROM f ORDER BY pos, Ticker LIMIT 10)""",
    "run_timing": f"""WITH r AS ({_resolved('users', 'U')}), d AS ({_stale(marks=True, retry_failed=False)}),
a AS (SELECT count(*) AS done, min(started_at) AS t0, max(finished_at) AS t1 FROM r),
l AS (SELECT count(*) AS remaining FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.Universe = d.Universe AND r.Ticker = d.Ticker))
SELECT done,
  floor(date_diff('microsecond', t0, t1) / 1e6 * 1000.0 + 0.5) / 1000.0 AS total_seconds,
  floor(date_diff('microsecond', t0, t1) / 1e6 / done * 1000.0 + 0.5) / 1000.0 AS mean_seconds,
  remaining,
  floor(date_diff('microsecond', t0, t1) / 1e6 / done * remaining * 1000.0 + 0.5) / 1000.0 AS eta_seconds
FROM a, l""",
    "universe_lists": """SELECT c_mktsegment AS Universe,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS pos,
  'C' || CAST(c_custkey AS VARCHAR) AS Ticker
FROM customer""",
    "universe_listing": "SELECT DISTINCT c_mktsegment AS Universe FROM customer",
    "prefer_primary": """WITH p AS (SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS Universe, CAST(n_nationkey AS BIGINT) AS pos, n_name AS Ticker,
              'primary' AS source FROM nation WHERE n_regionkey IN (0, 1, 2)),
f AS (SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS Universe, CAST(n_nationkey AS BIGINT) AS pos, n_name AS Ticker,
              'fallback' AS source FROM nation WHERE n_regionkey IN (2, 3, 4))
SELECT * FROM p UNION ALL SELECT * FROM f WHERE Universe NOT IN (SELECT Universe FROM p)""",
    "normalized_quotes": f"""SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS Ticker,
  CAST(timezone(CASE n_regionkey WHEN 0 THEN 'Asia/Jakarta' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Europe/London'
                     WHEN 3 THEN 'Asia/Tokyo' ELSE 'UTC' END,
                (l_shipdate + INTERVAL 17 HOUR) AT TIME ZONE 'UTC') AS DATE) AS Date,
  l_extendedprice * ({ONE} - l_discount) AS Open,
  l_extendedprice * ({ONE} + l_tax) AS High,
  l_extendedprice * ({ONE} - l_discount - l_tax) AS Low,
  l_extendedprice AS Close, CAST(l_quantity AS BIGINT) AS Volume
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "backfill_outcome": BACKFILL_OUTCOME,
    "backfill_outcome_totals": f"""SELECT Universe, count(*) FILTER (WHERE outcome = 'filled') AS filled,
  count(*) FILTER (WHERE outcome = 'empty') AS empty, count(*) FILTER (WHERE outcome = 'failed') AS failed,
  CAST(sum(rows_fetched) AS BIGINT) AS rows_fetched FROM ({BACKFILL_OUTCOME}) GROUP BY Universe""",
    "failed_gaps": f"""WITH f AS (SELECT * FROM ({BACKFILL_OUTCOME}) WHERE outcome = 'failed')
SELECT row_number() OVER (ORDER BY Universe, Ticker, start_date) AS rank,
  Ticker || ' [' || CAST(start_date AS VARCHAR) || '->' || CAST(end_date - 1 AS VARCHAR) || ']' AS gap,
  greatest((SELECT count(*) FROM f) - 10, 0) AS more_failed
FROM (SELECT * FROM f ORDER BY Universe, Ticker, start_date LIMIT 10)""",
    "update_outcome_dups": f"{UPDATE_OUTCOME} UNION ALL {UPDATE_OUTCOME}",
    "attempts_two_runs": _ff_rows("customers", "C"),
    "failed_list": f"""WITH f AS ({FAILED_USERS})
SELECT COALESCE((SELECT string_agg(Ticker, ', ' ORDER BY pos, Ticker) FROM (SELECT * FROM f ORDER BY pos, Ticker LIMIT 10)), '') AS failed_list,
  CASE WHEN count(*) > 10 THEN '... and ' || CAST(count(*) - 10 AS VARCHAR) || ' more' END AS more, count(*) AS failed
FROM f""",
}

SQL["plan_counts_fresh"] = _work_counts(U_CUST, SQL["plan_fresh"])
SQL["plan_counts_stale"] = _work_counts(U_USERS, SQL["plan_stale"])
SQL["normalized_instants"] = SQL["normalized_quotes"]
