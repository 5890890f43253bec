"""Free-float job operators.

Attempts are data: one row per try ``(Universe, Ticker, attempt, ok, payload,
error, started_at, finished_at)``. Resolving them is one grouped aggregation
with partial (map-side) aggregation, so a ticker with very many tries still
becomes one small buffer per map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.functions.freefloat import free_float_pct
from tickvault.functions.scalar import is_rate_limited, lit_ts, nan_to_null
from tickvault.operators.merge import resolve_latest
from tickvault.schemas import (
    COMPANY_INFO,
    DEFAULT_MAX_RETRY,
    ERROR_MAX_CHARS,
    FF_FLOAT,
    FF_PCT,
    FF_SHARES,
    FF_UPDATED,
    STATUS_FAILED,
    STATUS_SUCCESS,
    UNKNOWN_ERROR,
)

KEYS = ("Universe", "Ticker")

# Fixed values of the retry schedule (seconds).
RATE_LIMIT_WAIT_STEP_S = 30
OTHER_WAIT_MIN_S = 3
OTHER_WAIT_MAX_S = 7


def company_info_from_json(payload) -> Column:
    """Keyed lookup with missing -> NULL (absent JSON fields are NULL)."""
    c = F.col(payload) if isinstance(payload, str) else payload
    return F.from_json(c, COMPANY_INFO)


def with_free_float(df: DataFrame, shares: str = "sharesOutstanding", float_shares: str = "floatShares") -> DataFrame:
    """Add the three numeric free-float columns (NaN stored as NULL)."""
    return df.select(
        *[c for c in df.columns if c not in (shares, float_shares)],
        nan_to_null(F.col(shares)).alias(FF_SHARES),
        nan_to_null(F.col(float_shares)).alias(FF_FLOAT),
        free_float_pct(F.col(shares), F.col(float_shares)).alias(FF_PCT),
    )


def success_status(pct: Column, rule: str = "call") -> Column:
    """``call`` = the call succeeded (v2/v3); ``value`` = pct present (v1)."""
    if rule == "value":
        return F.when(pct.isNotNull(), F.lit(STATUS_SUCCESS)).otherwise(F.lit(STATUS_FAILED))
    if rule == "call":
        return F.lit(STATUS_SUCCESS)
    raise ValueError("rule must be 'call' or 'value'")


def classify_errors(attempts: DataFrame, max_retry: int = DEFAULT_MAX_RETRY) -> DataFrame:
    """Rate-limit class and the wait a scheduler must keep after a try.

    Rate limited: wait ``(attempt + 1) * 30`` s, also after the last try.
    Other errors: 3-7 s, none after the last try. Good tries: no wait.
    ``not_before`` = ``finished_at`` + the minimum wait.
    """
    rl = is_rate_limited(F.col("error"))
    last = F.col("attempt") >= F.lit(int(max_retry) - 1)
    wait_min = (
        F.when(F.col("ok"), F.lit(0))
        .when(rl, (F.col("attempt") + 1) * RATE_LIMIT_WAIT_STEP_S)
        .when(last, F.lit(0))
        .otherwise(F.lit(OTHER_WAIT_MIN_S))
    )
    wait_max = (
        F.when(F.col("ok"), F.lit(0))
        .when(rl, (F.col("attempt") + 1) * RATE_LIMIT_WAIT_STEP_S)
        .when(last, F.lit(0))
        .otherwise(F.lit(OTHER_WAIT_MAX_S))
    )
    return (
        attempts.withColumn("rate_limited", (~F.col("ok")) & rl)
        .withColumn("retry_wait_min_s", wait_min.cast(T.LongType()))
        .withColumn("retry_wait_max_s", wait_max.cast(T.LongType()))
        .withColumn("not_before", F.col("finished_at") + F.make_dt_interval(secs=F.col("retry_wait_min_s")))
    )


def resolve_attempts(
    attempts: DataFrame, max_retry: int = DEFAULT_MAX_RETRY, keys: Sequence[str] = KEYS, run_id: str | None = None
) -> DataFrame:
    """C7 (+C4): first success among the first ``max_retry`` tries, else the
    *last* error cut to 500 characters (``Unknown error`` when empty).

    Tries of several runs may share a table with a ``run_id`` column: then
    ``run_id`` names the run to resolve (another run's failures must not spend
    this run's tries). Of tries with the same number a good one counts.

    Output per key: ``Status``, ``Error``, ``payload`` (of the good try),
    ``tries`` (tries spent), ``rate_limited`` (count), ``started_at``,
    ``finished_at`` (of the tries spent).
    """
    keys = list(keys)
    if "run_id" in attempts.columns:
        if run_id is None:
            raise ValueError("the tries carry run_id: name the run to resolve")
        attempts = attempts.filter(F.col("run_id") == F.lit(run_id))
    a = attempts.filter(F.col("attempt") < F.lit(int(max_retry)))
    ok_att = F.when(F.col("ok"), F.col("attempt"))
    # after the filter a key has at most max_retry rows, so every window
    # group is bounded; both windows share one shuffle by key
    whole = Window.partitionBy(*keys)
    spent = a.withColumn("__ok_at", F.min(ok_att).over(whole)).filter(
        F.col("__ok_at").isNull() | (F.col("attempt") <= F.col("__ok_at"))
    )
    # the last try spent is the good one (SUCCESS) or the last failure (FAILED)
    last_first = Window.partitionBy(*keys).orderBy(F.col("attempt").desc(), F.col("ok").desc(), F.col("finished_at").desc())
    rl = (~F.col("ok")) & is_rate_limited(F.col("error"))
    r = (
        spent.withColumn("__rn", F.row_number().over(last_first))
        .withColumn("tries", F.count(F.lit(1)).over(whole))
        .withColumn("rate_limited", F.sum(rl.cast(T.LongType())).over(whole))
        .withColumn("__t0", F.min("started_at").over(whole))
        .withColumn("__t1", F.max("finished_at").over(whole))
        .filter(F.col("__rn") == 1)
    )
    success = F.col("__ok_at").isNotNull()
    err = F.substring(F.col("error"), 1, ERROR_MAX_CHARS)
    return r.select(
        *keys,
        F.when(success, F.lit(STATUS_SUCCESS)).otherwise(F.lit(STATUS_FAILED)).alias("Status"),
        F.when(~success, F.coalesce(F.nullif(err, F.lit("")), F.lit(UNKNOWN_ERROR))).alias("Error"),
        F.when(success, F.col("payload")).alias("payload"),
        F.col("tries").cast(T.LongType()).alias("tries"),
        F.col("rate_limited").cast(T.LongType()).alias("rate_limited"),
        F.col("__t0").alias("started_at"),
        F.col("__t1").alias("finished_at"),
    )


def results_to_rows(resolved: DataFrame, as_of=None, success_rule: str = "call", keys: Sequence[str] = KEYS) -> DataFrame:
    """Resolved attempts -> free_float rows (7 columns + Universe).

    A FAILED ticker gets NULL numbers; ``Last Updated`` is ``as_of`` (the
    run's clock, never ``current_timestamp()`` in tests) or ``finished_at``.
    """
    keys = list(keys)
    info = company_info_from_json(F.col("payload"))
    so = F.when(F.col("Status") == STATUS_SUCCESS, info["sharesOutstanding"])
    fs = F.when(F.col("Status") == STATUS_SUCCESS, info["floatShares"])
    pct = free_float_pct(so, fs)
    status = F.when(F.col("Status") == STATUS_FAILED, F.lit(STATUS_FAILED)).otherwise(success_status(pct, success_rule))
    stamp = lit_ts(as_of) if as_of is not None else F.col("finished_at")
    return resolved.select(
        *keys,
        nan_to_null(so).alias(FF_SHARES),
        nan_to_null(fs).alias(FF_FLOAT),
        pct.alias(FF_PCT),
        status.alias("Status"),
        F.col("Error"),
        stamp.cast(T.TimestampNTZType()).alias(FF_UPDATED),
    )


def upsert_free_float(
    current: DataFrame,
    incoming: DataFrame,
    on_failure: str = "replace",
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("batch_id", "seq"),
) -> DataFrame:
    """K2: ``INSERT OR REPLACE`` on the key, newest row wins.

    ``current`` is the stored table (one row per key, placed first);
    ``incoming`` carries its write order in ``order`` columns (or gets batch
    0). ``on_failure="replace"`` is the reference: a FAILED row blanks earlier
    good numbers; ``"keep_last_good"`` keeps the numbers of the newest SUCCESS
    row. Only incoming rows are windowed; stored rows pass an anti join, and
    the good-number lookup touches only keys whose newest try failed.
    """
    keys = list(keys)
    if on_failure not in ("replace", "keep_last_good"):
        raise ValueError("on_failure must be 'replace' or 'keep_last_good'")
    inc = incoming
    for c in order:
        if c not in inc.columns:
            inc = inc.withColumn(c, F.lit(0).cast(T.LongType()))
    cols = list(current.columns)
    new = resolve_latest(inc, keys, order)
    new_keys = new.select(*[F.col(k).alias("__k_" + k) for k in keys])
    kept = current.join(new_keys, [current[k].eqNullSafe(new_keys["__k_" + k]) for k in keys], "left_anti")
    if on_failure == "replace":
        return kept.unionByName(new.select(*cols), allowMissingColumns=True)

    nums = [FF_SHARES, FF_FLOAT, FF_PCT]
    failed_keys = new.filter(F.col("Status") == STATUS_FAILED).select(*keys)
    cur = current
    for c in order:
        cur = cur.withColumn(c, F.lit(-1).cast(T.LongType()))
    cand = (
        cur.join(failed_keys, keys, "left_semi")
        .unionByName(inc.join(failed_keys, keys, "left_semi"), allowMissingColumns=True)
        .filter(F.col("Status").isNull() | (F.col("Status") == STATUS_SUCCESS))
    )
    good = resolve_latest(cand.select(*keys, *nums, *order), keys, order).select(
        *keys, *[F.col(c).alias("__g_" + c) for c in nums], F.lit(True).alias("__has_good")
    )
    failed = F.col("Status") == STATUS_FAILED
    fixed = new.join(good, keys, "left").select(
        *[
            F.when(failed & F.col("__has_good").isNotNull(), F.col("__g_" + c)).otherwise(F.col(c)).alias(c)
            if c in nums
            else F.col(c)
            for c in cols
        ]
    )
    return kept.unionByName(fixed)


def run_outcome(resolved_rows: DataFrame, keys: Sequence[str] = ("Universe",)) -> DataFrame:
    """A5: success / failed counts per universe."""
    return resolved_rows.groupBy(*keys).agg(
        F.count_if(F.col("Status") == STATUS_SUCCESS).alias("success"),
        F.count_if(F.col("Status") == STATUS_FAILED).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )
