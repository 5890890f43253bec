"""Newest-write-wins merge (W1, U1, T3) shared by the bar and free-float tables.

DataFrames carry no row order, so the write order is a real column pair
``(batch_id, seq)``: stored rows first (lowest batch), then landed batches in
arrival order. ``row_number`` over the key with ``= 1`` is planned by Catalyst
with a *partial* ``WindowGroupLimit`` before the exchange, so a key that holds
a third of the log is cut to one row per map task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ORDER = ("batch_id", "seq")
_RN = "__rn"


def resolve_latest(
    log: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = DEFAULT_ORDER,
    keep_order_columns: bool = False,
    deterministic_ties: bool = False,
    dealt_by: Sequence[str] = (),
) -> DataFrame:
    """Keep the last written row per key (pandas ``drop_duplicates(keep="last")``).

    NULL key values group together, as in pandas. ``order`` should be a total
    order within a key; ties are resolved arbitrarily unless
    ``deterministic_ties``, which adds a hash of the whole row as the last
    order key, so a recomputed task (e.g. after a lost executor) picks the
    same row. ``dealt_by`` names columns that follow from the key and that a
    join has just shuffled the log by, with some of the key: the window then
    takes the rows as dealt. They are dropped.
    """
    by = [F.col(c).desc_nulls_last() for c in order]
    if deterministic_ties:
        by.append(F.xxhash64(*[F.col(c) for c in log.columns if c not in dealt_by]).desc())
    w = Window.partitionBy(*keys, *dealt_by).orderBy(*by)
    out = log.withColumn(_RN, F.row_number().over(w)).filter(F.col(_RN) == 1).drop(_RN, *dealt_by)
    if not keep_order_columns:
        out = out.drop(*[c for c in order if c in out.columns])
    return out


def merge_latest(
    stored: DataFrame | None,
    landed: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = DEFAULT_ORDER,
    deterministic_ties: bool = False,
    broadcast_keys: bool = False,
    no_null_keys: bool = False,
    dealt_by: Sequence[str] = (),
) -> DataFrame:
    """Published table (one row per key) + landed rows -> next table.

    Same result as :func:`resolve_latest` over ``stored ∪ landed`` with the
    stored rows first, but only the landed rows are shuffled for the window;
    stored rows pass through a (null-safe) anti join against the landed keys.
    ``broadcast_keys`` is for a caller that has counted the landed rows: the
    stored table is then read once and not shuffled by the join. Otherwise both
    sides are shuffled by key unless AQE measures the keys to be small.
    ``no_null_keys`` is for landed rows that cannot have a null key (those of
    request windows): plain equality then gives the same rows, and the join
    takes both sides as a newest-wins window by the same keys has dealt them.
    ``dealt_by`` is that of :func:`resolve_latest`, for the landed rows.
    """
    keys = list(keys)
    new = resolve_latest(landed, keys, order, deterministic_ties=deterministic_ties, dealt_by=dealt_by)
    if stored is None:
        return new
    # the keys of all landed rows are those of the newest: no second window for them
    new_keys = landed.select(*[F.col(k).alias("__k_" + k) for k in keys]).distinct()
    if broadcast_keys:
        new_keys = F.broadcast(new_keys)
    pairs = [(stored[k], new_keys["__k_" + k]) for k in keys]
    cond = [a == b if no_null_keys else a.eqNullSafe(b) for a, b in pairs]
    kept = stored.join(new_keys, cond, "left_anti")
    return kept.unionByName(new.select(*[c for c in new.columns if c in stored.columns]), allowMissingColumns=True)
