"""Dense running position without a single-task window.

``row_number() over (partition by Universe order by k)`` puts a whole universe
in one task. Here the integer sort key is cut into buckets of ``bucket_size``;
the count per bucket is a small table (rows = keys / bucket_size), its running
sum gives each bucket's offset, and ``row_number`` runs inside a bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BUCKET = 1 << 16


def dense_position(
    df: DataFrame,
    partition_cols: Sequence[str],
    order_key: str,
    out: str = "position",
    bucket_size: int = DEFAULT_BUCKET,
    tiebreak: Sequence[str] = (),
    bucket_col: str | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based ``row_number`` over ``partition_cols`` ordered by
    the integer column ``order_key`` (then ``tiebreak``).

    ``bucket_col`` replaces the ``order_key / bucket_size`` buckets by a
    column that is already monotone with the order (e.g. a file split's
    start offset, one bucket per split).
    """
    parts = list(partition_cols)
    b = "__pos_bucket"
    if bucket_col is not None:
        keyed = df.withColumn(b, F.col(bucket_col).cast(T.LongType()))
    else:
        keyed = df.withColumn(b, F.floor(F.col(order_key) / F.lit(int(bucket_size))).cast(T.LongType()))
    counts = keyed.groupBy(*parts, b).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn(
        "__off",
        F.coalesce(
            F.sum("__n").over(
                Window.partitionBy(*parts).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("__n")
    w = Window.partitionBy(*parts, b).orderBy(F.col(order_key), *[F.col(c) for c in tiebreak])
    return (
        keyed.join(offsets, [*parts, b], "inner")
        .withColumn(out, (F.row_number().over(w) + F.col("__off")).cast(T.LongType()))
        .drop(b, "__off")
    )
