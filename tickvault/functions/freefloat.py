"""Free-float percentage rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickvault.functions.scalar import _col, nan_to_null, round_half_up


def free_float_pct(shares, float_shares) -> Column:
    """``float / shares * 100`` rounded to 2 places, or NULL.

    Computed only when both inputs are present, neither is zero and
    ``shares > 0``; a negative float passes. NaN counts as missing. A zero
    unrounded result is NULL as in the reference's truthiness test.
    """
    so = nan_to_null(_col(shares))
    fs = nan_to_null(_col(float_shares))
    pct = F.when((so > 0) & fs.isNotNull() & (fs != 0), fs / so * F.lit(100.0))
    return F.when(pct != 0, round_half_up(pct, 2))
