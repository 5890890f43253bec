"""Scalar column expressions (all built-in Spark functions, no UDFs)."""

from tickvault.functions.scalar import (  # noqa: F401
    age_days,
    is_rate_limited,
    local_date,
    nan_to_null,
    round_half_up,
    strip_ws,
    universe_name,
)
from tickvault.functions.freefloat import free_float_pct  # noqa: F401
