"""tickvault: Spark-native upkeep of daily-bar and free-float tables.

The public API, all DataFrame in / DataFrame out (see README.md):
"""

from tickvault.jobs import maintain_free_float, maintain_prices  # noqa: F401
from tickvault.operators.freefloat import (  # noqa: F401
    classify_errors,
    resolve_attempts,
    results_to_rows,
    upsert_free_float,
    with_free_float,
)
from tickvault.operators.gaps import find_gaps  # noqa: F401
from tickvault.operators.merge import merge_latest, resolve_latest  # noqa: F401
from tickvault.operators.normalize import normalize_quotes, unstack_wide  # noqa: F401
from tickvault.plans.windows import apply_windows  # noqa: F401
from tickvault.plans.work import (  # noqa: F401
    plan_backfill,
    plan_fresh,
    plan_resume,
    plan_stale,
    plan_update,
)
from tickvault.sinks.expire import expire_snapshots  # noqa: F401
from tickvault.sinks.publish import publish  # noqa: F401
from tickvault.sources.store import read_free_float, read_prices  # noqa: F401
from tickvault.sources.universe import list_universes, prefer_source, read_universe  # noqa: F401
from tickvault.streaming.bars import compact, read_live, stream_landed  # noqa: F401
