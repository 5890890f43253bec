"""Temp views so any Spark SQL works on the engine's tables (§2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickvault.schemas import FREE_FLOAT, PRICES_STORED
from tickvault.sources.store import read_current


# The reference's SELECTs over the views, for all keys at once.
STORED_TICKERS = "SELECT Ticker FROM free_float"
LAST_UPDATED = """
SELECT u.Universe, u.Ticker, f.`Last Updated`
FROM universe u JOIN free_float f ON u.Universe = f.Universe AND u.Ticker = f.Ticker
"""
TABLES = "SELECT name, rows FROM tables"


def register_views(
    spark: SparkSession,
    prices_root: str | None = None,
    free_float_root: str | None = None,
    universe: DataFrame | None = None,
    attempts: DataFrame | None = None,
) -> list[str]:
    """Register ``prices``, ``free_float``, ``universe``, ``attempts`` and
    ``tables`` (the stored ones, with their rows).

    ``SELECT Ticker FROM free_float`` and
    ``SELECT "Last Updated" FROM free_float WHERE Ticker = ?`` of the
    reference become plain Spark SQL on these views.
    """
    names, stored = [], []
    if prices_root is not None:
        read_current(spark, prices_root, PRICES_STORED).createOrReplaceTempView("prices")
        names.append("prices")
        stored.append("prices")
    if free_float_root is not None:
        read_current(spark, free_float_root, FREE_FLOAT).createOrReplaceTempView("free_float")
        names.append("free_float")
        stored.append("free_float")
    if universe is not None:
        universe.createOrReplaceTempView("universe")
        names.append("universe")
    if attempts is not None:
        attempts.createOrReplaceTempView("attempts")
        names.append("attempts")
    if stored:
        # which stored tables there are, as an SQL catalogue would say
        counts = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in stored)
        spark.sql(counts).createOrReplaceTempView("tables")
        names.append("tables")
    return names
