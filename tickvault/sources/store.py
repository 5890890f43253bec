"""Reading stored tables.

Stored tables are versioned Parquet snapshots written by
:mod:`tickvault.sinks.publish`; a reader takes the newest *committed*
version. No snapshot -> an empty DataFrame of the schema ("no data"). A
snapshot that exists but cannot be read raises: treating it as empty would
republish only the new rows over the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.schemas import FREE_FLOAT, FREE_FLOAT_V1_COLUMNS, PRICES_STORED
from tickvault.sinks.publish import read_table


def read_current(spark: SparkSession, root: str, schema) -> DataFrame:
    """Newest committed snapshot under ``root`` with an explicit schema."""
    df = read_table(spark, root, schema)
    return df if df is not None else spark.createDataFrame([], schema)


def read_prices(spark: SparkSession, root: str) -> DataFrame:
    """Stored bars (partitioned by Universe, so a universe filter prunes)."""
    return read_current(spark, root, PRICES_STORED)


def read_free_float(spark: SparkSession, root: str) -> DataFrame:
    """Stored free-float rows."""
    return read_current(spark, root, FREE_FLOAT)


def union_free_float_versions(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """K3: rows of the 5-column table get NULL Status and Error."""
    missing = [c for c in ("Status", "Error") if c not in v1.columns]
    assert all(c in v1.columns for c in FREE_FLOAT_V1_COLUMNS), "not a free_float table"
    v1 = v1.select(*v1.columns, *[F.lit(None).cast("string").alias(c) for c in missing])
    cols = [f.name for f in FREE_FLOAT.fields if f.name in v1.columns or f.name in v2.columns]
    return v1.select(*cols).unionByName(v2.select(*cols))
