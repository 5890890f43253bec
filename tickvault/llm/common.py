"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.session import shared_dir

#: One or more of the separators of the word rule: space, tab, \n, \v, \f, \r.
BLANKS = r"[\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it,
    whatever folder the driver was started in. A cluster whose nodes lack that
    folder gets the package with ``--py-files``, as usual."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    held = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in held:
        env["PYTHONPATH"] = os.pathsep.join([*held, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often
    ``body`` mentions it (a lambda variable is never inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, BLANKS, -1), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not broadcast either side: one that grows
    with the table, or that Spark sizes too low (a Python step or an explode
    that gives many rows for one is sized as its input is)."""
    return df.hint("merge")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage
    ends at files every executor sees, so a lost executor costs no recompute
    of what came before."""
    path = shared_dir(spark, f"llm/{uuid.uuid4().hex}/{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
