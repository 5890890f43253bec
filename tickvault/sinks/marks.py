"""Marks of a run in progress.

The keys a run has processed are written as ``marks/run_id=<r>/w=<id>`` in the
same commit as its rows: a mark counts only if the write it names was
committed, so a run that dies between the two has neither. When the run is
complete, its partition is removed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.sinks.files import remove
from tickvault.sinks.publish import read_if_any, read_log

MARKS_WRITTEN = "Ticker string, run_id string, w string, Universe string"


def _checked(run_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run_id must be letters, digits, '_', '.' or '-' (it names a folder), not {run_id!r}")
    return run_id


def write_marks(marks: DataFrame, root: str, run_id: str, w: str) -> None:
    """K4: keys processed, as part of write ``w`` of the table at ``root``."""
    marks.select("Universe", "Ticker").withColumns({"run_id": F.lit(_checked(run_id)), "w": F.lit(w)}).write.mode(
        "append"
    ).partitionBy("run_id", "w", "Universe").parquet(f"{root}/marks")


def stored_marks(spark: SparkSession, root: str) -> DataFrame:
    """(Universe, run_id, Ticker) of all committed marks; filters on run_id and
    Universe prune folders."""
    committed = read_log(spark, root).filter("part is null").select("w")
    marks = read_if_any(spark, MARKS_WRITTEN, f"{root}/marks")
    return marks.join(committed, "w", "left_semi").select("Universe", "run_id", "Ticker")


def clear_marks(spark: SparkSession, root: str, run_id: str) -> None:
    """K4: the run is complete, or had nothing to do."""
    remove(spark, f"{root}/marks/run_id={_checked(run_id)}")
