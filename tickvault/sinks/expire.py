"""Dropping what no kept version needs (K6)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tickvault.sinks.files import remove
from tickvault.sinks.publish import read_log, snapshot


def list_versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(r.v for r in read_log(spark, root).filter("part is null").select("v").collect())


def _writes_on_disk(spark: SparkSession, root: str, older_than_hours: float) -> set[str]:
    """Writes whose files are all older; their contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/data")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()
    by_write = files.groupBy(F.regexp_extract("path", r"/data/w=([0-9a-f]+)/", 1).alias("w")).agg(F.max("modificationTime").alias("t"))
    old = F.col("t") < F.current_timestamp() - F.make_dt_interval(hours=F.lit(0), mins=F.lit(int(older_than_hours * 60)))
    return {r.w for r in by_write.filter((F.col("w") != "") & old).collect()}


def expire_snapshots(spark: SparkSession, root: str, keep: int = 2, orphan_hours: float = 24.0, sides=("stats",)) -> list[int]:
    """K6: drop versions, and their files, that none of the newest ``keep``
    versions reads; also writes never committed, once ``orphan_hours`` old (a
    younger one may still be running). Returns the versions dropped."""
    heads = {r.v: r.w for r in read_log(spark, root).filter("part is null").select("v", "w").collect()}
    if not heads:
        return []
    kept = sorted(heads)[-keep:]
    live = {heads[v] for v in kept}
    for v in kept:
        live.update(snapshot(spark, root, v).parts.values())
    dropped = sorted(v for v, w in heads.items() if w not in live)
    orphans = _writes_on_disk(spark, root, orphan_hours) - set(heads.values())
    for v in dropped:  # the marker first: a version is whole or gone
        remove(spark, f"{root}/log/v={v}")
    for w in [heads[v] for v in dropped] + sorted(orphans):
        for folder in ("data", *sides):
            remove(spark, f"{root}/{folder}/w={w}")
        remove(spark, f"{root}/log/_{w}")
    return dropped
