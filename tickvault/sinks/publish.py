"""Atomic, incremental table publish (K1) with Spark's own writer.

``<root>/data/w=<id>/<partition columns>`` holds the files of one write, made
by the partitioned Parquet writer, ``<root>/<side>/w=<id>`` small tables derived
from it; ``<root>/log/v=<N>`` is the commit marker of
version N: a small Parquet table naming the write and the partitions it
replaces. The marker is written beside the log and renamed to ``v=N``, which
fails if that version exists: of two writers that start from the same version
one commits, the other gets :class:`StaleVersion`. A crash before the rename
leaves files that no version names.

Reading is ``spark.read`` over the live writes with a plain partition filter:
each partition's rows are those of the last committed write that replaced it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.session import shuffles_dropped
from tickvault.sinks.files import rename_new

LOG = "w string, whole boolean, note long, by array<string>, part array<string>, v int"
ANY = "any version"


class StaleVersion(RuntimeError):
    """The table moved on since the rows to publish were derived from it."""


@dataclass(frozen=True)
class Snapshot:
    """A committed version: its partition columns and each partition's write."""

    version: int
    by: list[str]
    parts: dict[tuple[str | None, ...], str]
    #: what the last writer that said so noted (a stream: batches taken in)
    note: int | None


def read_if_any(spark: SparkSession, schema, path: str) -> DataFrame:
    """Parquet rows under ``path``, none if it does not exist; unreadable files raise."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return read_if_any(spark, LOG, f"{root}/log")


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot | None:
    """The newest committed version (or ``version``); None if there is none.
    The driver gets one row a partition, as it lists one folder a partition."""
    log = read_log(spark, root)
    if version is not None:
        log = log.filter(F.col("v") <= version)
    heads = log.filter("part is null")
    last = heads.agg(F.max("v").alias("v"), F.max_by("by", "v").alias("by"), F.max("note").alias("note"), F.max(F.when(F.col("whole"), F.col("v"))).alias("base")).first()
    if last is None or last.v is None:
        return None
    live = log.filter(F.col("part").isNotNull() & (F.col("v") >= (last.base or 0)))
    parts = live.groupBy("part").agg(F.max_by("w", "v").alias("w")).collect()
    return Snapshot(last.v, list(last.by), {tuple(r.part): r.w for r in parts}, last.note)


def current_version(spark: SparkSession, root: str) -> int | None:
    now = snapshot(spark, root)
    return now.version if now else None


def _texts(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in cols]).cast("array<string>")


def _key(cols: Sequence[str]) -> Column:
    return F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in cols])


def _read_parts(spark: SparkSession, folder: str, schema: T.StructType, by: list[str], parts: dict, types: dict) -> DataFrame:
    own = [T.StructField(c, types.get(c, T.StringType())) for c in by]
    whole = T.StructType([*[f for f in schema.fields if f.name not in by], *own, T.StructField("w", T.StringType())])
    if not parts:
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).option("basePath", folder).parquet(*[f"{folder}/w={w}" for w in sorted(set(parts.values()))])
    keys = ["\x01".join(["\x02" if x is None else x for x in part] + [w]) for part, w in parts.items()]
    return rows.filter(_key([*by, "w"]).isin(keys))


def read_table(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    at: Snapshot | None = None,
    only: Callable[[tuple], bool] | None = None,
    side: str | None = None,
    keep_partition_columns: bool = False,
) -> DataFrame | None:
    """Rows of a version (default: the newest), None if there is none. ``only``
    picks partitions by their values; ``side`` reads a table written beside the
    rows, None if some partition came without it."""
    at = at or snapshot(spark, root)
    if at is None:
        return None
    parts = {p: w for p, w in at.parts.items() if only is None or only(p)}
    types = {f.name: f.dataType for f in schema.fields}
    try:
        # a side table holds the partition values as text columns
        rows = _read_parts(spark, f"{root}/{side or 'data'}", schema, at.by, parts, {} if side else types)
    except AnalysisException as e:
        if side is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    extra = [c for c in at.by if c not in schema.fieldNames()] if keep_partition_columns else []
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], *extra)


def publish(
    df: DataFrame,
    root: str,
    partition_by: Sequence[str] = (),
    sort_within: Sequence = (),
    only_partitions: bool = False,
    sides: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
    note: int | None = None,
    beside: Callable[[str], None] | None = None,
    at: Snapshot | None | str = ANY,
    commit_nothing: bool = True,
) -> int | None:
    """K1: write ``df`` and commit it as the next version; returns the version.

    With ``only_partitions`` partitions absent from ``df`` keep their rows.
    ``sort_within`` orders rows inside each file (O1). ``sides`` derives small
    tables from the rows as written, e.g. statistics; ``beside(write id)``
    writes what belongs to this commit elsewhere, e.g. marks. ``note`` is kept
    until a later writer notes more. ``at`` is the snapshot the rows were
    derived from (None: no table yet); if the table has moved on,
    :class:`StaleVersion` is raised and nothing is committed. With
    ``commit_nothing=False`` a write without rows commits no version.
    """
    spark, by, w = df.sparkSession, list(partition_by), uuid.uuid4().hex
    now = snapshot(spark, root) if at == ANY else at
    version = now.version if now else None
    if only_partitions and now and now.by != by:
        raise ValueError("only_partitions needs the partition columns of the current version")
    out = df
    if by:
        # few, evenly sized files a partition, instead of one a task and partition
        out = out.hint("rebalance", *by)
    if by and sort_within:
        # columns the optimizer cannot fold to constants: the writer then finds
        # its own order in ours, and does not sort again without Ticker and Date
        out = out.withColumns({c: F.when(F.spark_partition_id() >= 0, F.col(c)) for c in by})
    if sort_within:
        out = out.sortWithinPartitions(*by, *sort_within)
    with shuffles_dropped(spark):
        out.write.partitionBy(*by).option("compression", "zstd").parquet(f"{root}/data/w={w}")

    written = spark.read.schema(df.schema).parquet(f"{root}/data/w={w}")
    for name, build in (sides or {}).items():
        side = build(written).withColumns({c: F.col(c).cast("string") for c in by})
        with shuffles_dropped(spark):
            side.write.option("compression", "zstd").parquet(f"{root}/{name}/w={w}")
    if beside:
        beside(w)
    head = F.lit(w).alias("w"), F.lit(not (only_partitions and now)).alias("whole"), F.lit(note).cast("long").alias("note")
    layout = F.array(*[F.lit(c) for c in by]).cast("array<string>").alias("by")
    marker = spark.range(1).select(*head, layout, F.lit(None).cast("array<string>").alias("part"))
    marker = marker.union(written.select(_texts(by).alias("part")).distinct().select(*head, layout, "part"))
    marker.coalesce(1).write.parquet(f"{root}/log/_{w}")
    if not commit_nothing and spark.read.schema(LOG).parquet(f"{root}/log/_{w}").filter("part is not null").isEmpty():
        return version
    n = (version or 0) + 1
    while not rename_new(spark, f"{root}/log/_{w}", f"{root}/log/v={n}"):
        if at != ANY:
            raise StaleVersion(f"{root}: rows come from version {version}, another writer committed version {n}")
        n += 1
    return n
