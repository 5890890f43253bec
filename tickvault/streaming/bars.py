"""Structured Streaming form of the merge.

Landed files are read with ``readStream`` (file source; its checkpoint is the
resume state, T1). Each micro-batch is appended to the ``bars_log`` table under
its own ``batch_id`` partition; a replayed micro-batch overwrites only its own
partition (dynamic partition overwrite), so replays after a lost executor or
driver are idempotent. ``compact`` resolves the snapshot plus the log batches
it has not seen into the next snapshot version, newest write winning — the
same function as the batch job, so k micro-batches equal one batch resolve.

The reference rewrote the whole table every 10 tickers; here a micro-batch
writes only its own rows and compaction runs when the caller chooses
(``compact_every`` micro-batches, or once after ``availableNow``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.operators.merge import merge_latest
from tickvault.plans.windows import materialise
from tickvault.session import shared_dir
from tickvault.sinks.files import remove
from tickvault.sinks.publish import publish, read_if_any, read_table, snapshot


def append_log(batch: DataFrame, batch_id: int, log_root: str) -> None:
    """Write one landed batch as partition ``batch_id=<id>`` (replay-safe)."""
    (
        batch.withColumn("batch_id", F.lit(int(batch_id)).cast(T.LongType()))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(log_root)
    )


def log_batches(spark: SparkSession, log_root: str) -> list[int]:
    """Batches in the log, by their partition values (no rows are read)."""
    batches = read_if_any(spark, "batch_id long", log_root).select("batch_id").distinct()
    return sorted(r.batch_id for r in batches.collect())


def _conform(landed: DataFrame, schema: T.StructType, order: Sequence[str]) -> DataFrame:
    """Log rows in table column order; columns a feed lacks are typed NULLs."""
    cols = [
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in landed.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return landed.select(*cols, *[F.col(c) for c in order if c not in schema.fieldNames()])


def compact(
    spark: SparkSession,
    log_root: str,
    table_root: str,
    schema: T.StructType,
    keys: Sequence[str] = ("Universe", "Ticker", "Date"),
    order: Sequence[str] = ("batch_id", "seq"),
    sort_within: Sequence[str] = ("Ticker", "Date"),
    expire_log: bool = False,
) -> int | None:
    """Snapshot ∪ log batches newer than it -> next snapshot version, in the
    batch job's layout: by (Universe, year) with per-ticker stats, rewriting
    only the partitions the new batches land in, so stream and job keep one
    table. With ``expire_log`` the batches it has taken in are deleted.

    Returns the new version, or the current one when there is nothing new.
    """
    from tickvault.jobs import BAR_PARTITIONS, BROADCAST_PLAN_ROWS, bar_stats, touched_partitions

    now = snapshot(spark, table_root)
    seen = now.note if now and now.note is not None else -1
    new_batches = [b for b in log_batches(spark, log_root) if b > seen]
    if not new_batches:
        return now.version if now else None
    data_cols = [f.name for f in schema.fields]
    # batches are taken in order, so the new ones are a range; read once for
    # the partitions they land in, their count and the merge
    landed = materialise(_conform(spark.read.parquet(log_root).filter(F.col("batch_id") > seen), schema, order))
    touched = touched_partitions(landed)
    stored = read_table(spark, table_root, schema, at=now, only=touched.__contains__) if now else None
    merged = merge_latest(stored, landed, keys, order, broadcast_keys=landed.count() <= BROADCAST_PLAN_ROWS)
    v = publish(
        merged.select(*data_cols).withColumn("year", F.year("Date")),
        table_root,
        partition_by=BAR_PARTITIONS,
        sort_within=list(sort_within),
        only_partitions=True,
        note=max(new_batches),
        sides={"stats": bar_stats},
        at=now,
    )
    if expire_log:
        for b in new_batches:
            remove(spark, f"{log_root.rstrip('/')}/batch_id={b}")
    return v


def read_live(
    spark: SparkSession,
    log_root: str,
    table_root: str,
    schema: T.StructType,
    keys: Sequence[str] = ("Universe", "Ticker", "Date"),
    order: Sequence[str] = ("batch_id", "seq"),
) -> DataFrame:
    """Merge on read: the table as if compacted now (nothing is written)."""
    now = snapshot(spark, table_root)
    seen = now.note if now and now.note is not None else -1
    data_cols = [f.name for f in schema.fields]
    stored = read_table(spark, table_root, schema, at=now) if now else spark.createDataFrame([], schema)
    if not any(b > seen for b in log_batches(spark, log_root)):
        return stored
    landed = _conform(spark.read.parquet(log_root).filter(F.col("batch_id") > seen), schema, order)
    return merge_latest(stored, landed, keys, order).select(*data_cols)


def stream_landed(
    spark: SparkSession,
    landing_dir: str,
    landed_schema: T.StructType,
    log_root: str,
    name: str = "bars",
    checkpoint: str | None = None,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    transform=None,
    compact_every: int | None = None,
    table_root: str | None = None,
    table_schema: T.StructType | None = None,
    keys: Sequence[str] = ("Universe", "Ticker", "Date"),
    order: Sequence[str] = ("batch_id", "seq"),
    path_glob: str | None = None,
):
    """Start the landing stream; returns the ``StreamingQuery``.

    ``transform`` maps a landed micro-batch to log rows (e.g. normalisation);
    ``compact_every`` resolves into ``table_root`` every n micro-batches. The
    checkpoint defaults to a folder under the cluster's shared
    ``spark.checkpoint.dir``.
    """
    cp = checkpoint or shared_dir(spark, f"streams/{name}")
    reader = spark.readStream.schema(landed_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    src = reader.parquet(landing_dir)

    def on_batch(df: DataFrame, batch_id: int) -> None:
        rows = transform(df) if transform is not None else df
        append_log(rows, batch_id, log_root)
        if compact_every and table_root is not None and (batch_id + 1) % int(compact_every) == 0:
            compact(spark, log_root, table_root, table_schema, keys=keys, order=order)

    w = src.writeStream.foreachBatch(on_batch).option("checkpointLocation", cp)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
