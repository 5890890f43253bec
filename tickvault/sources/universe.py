"""Universe sources (S1-S3, S8): ticker lists as DataFrames.

Lists are read line by line (``spark.read.text``), so a list of any size is
spread over file splits and tasks. The exact line order is rebuilt from
``_metadata.file_block_start`` (the split) and the row order inside a split;
positions come from :func:`dense_position` with one bucket per split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickvault.functions.scalar import strip_ws, universe_name
from tickvault.sinks.publish import read_if_any

# Fixed value: line breaks of Python's str.splitlines() beyond the \n, \r and
# \r\n that the text reader already splits on.
EXTRA_LINE_BREAKS = r"[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
TEXT_GLOB = "*.txt"


def list_universes(spark: SparkSession, directory: str) -> DataFrame:
    """Universes of a folder, ordered by code point: ``*.txt`` names
    (case-sensitive, every ``.txt`` removed) or, for a Spark-written layout,
    the ``Universe=<name>`` partition values. Only file metadata is read (the
    content column is pruned)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", TEXT_GLOB).load(directory)
    if "Universe" in files.columns:
        names = files.select(F.col("Universe").cast(T.StringType()).alias("Universe"))
    else:
        names = files.select(universe_name(F.element_at(F.split(F.col("path"), "/"), -1)).alias("Universe"))
    return names.distinct().orderBy("Universe")


def read_universe(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """``(Universe, pos, Ticker)``; lines stripped like ``str.strip()``,
    blanks dropped, order and duplicates kept. Free-float jobs upper-case,
    the reference's price jobs do not (``upper=False``).

    Two layouts: one ``<universe>.txt`` per list (the reference's), or a
    Spark-written ``Universe=<name>/part-*.txt`` dataset, where a list spans
    several files in part-number order. ``pos`` follows (file, split, line).
    """
    from tickvault.operators.positions import dense_position

    raw = spark.read.option("pathGlobFilter", TEXT_GLOB).text(path)
    if "Universe" in raw.columns:  # partition column of a Spark-written layout
        name = F.col("Universe").cast(T.StringType())
    else:
        name = universe_name(F.col("_metadata.file_name"))
    lines = raw.select(
        name.alias("Universe"),
        F.col("_metadata.file_name").alias("__file"),
        F.col("_metadata.file_block_start").alias("__blk"),
        F.monotonically_increasing_id().alias("__row"),
        F.posexplode(F.split(F.col("value"), EXTRA_LINE_BREAKS)).alias("__sub", "line"),
    )
    t = strip_ws(F.col("line"))
    if upper:
        t = F.upper(t)
    kept = lines.withColumn("Ticker", t).filter(F.col("Ticker") != "")
    # rank of each file inside its universe (a small table: one row per file)
    files = kept.select("Universe", "__file").distinct()
    files = files.withColumn(
        "__frank", F.row_number().over(Window.partitionBy("Universe").orderBy("__file")).cast(T.LongType())
    )
    keyed = kept.join(files, ["Universe", "__file"], "inner").withColumn(
        "__bucket", F.col("__frank") * F.lit(1 << 40) + F.col("__blk")
    )
    return dense_position(
        keyed, ["Universe"], "__row", out="pos", tiebreak=["__sub"], bucket_col="__bucket"
    ).select("Universe", "pos", "Ticker")


def prefer_source(primary: DataFrame, fallback: DataFrame, keys: Sequence[str] = ("Universe",)) -> DataFrame:
    """S3: rows of ``primary``; rows of ``fallback`` only for keys the primary
    lacks. With ``keys=("Universe",)`` this is the reference's rule: a
    universe's local list if it has any line, else the remote one."""
    keys = list(keys)
    missing = fallback.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.unionByName(missing, allowMissingColumns=True)


CACHED = "pos long, Ticker string, Universe string"


def read_cached(spark: SparkSession, cache_root: str) -> DataFrame:
    """Universe lists cached by :func:`cache_universe`; none if there is no cache."""
    return read_if_any(spark, CACHED, cache_root).select("Universe", "pos", "Ticker")


def cache_universe(universe: DataFrame, cache_root: str) -> None:
    """K5: keep lists by ``Universe`` partition; a list cached before is
    replaced, others stay (dynamic partition overwrite)."""
    universe.select("pos", "Ticker", "Universe").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("Universe").parquet(cache_root)


@dataclass(frozen=True)
class UniverseSource:
    """Universe lists kept locally, with a remote source to fall back on (S3, K5).

    ``names`` are the universes wanted; by default those cached, or, while none
    is, those of the remote source. A wanted universe without a cached ticker
    is taken from ``remote`` (Universe, pos, Ticker) and cached, so the next
    run does not ask the remote source for it.
    """

    cache_root: str
    remote: DataFrame
    names: Sequence[str] | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        local = read_cached(spark, self.cache_root)
        # one name a list, as many as the folders of the cache
        held = {r.Universe for r in local.select("Universe").distinct().collect()}
        if self.names is not None:
            wanted = list(self.names)
        else:
            wanted = sorted(held) or [r.Universe for r in self.remote.select("Universe").distinct().collect()]
        missing = [n for n in wanted if n not in held]
        if missing:
            # the filter reaches the remote scan: lists held locally are not read
            cache_universe(self.remote.filter(F.col("Universe").isin(missing)), self.cache_root)
        lists = read_cached(spark, self.cache_root).filter(F.col("Universe").isin(wanted))
        if lists.isEmpty():
            raise ValueError(f"no tickers, neither cached nor remote, for {wanted}")
        return lists


def read_marks(marks: DataFrame, universe: str | None = None, run_id: str | None = None) -> DataFrame:
    """Processed marks of one universe and run (stripped, blanks dropped)."""
    m = marks.withColumn("Ticker", strip_ws(F.col("Ticker"))).filter(F.col("Ticker") != "")
    if universe is not None:
        m = m.filter(F.col("Universe") == universe)
    if run_id is not None:
        m = m.filter(F.col("run_id") == run_id)
    return m
