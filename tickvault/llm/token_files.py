"""Token ids as ORC files in ascending doc_id order.

Documents are dealt out by doc_id ranges, encoded, and written one sorted file
a range. ORC stores the ids run-length encoded as integers in stripes that are
read in parallel; row indexes and a Bloom filter on ``doc_id`` let a lookup
skip stripes by metadata alone (:func:`lookup`).

Defined results: a null text is empty and keeps its end id; equal doc_ids are
ordered by text; a null doc_id comes first; an empty table writes no rows; only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickvault.llm.common import table
from tickvault.llm.encoder import END_ID, default_path, encoder, slices
from tickvault.session import shared_dir

#: ORC writer settings: stripes of 16 MB, a row-index entry each 1,000 rows, Bloom filters on doc_id.
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}

def _encode_rows(path: str):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(path), 0
        for batch in batches:
            for part in slices(batch):
                ids, offsets = enc.flat(part.column("text"), end)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.arange(row, row + part.num_rows, dtype=np.int64)),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32))),
                    ],
                    names=["doc_id", "row", "n_tokens", "ids"],
                )
                row += part.num_rows

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into ORC files under ``path``."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(
        _encode_rows(tokenizer_path or default_path()),
        "doc_id long, row long, n_tokens long, ids array<int>",
    )
    encoded.write.options(**ORC_OPTIONS).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("file", "doc_id", "row")]
            + [pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["file", "doc_id", "row", "n_tokens", "ids_crc32"],
        )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: each file's rows are
    summed on their own, and the files' totals (one row a file) are laid end to
    end in file order, which is doc_id order."""
    files = spark.read.schema("doc_id long, row long, n_tokens long, ids array<int>").orc(path)
    rows = files.select(F.col("_metadata.file_name").alias("file"), "doc_id", "row", "ids").mapInArrow(
        _checksums, "file string, doc_id long, row long, n_tokens long, ids_crc32 long"
    )
    totals = files.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("total"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")  # the writer's task number
    before = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return rows.join(totals, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of the given documents; the filter reaches ORC's Bloom filters."""
    files = spark.read.schema("doc_id long, row long, n_tokens long, ids array<int>").orc(path)
    return files.filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, f"llm/{uuid.uuid4().hex}/tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_index(spark, path)
