"""Packing by cutting-stock column generation.

Documents are tokenised and cut into pieces of at most :data:`CAPACITY` tokens
(whole sequences first, then the rest of the document). Piece lengths, rounded
up to :data:`UNIT` tokens, form a histogram; a linear program over packing
patterns of that histogram is solved by column generation (a knapsack dynamic
program prices new patterns), rounded down, and what rounding leaves is packed
best-fit. The program depends on the histogram alone, never on the number of
documents, so it is solved on the driver in bounded space. Patterns are then
handed out to pieces by their rank within their length class; ranks come from
counts per (class, bucket), so no class is ever gathered into one task.

Defined results: a null text is an empty document of one token (its end id);
repeated rows are packed as documents of their own; an empty table gives no
pieces; a text of any length is cut, none of it dropped. Only doc_id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickvault.llm.common import table, written
from tickvault.llm.encoder import END_ID, default_path, encoder, slices

CAPACITY = 4096
UNIT = 8
#: Pieces a ranking bucket aims at.
BUCKET_ROWS = 20_000


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): pieces of every document with
    their ids as little-endian uint32 bytes."""
    path = tokenizer_path or default_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch):
                doc, start, total, ids = [], [], [], []
                for i, x in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text"), end), strict=True):
                    for at in range(0, len(x), 4 * capacity):
                        doc.append(i)
                        start.append(at // 4)
                        total.append(len(x) // 4)
                        ids.append(x[at : at + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(total, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, ids binary"
    )


def _knapsack(sizes: np.ndarray, values: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Best multiset of items within ``cap`` and its value."""
    best, pick = np.zeros(cap + 1), np.full(cap + 1, -1)
    for c in range(1, cap + 1):
        best[c] = best[c - 1]
        n = int(np.searchsorted(sizes, c, side="right"))
        if n:
            gain = best[c - sizes[:n]] + values[:n]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], pick[c] = gain[k], k
    counts, c = np.zeros(len(sizes)), cap
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[cap]), counts


def solve(demand: dict[int, int], cap: int, gap: float = 1e-3) -> list[tuple[dict[int, int], float]]:
    """Patterns {size: count} and their (fractional) use in the optimum of the
    cutting-stock relaxation, by revised simplex with knapsack pricing, until
    the number of sequences is proven to lie within ``gap`` of the optimum."""
    sizes = np.array(sorted(demand), dtype=np.int64)
    d = np.array([demand[int(s)] for s in sizes], dtype=float)
    m = len(sizes)
    columns = np.diag((cap // sizes).astype(float))  # column j: only items of size j
    inverse = np.diag(1.0 / np.diag(columns))
    use = inverse @ d
    for _ in range(40 * m):  # far beyond what the gap needs; ends degenerate cycles too
        value, column = _knapsack(sizes, np.maximum(inverse.sum(axis=0), 0.0), cap)
        if value <= 1 + gap:  # Farley: the optimum is at least use.sum() / value
            break
        step = inverse @ column
        positive = step > 1e-9
        if not positive.any():
            break
        ratio = np.full(m, np.inf)
        ratio[positive] = use[positive] / step[positive]
        out = int(ratio.argmin())
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        theta = ratio[out]
        use = np.maximum(use - theta * step, 0.0)
        use[out] = theta
    return [
        ({int(s): int(n) for s, n in zip(sizes, columns[:, j], strict=True) if n}, float(use[j])) for j in range(m)
    ]


def _best_fit(left: Counter, cap: int) -> Counter:
    """Patterns of the few pieces that rounding leaves, largest first."""
    open_: list[list[list[int]]] = [[] for _ in range(cap + 1)]
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            room = next((c for c in range(size, cap + 1) if open_[c]), None)
            held = open_[room].pop() if room is not None else []
            held.append(size)
            open_[(room if room is not None else cap) - size].append(held)
    return Counter(tuple(h) for c in open_ for h in c)


def patterns(demand: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """Whole-number patterns that pack exactly ``demand`` pieces of each size."""
    if not demand:
        return []
    left, out = Counter(demand), []
    for held, use in sorted(solve(demand, cap), key=lambda x: -x[1]):
        times = min([int(use + 1e-6)] + [left[s] // n for s, n in held.items()])
        if times > 0:
            out.append((held, times))
            left.subtract({s: n * times for s, n in held.items()})
    for held, times in sorted(_best_fit(left, cap).items()):
        out.append((dict(Counter(held)), times))
    return out


def _slots(spark: SparkSession, plan: list[tuple[dict[int, int], int]]) -> DataFrame:
    """(size, first_rank, end_rank, per, sequence0): which ranks of a length
    class go to which sequences. Bounded by the histogram's classes."""
    rows, taken, sequence = [], Counter(), 0
    for held, times in plan:
        for size, per in held.items():
            rows.append((size, taken[size], taken[size] + per * times, per, sequence))
            taken[size] += per * times
        sequence += times
    return spark.createDataFrame(
        rows, "size int, first_rank long, end_rank long, per long, sequence0 long"
    )


def _ranked(cut: DataFrame) -> DataFrame:
    """``cut`` with ``rank`` (from 0) within ``size``: rank in the bucket plus
    the counts of the buckets before it."""
    n = cut.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "start")) - 1
    return (
        cut.withColumn("inside", inside)
        .join(counts, ["size", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("bucket", "inside", "before")
    )


def pack(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """``cut`` (pieces, written once) with ``sequence_id`` and ``offset``.

    Carries all columns of ``cut``; ``size`` and ``rank`` are reserved names.
    """
    cut = written(spark, cut.withColumn("size", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    demand = {r["size"]: r["n"] for r in cut.groupBy("size").agg(F.count("*").alias("n")).collect()}
    slots = F.broadcast(_slots(spark, patterns(demand, capacity // unit)))
    ranked = _ranked(cut)
    placed = ranked.join(
        slots,
        (ranked["size"] == slots["size"]) & (ranked["rank"] >= slots["first_rank"]) & (ranked["rank"] < slots["end_rank"]),
    ).select(ranked["*"], (F.col("sequence0") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per"))).alias("sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("size", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids instead of the ids."""
    cut = pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(spark, cut).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where every piece of every document goes. The ids stay
    out of the shuffles; :func:`pieces` gives them again, piece by piece."""
    return packed(spark, docs)
