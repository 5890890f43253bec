"""Hard-negative mining by Fagin's threshold algorithm.

For every anchor: its positives are the best rows of its own label, and for
each positive the negatives are the best rows of other labels whose score lies
in the window that the positive's score sets. A score is the integer inner
product of two vectors.

Rows are dealt by a hash of their id into blocks of some thousand rows, anchors
likewise, and every block of anchors meets every block of rows (a query set
against all rows, in blocks). Within such a meeting the threshold algorithm
runs per anchor:

* each dimension has the block's rows in a list sorted by component;
* lists are read from the end that raises the score, by the sign of the
  anchor's component (dimensions where it is zero are not read);
* a row met for the first time gets its whole score by random access;
* the threshold, the score of a row holding the last component read of each
  list, bounds every row not met. A window is settled once the threshold lies
  strictly below its k-th best score (strictly, since ties go to the smaller
  id), or below the window itself; reading stops when all windows are.

Blocks give at most k rows per window; a window function keeps the best k of
all blocks. The first pass finds positives (rows sorted by label within the
block, one index a label), the second negatives.

Scores are exact: vectors are integers, and the arithmetic (float32, float64 or
int64) is chosen by the largest sum that can occur.

Defined results: rows with a null id, a null label, a null vector, or a null or
non-finite component take no part; components saturate at +-2^27 after scaling
(a float's 524,288); vectors of unlike length are compared as if the shorter had
zeros; rows that repeat an id count once (the least label, then vector); ties go
to the smaller id; anchors without positives or windows without rows give no
result; an empty table gives no rows; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickvault.llm.common import table, written

POSITIVES = 5
NEGATIVES = 5
#: Window of a positive's score p: low% of p <= score <= high% of p.
LOW, HIGH = 80, 100
SCALE = 256
#: Rows, and anchors, a block holds on average.
BLOCK = 8192
_LIMIT = 1 << 27
_FIRST_READ = 32
_FAR = 1 << 62


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Integer components floor(scale * x), x as double."""

    def one(x: Column) -> Column:
        whole = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.greatest(F.least(whole, F.lit(_LIMIT)), F.lit(-_LIMIT)).cast("int")

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """No null vector, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def _exact(x: np.ndarray, a: np.ndarray) -> type:
    """The fastest type in which inner products of these integers are exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0)) * max(x.shape[1], 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


@dataclass
class SortedLists:
    """Rows of a block, one list a dimension sorted by component. ``x`` holds
    the rows in order of id, so a smaller row number is a smaller id."""

    x: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)

    def best(self, a: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, scores) of the first ``k`` allowed rows of each window
        ``low <= score <= high``, best score first, then smaller row number."""
        n = len(self.x)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        lowest = min((low for low, _ in windows), default=_FAR)
        highest = max((high for _, high in windows), default=-_FAR)
        met = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        read, upto = 0, min(_FIRST_READ, n)
        settled = not windows or n == 0
        while not settled:
            # sorted access: the next entries of every list, from the end that counts
            new = np.zeros(n, bool)
            new[self.order[n - upto : n - read, up].ravel()] = True
            new[self.order[read:upto, down].ravel()] = True
            if not len(up) and not len(down):
                new[:] = True  # every score is zero
            new &= ~met
            met |= new
            # random access: whole scores of the rows met for the first time
            at = np.flatnonzero(new & allowed)
            s = (self.x[at] @ a).astype(np.int64)
            fits = (s >= lowest) & (s <= highest)
            rows, scores = np.concatenate([rows, at[fits]]), np.concatenate([scores, s[fits]])
            order = np.lexsort((rows, -scores))
            rows, scores = rows[order], scores[order]
            last = int(a[up] @ self.sorted[n - upto, up] + a[down] @ self.sorted[upto - 1, down])
            settled = upto == n or bool(met.all()) or all(last < self._needed(scores, w, k) for w in windows)
            read, upto = upto, min(upto * 2, n)
        out = []
        for low, high in windows:
            begin, end = self._span(scores, low, high)
            end = min(end, begin + k)
            out.append((rows[begin:end], scores[begin:end]))
        return out

    @staticmethod
    def _span(scores: np.ndarray, low: int, high: int) -> tuple[int, int]:
        return int(np.searchsorted(-scores, -high, side="left")), int(np.searchsorted(-scores, -low, side="right"))

    def _needed(self, scores: np.ndarray, window: tuple[int, int], k: int) -> int:
        """A row scoring less changes nothing in the window."""
        low, high = window
        begin, end = self._span(scores, low, high)
        return int(scores[begin + k - 1]) if end - begin >= k else low


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """List column as a matrix, short rows filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _width(*tables: pa.Table) -> int:
    return max((int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables if t.num_rows), default=0)


def _loaded(rows: pa.Table, anchors: pa.Table):
    rows = rows.sort_by("vec_id")
    width = _width(rows, anchors)
    x, a = _matrix(rows["v"], width), _matrix(anchors["v"], width)
    kind = _exact(x, a)
    return rows["vec_id"].to_numpy(), rows["label"].to_numpy(), x.astype(kind), a.astype(kind)


def _local_positives(k: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return schema.empty_table()
        ids, labels, x, a = _loaded(rows, anchors)
        out = []
        anchor_ids, anchor_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        for label in np.unique(anchor_labels):
            own = np.flatnonzero(labels == label)
            lists = SortedLists(x[own])
            for q in np.flatnonzero(anchor_labels == label):
                ((at, score),) = lists.best(a[q], ids[own] != anchor_ids[q], [(-_FAR, _FAR)], k)
                out.append((np.full(len(at), anchor_ids[q]), ids[own][at], score))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return run


def _local_negatives(k: int, low: int, high: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("vec_id", pa.int64()),
                        ("positive_score", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return schema.empty_table()
        ids, labels, x, a = _loaded(rows, anchors)
        lists, out = SortedLists(x), []
        for q, (anchor_id, label, positives) in enumerate(
            zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist(), strict=True)
        ):
            # low% of p <= score <= high% of p, in whole numbers
            windows = sorted({(-(-low * p["score"] // 100), high * p["score"] // 100) for p in positives})
            windows = [w for w in windows if w[0] <= w[1]]
            found = dict(zip(windows, lists.best(a[q], labels != label, windows, k), strict=True))
            for p in positives:
                at, score = found.get((-(-low * p["score"] // 100), high * p["score"] // 100), ((), ()))
                if len(at):
                    m = len(at)
                    out.append((np.full(m, anchor_id), np.full(m, p["vec_id"]), ids[at], np.full(m, p["score"]), score))
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return run


def _blocks(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Rows dealt into ``n_own`` blocks by id, once for each of the other side's."""
    dealt = rows.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    best_first = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def hard_negatives(
    spark: SparkSession,
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for ``rows`` (vec_id, label, v: array of int); ``is_anchor``
    is a condition on vec_id."""
    given = rows.filter("vec_id is not null and label is not null and v is not null")
    first = given.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "v")).alias("r"))
    rows = written(spark, first.select("vec_id", "r.label", "r.v"), "rows")
    anchors = rows.filter(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    rb, ab = max(1, -(-n_rows // block)), max(1, -(-n_anchors // block))
    blocks = _blocks(rows, "rb", rb, "ab", ab).groupBy("rb", "ab")

    near = blocks.cogroup(_blocks(anchors, "ab", ab, "rb", rb).groupBy("rb", "ab")).applyInArrow(
        _local_positives(positives), "anchor_id long, vec_id long, score long"
    )
    best = _ranked(near, ["anchor_id"], positives).groupBy("anchor_id").agg(
        F.collect_list(F.struct("vec_id", "score")).alias("positives")
    )
    armed = written(spark, anchors.join(best, anchors["vec_id"] == best["anchor_id"]).select("vec_id", "label", "v", "positives"), "anchors")

    far = blocks.cogroup(_blocks(armed, "ab", ab, "rb", rb).groupBy("rb", "ab")).applyInArrow(
        _local_negatives(negatives, low, high),
        "anchor_id long, positive_id long, vec_id long, positive_score long, score long",
    )
    return _ranked(far, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull() & usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = given.select("vec_id", label.alias("label"), scaled(F.col("embedding")).alias("v"))
    return hard_negatives(spark, rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH clean AS (
  SELECT vec_id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM clean a JOIN clean r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
