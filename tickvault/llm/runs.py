"""Periodic run detection by seeds and diagonals.

A *run* is a maximal stretch of consecutive words with smallest period q whose
length is at least ``max(6, 4 * q)``. All runs of a document are found:

1. *Seeds.* A run of period q matches itself at lag q over at least
   ``max(6 - q, 3 * q)`` words, its guaranteed overlap. Periods are dealt into
   classes ``[low, high]``; a class indexes the k-grams of its least guaranteed
   overlap (k = 5 for periods 1 to 3, then k = 3 * low with ``2 * high - 1 <= k``).
   A longer k-gram can occur twice only where a shorter one does, so each class
   indexes only the positions that the class before left.
2. *Occurrence pairs.* Within a class a k-gram is paired with its next
   occurrence in the same document, if the lag is one of the class. That is
   enough: were there an occurrence nearer than q, the k-gram would have two
   periods whose sum it spans, hence (Fine and Wilf) a common divisor as period,
   and q would not be smallest. So pairs never exceed positions, and a stretch
   found at a lag has no smaller period.
3. *Extension.* Pairs are taken by lag and position. A table of the furthest
   position covered per lag skips pairs inside a stretch already extended;
   others are extended word by word to both sides along their diagonal.

Words are compared by exact numbers; k-grams by 64 bit hashes, and what they
propose is checked word by word.

Everything happens inside a document, so there is no shuffle and no hot key; a
task holds a few hundred documents at once, and a single long document takes
memory in proportion to its own words.

Defined results: a null, empty or blank text has no words, no runs, four nulls
and the hashes of the empty string; a null doc_id is carried through and its
text is never edited; repeated rows give equal rows; an empty table gives no
rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import table

#: Shortest run, and the least number of periods it holds.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Words numbered by a worker before its table starts anew.
_VOCABULARY = 1_500_000
#: Words a task holds at once (a longer document is held alone).
_HELD = 250_000

_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True, order=True)
class Run:
    """Words ``start .. start + length - 1`` of a document, repeating after ``period``."""

    start: int
    period: int
    length: int


class _Numbers(dict):
    """Words to numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def overlap(period: int) -> int:
    """Words over which a shortest run of this period matches itself at that lag."""
    return max(MIN_WORDS, MIN_PERIODS * period) - period


def period_classes(most: int) -> Iterator[tuple[int, int, int]]:
    """(low, high, k) of the classes of periods ``1 .. most``: k is the least
    overlap any run of the class has, and spans two periods but one word."""
    low = 1
    while low <= most:
        k, high = overlap(low), low
        while 2 * (high + 1) - 1 <= min(k, overlap(high + 1)):
            high += 1
            k = min(k, overlap(high))
        yield low, min(high, most), k
        low = high + 1


class _Grams:
    """Hashes of k-grams at chosen positions, k never decreasing: a k-gram is
    two overlapping grams of the greatest power of two up to k."""

    def __init__(self, ids: np.ndarray):
        self.size, self.hashes = 1, _mix(ids.astype(_U) * _M1 + _M2)

    def at(self, positions: np.ndarray, k: int) -> np.ndarray:
        while self.size * 2 <= k:
            self.hashes = _mix(self.hashes[: -self.size] * _M1 + self.hashes[self.size :])
            self.size *= 2
        return _mix(self.hashes[positions] * _M2 + self.hashes[positions + (k - self.size)])


def _seeds(ids: np.ndarray, doc: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, lags) of the occurrence pairs of each class. ``doc`` and
    ``last`` give each word's document and where that document ends."""
    if not len(ids):
        return
    grams, at = _Grams(ids), np.arange(len(ids))
    for low, high, k in period_classes(len(ids) // MIN_PERIODS):
        at = at[at + k <= last[at]]
        if len(at) < 2:
            return
        h = grams.at(at, k)
        h = _mix(h * _M1 + doc[at].astype(_U))
        order = np.argsort(h, kind="stable")  # equal grams stay in order of position
        h = h[order]
        same = h[1:] == h[:-1]
        here, after = at[order[:-1][same]], at[order[1:][same]]
        lag = after - here
        fits = (lag >= low) & (lag <= high)
        yield here[fits], lag[fits]
        twice = np.zeros(len(h), bool)
        twice[:-1] |= same
        twice[1:] |= same
        at = np.sort(at[order[twice]])


def _reach(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """First position from ``at`` up to ``stop`` that differs from the one ``lag`` on."""
    step = 32
    while at < stop:
        end = min(at + step, stop)
        unlike = ids[at:end] != ids[at + lag : end + lag]
        first = int(unlike.argmax())
        if unlike[first]:
            return at + first
        at, step = end, step * 4
    return stop


def _reach_back(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """Lowest position not below ``stop`` from which all up to ``at`` equal the one ``lag`` on."""
    step = 32
    while at > stop:
        begin = max(at - step, stop)
        unlike = (ids[begin:at] != ids[begin + lag : at + lag])[::-1]
        first = int(unlike.argmax())
        if unlike[first]:
            return at - first
        at, step = begin, step * 4
    return stop


def find_runs(ids: np.ndarray, ends: np.ndarray) -> list[list[Run]]:
    """Runs of each document, by start, then period. ``ids`` numbers the words
    of all documents one after another; ``ends`` says where each one ends."""
    size = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), size)
    begins = ends - size
    out: list[list[Run]] = [[] for _ in ends]
    for at, lags in _seeds(ids, doc, ends[doc]):
        order = np.lexsort((at, lags, doc[at]))
        at, lags = at[order], lags[order]
        # a pair right behind one of the same lag lies on the same stretch
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(lags) != 0)
        covered: dict[tuple[int, int], int] = {}
        for i, lag in zip(at[first].tolist(), lags[first].tolist(), strict=True):
            d = int(doc[i])
            if i < covered.get((d, lag), -1) or ids[i] != ids[i + lag]:
                continue
            stop = _reach(ids, i, lag, int(ends[d]) - lag)
            start = _reach_back(ids, i, lag, int(begins[d]))
            covered[d, lag] = stop
            length = stop + lag - start
            if length >= max(MIN_WORDS, MIN_PERIODS * lag):
                out[d].append(Run(start - int(begins[d]), lag, length))
    return [sorted(runs) for runs in out]


def longest(runs: list[Run]) -> Run | None:
    """The longest run; of equals the first, then the one of least period."""
    return min(runs, key=lambda r: (-r.length, r.start, r.period), default=None)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay when every run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    for r in runs:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    return np.cumsum(change[:n]) == 0


def repeated_from(n: int, doc_id: int | None) -> np.ndarray | None:
    """The query's edit: indexes of the words a document of ``n`` words is made
    of, or None if it stays as it is. Every tenth document (by crc32 of its
    decimal id) repeats a stretch from some word on to its end."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


_RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Documents by the few hundred thousand words: (ids, their words)."""
    ids, texts, held = [], [], 0
    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        for k in range(batch.num_rows):
            text = column[k].as_py()
            ids.append(batch.column("doc_id")[k].as_py())
            texts.append(text.split() if text else [])
            held += len(texts[-1])
            if held > _HELD:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _scan(edit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        for ids, texts in _groups(batches):
            if len(number) > _VOCABULARY:
                number.clear()
            if edit:
                for d, (doc_id, words) in enumerate(zip(ids, texts, strict=True)):
                    made_of = repeated_from(len(words), doc_id)
                    if made_of is not None:
                        texts[d] = [words[i] for i in made_of.tolist()]
            ends = np.cumsum([len(w) for w in texts])
            flat = np.fromiter((number[w] for words in texts for w in words), np.int64, int(ends[-1]))
            found = find_runs(flat, ends)
            collapsed = []
            for words, runs in zip(texts, found, strict=True):
                if runs:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(w) for w in texts], pa.int64()),
                    pa.array([[{"start": r.start, "length": r.length, "period": r.period} for r in runs] for runs in found], _RUN_TYPE),
                    pa.array(collapsed, pa.binary()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, edit: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id,
    text): its runs by start and period, and its words joined by one space
    with every run cut to its first period. ``edit`` first applies
    :func:`repeated_from`."""
    found = docs.select("doc_id", "text").mapInArrow(
        _scan(edit), f"doc_id long, n_words long, runs {_RUNS}, collapsed binary"
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), edit=True)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.element_at(
        F.array_sort(
            F.transform(
                "runs",
                lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")),
            )
        ),
        1,
    )
    some = F.when(F.size("runs") > 0, best)
    rows = found.withColumn("best", some)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
