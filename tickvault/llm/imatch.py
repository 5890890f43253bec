"""Document fingerprints: I-Match over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency ln(N / df) lies in
a band: no stop words, no one-off terms. Subsets of it are fixed by hashes of
the terms alone: the whole lexicon, and :data:`CHAINS` chains of nested random
subsets of rates 1/2, 1/4, .. 2^-:data:`LEVELS`. For every subset a document's
distinct terms there are sorted (by a 64 bit hash) and the list is hashed:
one slot of the fingerprint, a hex digit for the number of terms (at most 15)
and four for the hash; no term, an empty slot of zeros.

*Likeness.* If two documents share a part rho of their terms, a slot of n terms
is equal with probability rho^n; the likeness is the rho that makes the slots
seen, equal and unequal, most probable (:func:`likeness`): 1 if all slots are
equal, 0 if none is. Small subsets speak for long documents, large ones for
short documents.

The lexicon is broadcast as 8-byte hashes if it is counted to be small enough;
beyond :data:`BROADCAST_TERMS` the documents' term hashes are joined to it by a
shuffle, with the same result. With d distinct terms in a mean document, at most
d / share terms can occur in a given share of all documents, so its size does
not grow with the corpus.

Defined results: a null text is empty; a text without a lexicon term is
fingerprinted by all its terms, one without terms by its characters; equal
texts have equal fingerprints. The next document is the one with the next
larger doc_id (rows of one doc_id ordered by text), after the last the first;
a null doc_id has no next document (its text loses its last quarter, near_next
is null). An empty table gives no rows. Only doc_id and text are read, so other
columns cannot clash. A text of any length is read whole. Rows of one doc_id
are one range, hence one task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import table, written

#: Chains of nested lexicon subsets, and subsets a chain (rates 1/2 to 2^-LEVELS).
CHAINS, LEVELS = 8, 11
#: Slots of a fingerprint; the first is the whole lexicon.
SLOTS = 1 + CHAINS * LEVELS
#: Band of ln(N / df): terms in 1 of 20 documents to 1 of 2,000.
MIN_IDF, MAX_IDF = math.log(20), math.log(2_000)
#: A lexicon of at most this many terms (8 bytes each, counted) is broadcast.
BROADCAST_TERMS = 2_000_000
#: Characters of text that a range of documents aims at.
RANGE_CHARS = 16_000_000
_FLUSH = 500_000

_U = np.uint64
_TERM = re.compile(r"[^\W_]+")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_SEEDS = _mix(np.arange(1, CHAINS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
_PLACE = _U(0xC2B2AE3D27D4EB4F)
_LIMITS = _U(1) << (_U(64) - np.arange(1, LEVELS + 1, dtype=_U))


def _cutting(encoding: str, n: int) -> bytes:
    """Byte table that leaves the characters of terms and makes blanks of the rest."""
    return bytes(c if _TERM.fullmatch(bytes([c]).decode(encoding)) else 32 for c in range(n)).ljust(256, b" ")


_ASCII, _LATIN = _cutting("ascii", 128), _cutting("latin-1", 256)


def terms(text: str | None) -> set[bytes]:
    """Distinct terms (runs of letters and digits, folded) in UTF-8."""
    if not text:
        return set()
    text = text.lower()
    if text.isascii():
        return set(text.encode().translate(_ASCII).split())
    try:
        cut = text.encode("latin-1").translate(_LATIN)
    except UnicodeEncodeError:
        return {w.encode() for w in _TERM.findall(text)}
    return set(cut.decode("latin-1").encode().split())


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # document frequencies of this task's rows, summed before they are shuffled
    def out(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(_hash(n).view(np.int64)), pa.array(list(n.values()), pa.int32())], names=["term", "df"]
        )

    n: Counter = Counter()
    for batch in batches:
        for t in batch.column("text"):
            n.update(terms(t.as_py()))
            if len(n) > _FLUSH:
                yield out(n)
                n.clear()
    if n:
        yield out(n)


def lexicon(docs: DataFrame, n_docs: int, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> DataFrame:
    """(term): hashes of the terms of the band, over all documents."""
    low, high = max(2, math.ceil(n_docs * math.exp(-max_idf))), n_docs * math.exp(-min_idf)
    counts = docs.select("text").mapInArrow(_count_terms, "term long, df int")
    held = counts.groupBy("term").agg(F.sum("df").alias("df"))
    return held.filter((F.col("df") >= low) & (F.col("df") <= high)).select("term")


def _hash(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def _held(text: str, lex: np.ndarray | None) -> np.ndarray:
    """Sorted hashes a text is fingerprinted by: its terms of the (sorted)
    lexicon, else all its terms, else its characters. No lexicon: all terms."""
    found = terms(text)
    h = np.sort(_hash(found if found else [text]))
    if lex is None or not len(lex):
        return h
    inside = h[lex[np.minimum(np.searchsorted(lex, h), len(lex) - 1)] == h]
    return inside if len(inside) else h


def slots(h: np.ndarray) -> list[int]:
    """Slots of the sorted term hashes ``h``, 20 bits each: the number of terms
    and the hash of their list, the sum of the terms each mixed with its place."""
    # subset j of a chain keeps the terms whose mixed hash begins with j zero
    # bits: the first ones of the chain's own sorted list
    lists = np.concatenate([h[None, :], np.sort(_mix(h[None, :] ^ _SEEDS[:, None]), axis=1)])
    sums = np.cumsum(_mix(lists ^ (np.arange(1, len(h) + 1, dtype=_U) * _PLACE)[None, :]), axis=1, dtype=_U)
    held = np.stack([np.searchsorted(chain, _LIMITS) for chain in lists[1:]])
    value = _mix(np.take_along_axis(sums[1:], np.maximum(held - 1, 0), axis=1)) & _U(0xFFFF)
    value = np.where(held > 0, np.minimum(held, 15) << 16 | value.astype(np.int64), 0)
    whole = min(len(h), 15) << 16 | int(_mix(sums[:1, -1])[0] & _U(0xFFFF))
    return [whole, *value.ravel().tolist()]


_PRINTED = "%05x" * SLOTS


def printed(held: list[int]) -> str:
    """A fingerprint as text."""
    return _PRINTED % tuple(held)


def likeness(a: list[list[int]], b: list[list[int]]) -> np.ndarray:
    """The share of terms in common that best explains which slots of ``a[k]``
    and ``b[k]`` are equal: rho with  sum of n over equal slots = sum of
    n rho^n / (1 - rho^n) over unequal ones, n the terms of a slot (of the two
    the larger number). Slots empty on both sides say nothing."""
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    n = np.maximum(x, y) >> 16
    row = np.arange(len(x))[:, None] * 16
    size = 16 * len(x)
    equal = np.bincount((row + n)[x == y], minlength=size).reshape(-1, 16)
    unequal = np.bincount((row + n)[x != y], minlength=size).reshape(-1, 16)
    n = np.arange(16)
    want = equal @ n
    low, high = np.zeros(len(x)), np.ones(len(x))
    for _ in range(40):
        rho = (low + high) / 2
        p = rho[:, None] ** n[None, 1:]
        over = (unequal[:, 1:] * n[None, 1:] * p / (1 - p)).sum(axis=1) > want
        low, high = np.where(over, low, rho), np.where(over, rho, high)
    return np.round(np.where(want == 0, 0.0, np.where(unequal.sum(axis=1) == 0, 1.0, (low + high) / 2)), 6)


def _packed(texts: list[str]) -> pa.Array:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pa.array([squeeze(t.encode()) for t in texts], pa.binary())


def _unpacked(column: pa.Array) -> list[str]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(x).decode() for x in column.to_pylist()]


def _dealt(firsts: list[int]):
    """Rows to the range of their doc_id; the first of a range also goes, as a
    ghost, to the end of the range before it (of the first range: the last).
    ``firsts`` are the least doc_ids of the ranges. Rows without a doc_id are
    dealt out one by one to as many ranges of their own."""
    edges, n = np.array(firsts, np.int64), len(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ids = batch.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                at = np.clip(np.searchsorted(edges, ids, side="right") - 1, 0, max(n - 1, 0))
                at = np.where(null, n + (turn + np.arange(len(ids))) % (n + 1), at)
                turn += len(ids)
                ghost = np.flatnonzero(~null & (edges[at % n] == ids)) if n else np.zeros(0, np.int64)
                rows = np.concatenate([np.arange(len(ids)), ghost])
                to = np.concatenate([at, (at[ghost] - 1) % max(n, 1)])
                texts = [t or "" for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to.astype(np.int32)),
                        pa.array(np.arange(len(rows)) >= len(ids)),
                        batch.column("doc_id").take(pa.array(rows)),
                        _packed([texts[r] for r in rows.tolist()]),
                    ],
                    names=["range", "ghost", "doc_id", "text"],
                )

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(range, ghost, doc_id, text) as sorted, rows of one doc_id by their text."""

    def rows():
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("range", "ghost", "doc_id"))
            yield from zip(*columns, _unpacked(batch.column("text")), strict=True)

    for (place, ghost, i), same in groupby(rows(), key=lambda r: r[:3]):
        if i is None:
            yield from same
        else:
            yield from sorted(same, key=lambda r: r[3])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, edited text, next document's text or None) of every document."""
    before = None
    for row in chain(_in_order(batches), [None]):
        if row is not None and row[1] and (before is None or before[0] != row[0]):
            continue  # a further copy of the next document
        if before is not None:
            place, _, i, text = before
            after = row[3] if row is not None and row[0] == place and i is not None else None
            k = len(text) // 4
            yield i, text, text[: len(text) - k] + (after[:k] if after else ""), after
        before = None if row is None or row[1] else row


def _by(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    while part := list(islice(rows, size)):
        yield part


_MARKED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    """Result rows from (doc_id, n_chars, sha, slots, edited slots, next slots or None)."""
    own = [r[3] for r in found]
    near_edited = likeness(own, [r[4] for r in found])
    near_next = likeness(own, [r[5] or r[3] for r in found])
    columns = list(zip(*[(*r[:3], printed(r[3]), printed(r[4])) for r in found], strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
        + [pa.array(near_edited), pa.array([x if r[5] else None for x, r in zip(near_next.tolist(), found, strict=True)], pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _marked(words):
    """Fingerprints by a broadcast lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        last = (None, [])  # a document's text is its predecessor's next one
        for rows in _by(_neighbours(batches), 512):
            out = []
            for i, text, edited, after in rows:
                mark = last[1] if text is last[0] else slots(_held(text, known))
                other = mark if edited == text else slots(_held(edited, known))
                near = None
                if after is not None:
                    near = mark if after == text else slots(_held(after, known))
                    last = (after, near)
                out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, other, near))
            yield _rows(out)

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document's three texts (own, edited, next) as all their term hashes,
    for a lexicon that is joined."""
    for part in _by(_neighbours(batches), 64):
        lists = [_held(t, None).view(np.int64) if t is not None else None for r in part for t in r[1:]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in part], pa.int64()),
                pa.array([len(r[1]) for r in part], pa.int64()),
                pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in part]),
                *[pa.array(lists[c::3], pa.list_(pa.int64())) for c in range(3)],
            ],
            names=["doc_id", "n_chars", "sha", "own", "edited", "next"],
        )


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            marks = [slots(np.sort(np.array(r[c], np.int64).view(_U))) if r[c] is not None else None for c in ("own", "edited", "next")]
            rows.append((r["doc_id"], r["n_chars"], r["sha"], *marks))
        if rows:
            yield _rows(rows)


def _by_join(spark: SparkSession, ordered: DataFrame, words: DataFrame) -> DataFrame:
    """Fingerprints by a lexicon too large to broadcast: term hashes meet it in
    a shuffle; a text none of whose terms do keeps all of them."""
    lists = ordered.mapInArrow(
        _listed, "doc_id long, n_chars long, sha string, own array<long>, edited array<long>, next array<long>"
    ).withColumn("row", F.monotonically_increasing_id())
    lists = written(spark, lists, "lists")
    out = lists
    for c in ("own", "edited", "next"):
        inside = lists.select("row", F.explode(c).alias("term")).join(words, "term", "left_semi")
        inside = inside.groupBy("row").agg(F.collect_list("term").alias("inside"))
        out = out.join(inside, "row", "left").withColumn(c, F.coalesce("inside", c)).drop("inside")
    return out.drop("row").mapInArrow(_fingerprinted, _MARKED)


def _ranges(docs: DataFrame, chars: int) -> list[int]:
    """Least doc_id of each range of about :data:`RANGE_CHARS` characters, exactly:
    quantiles are doubles and only deal the ids out."""
    n = max(1, -(-chars // RANGE_CHARS))
    cuts = [i / n for i in range(1, n)]
    edges = np.array(sorted({int(x) for x in docs.stat.approxQuantile("doc_id", cuts, 0.1 / n)}) if n > 1 else [], np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(batch.column("doc_id").to_numpy())
            at, first = np.unique(np.searchsorted(edges, ids, side="right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids[first])], names=["range", "first"])

    firsts = docs.filter("doc_id is not null").select("doc_id").mapInArrow(least, "range long, first long")
    return sorted(r["first"] for r in firsts.groupBy("range").agg(F.min("first").alias("first")).collect())


def edited_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, which ends in the
    beginning of the next document (see the query's contract)."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    words = written(spark, lexicon(docs, size["n"]), "lexicon")
    firsts = _ranges(docs, size["chars"] or 0)
    dealt = docs.mapInArrow(_dealt(firsts), "range int, ghost boolean, doc_id long, text binary")
    ordered = dealt.repartitionById(2 * len(firsts) + 1, F.col("range")).sortWithinPartitions("range", "ghost", "doc_id")
    if words.count() > BROADCAST_TERMS:
        return _by_join(spark, ordered, words)
    terms_ = np.sort(words.toPandas()["term"].to_numpy(np.int64).view(_U))
    return ordered.mapInArrow(_marked(spark.sparkContext.broadcast(terms_)), _MARKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark, table(spark, sf_dir, "documents"))
