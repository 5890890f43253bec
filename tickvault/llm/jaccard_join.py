"""N-gram Jaccard join with token-combination prefixes.

Documents link when the Jaccard similarity of their word-shingle sets reaches a
threshold. No link is lost, no pair is enumerated within a group, and no bucket
is capped:

1. *Extended prefixes.* A document's ``E + k`` smallest shingle hashes (``E`` =
   shingles it may lack) share at least ``k`` with those of any linked
   document, so documents with fewer repeated shingles there drop out. Each
   task counts its own shingles first, so a shingle is shipped once a task,
   however many documents hold it.
2. The few documents left are read again as whole sets. Shingles are ordered by
   document frequency; a document whose unique shingles exceed ``E`` drops out.
3. *Token combinations.* The prefix of that order is indexed: rare shingles one
   by one, frequent ones (over :data:`RARE`) as pairs within hash classes, the
   prefix lengthened by what pairing costs, so that two linked documents still
   share an entry (pigeonhole per class).
4. In a few rounds each document is verified against one hub of the buckets it
   is in (the most original document, then one drawn by hash) and components of
   the links are formed; then only pairs across components are verified, and of
   a bucket's largest component none among itself. An odd sketch (parities of
   hash classes) bounds the difference of two sets from below, so pairs that
   cannot link end inside the join.

Verification compares whole sets. Equal sets are one node throughout. Shingles
and set keys are compared by 64 and 128 bit hashes.

Defined results: a null or blank text has no shingles, n_shingles 0 and itself
as component; a null doc_id has component null and links with nothing; repeated
rows are equal sets; an empty table gives no rows; texts of any length are read
whole. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import shuffled, table, written

SHINGLE = 4
PERCENT = 85
#: Shingles in at most this many sets are indexed alone.
RARE = 32
#: Rounds against hubs drawn by hash, after the one against the most original set.
ROUNDS = 2
#: Bits of a set's odd sketch (four longs).
SKETCH = 256
#: A side of at most this many ids (8 bytes each) is broadcast, else shuffled.
BROADCAST_IDS = 1_000_000
#: Labels (two longs, about 100 bytes each as a hash table) of more nodes than
#: this are joined by shuffle, whatever Spark takes their files to hold.
BROADCAST_LABELS = 100_000
_VOCABULARY = 1_500_000
_FLUSH = 2_000_000

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingle_sets(texts: list[bytes | None], words: _Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each UTF-8 text; ASCII is folded, and
    words are cut at ASCII blanks (what ``bytes`` methods do)."""
    if len(words) > _VOCABULARY:
        words.clear()
    cut = [t.lower().split() if t else [] for t in texts]
    ends = np.cumsum([len(w) for w in cut])
    a = np.fromiter((words[w] for ws in cut for w in ws), _U, int(ends[-1]) if len(cut) else 0)
    with np.errstate(over="ignore"):
        h = a.copy()
        for k, m in zip(range(1, size), (_M1, _M2, _M3) * size, strict=False):
            n = max(len(a) - k, 0)
            h = _mix(h[:n] * m + a[k : k + n])
        out, start = [], 0
        for end in ends.tolist():
            if end - start >= size:
                out.append(np.unique(h[start : end - size + 1]))
            elif end > start:
                short = _U(end - start)
                for x in a[start:end]:
                    short = _mix(np.array([short * _M2 + x]))[0]
                out.append(np.array([short], _U))
            else:
                out.append(a[:0])
            start = end
    return out


def _least_shared(n, percent: int = PERCENT):
    """Shingles of a set of ``n`` that a linked set must hold: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _extension(n: int, percent: int) -> int:
    # shared shingles to expect in an extended prefix; never decreases with n
    return min(_least_shared(n, percent), -(-n * 12 // 100) + 6)


def _prefix(n: int, percent: int) -> tuple[int, int]:
    """(length of the extended prefix, shingles it must share with any linked set)."""
    length = n - _least_shared(n, percent) + _extension(n, percent)
    return length, _extension(_least_shared(n, percent), percent)


def _key(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def _bytes(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for part in _parts(batches):
            sets = shingle_sets(_bytes(part), words, size)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(_short([_key(s) for s in sets])),
                ],
                names=["doc_id", "n", "key", "kid"],
            )

    return run


def _short(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<i8")


def _prefix_tokens(size: int, percent: int):
    """Rows (token, kid, w): a prefix token met once in the task with its set,
    and for each set the repeats found in the task itself minus those it needs."""

    def flush(kids: list[bytes], needs: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        flat = np.concatenate(tokens)
        distinct, first, back, n = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        repeats = np.bincount(owner, n[back] > 1, len(tokens)).astype(np.int64)
        kid = _short(kids)
        # a token met by several sets is shipped once, for others to see, with no set to credit
        to = np.where(n == 1, kid[owner[first]], 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([distinct.view(np.int64), kid])),
                pa.array(np.concatenate([to, kid])),
                pa.array(np.concatenate([np.where(n == 1, 1, 0), repeats - np.array(needs)]).astype(np.int64)),
                pa.array(np.concatenate([np.ones(len(distinct), bool), np.zeros(len(kid), bool)])),
            ],
            names=["token", "kid", "w", "is_token"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kids, needs, tokens, held, done = _Words(), [], [], [], 0, set()
        for part in _parts(batches):
            for s in shingle_sets(_bytes(part), words, size):
                length, need = _prefix(len(s), percent)
                if need < 2:
                    continue  # too small to link with anything but an equal set
                key = _key(s)
                kids.append(key)
                needs.append(need)
                tokens.append(s[:length])
                held += length
            if held > _FLUSH:
                yield flush(kids, needs, tokens)
                kids, needs, tokens, held = [], [], [], 0
        if kids:
            yield flush(kids, needs, tokens)

    return run


def _credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, w) of this partition's tokens that two rows or more hold (a row
    without a set stands for several), and of the rows that stand for sets; a
    partition holds a token at most once a map task, so its size is that of the
    shuffle partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    token, kid, w, is_token = (t.column(c).to_numpy() for c in ("token", "kid", "w", "is_token"))
    distinct, back, n = np.unique(token[is_token], return_inverse=True, return_counts=True)
    several = np.bincount(back, w[is_token] == 0, len(distinct)) > 0
    shared = ((n > 1) | several)[back] & (w[is_token] == 1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([kid[is_token][shared], kid[~is_token]])),
            pa.array(np.concatenate([np.ones(int(shared.sum()), np.int64), w[~is_token]])),
        ],
        names=["kid", "w"],
    )


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for part in _parts(batches, 64):
            sets = shingle_sets(_bytes(part), words, size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_key(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["key", "n", "tokens"],
            )

    return run


def _bands(n: int, percent: int) -> list[int]:
    """Size bands a set is indexed in; linked sets share the larger one's band."""
    b = n.bit_length() - 1
    return [b, b + 1] if 100 * n >= percent * (1 << (b + 1)) else [b]


def index_entries(n: int, df: np.ndarray, token: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> np.ndarray:
    """Index entries of one set: ``df``/``token`` are its repeated shingles in
    (df, token) order, the other ``n - len(token)`` are unique to it."""
    need = n - _least_shared(n, percent) + 1
    covered = n - len(token)
    if covered >= need:
        return np.zeros(0, np.int64)
    single = min(int(np.searchsorted(df, rare, side="right")), need - covered)
    out = [token[:single]]
    covered += single
    if covered < need:
        often = token[single:].view(_U)
        for band in _bands(n, percent):
            classes = max(1, (1 << band) // 64)
            cls = (_mix(often) % _U(classes)).astype(np.int64)
            # the k-th token of a class costs nothing at k = 0 and covers one from then on
            order = np.argsort(cls, kind="stable")
            starts = np.searchsorted(cls[order], cls[order], side="left")
            nth = np.empty(len(cls), np.int64)
            nth[order] = np.arange(len(cls)) - starts
            stop = int(np.searchsorted(np.cumsum(nth > 0), need - covered)) + 1
            held = often[:stop]
            for c in np.unique(cls[:stop]):
                x = held[cls[:stop] == c]
                if len(x) > 1:
                    i, j = np.triu_indices(len(x), 1)
                    with np.errstate(over="ignore"):
                        out.append(_mix(_mix(np.minimum(x[i], x[j]) * _M1 + np.maximum(x[i], x[j])) + _U(band) * _M2).view(np.int64))
    return np.concatenate(out)


def odd_sketch(token: np.ndarray) -> np.ndarray:
    """Parities of :data:`SKETCH` hash classes as longs: two sketches differ in
    at most as many bits as the sets have elements apart."""
    odd = np.bincount((_mix(token.view(_U)) % _U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


_SKETCH_COLS = [f"s{k}" for k in range(SKETCH // 64)]


def _entries(percent: int, rare: int):
    """Rows of the index (entry, node, n, own), and one row a set without entry
    but with its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 16):
            rows, sketches = [], []
            for node, n, shared in zip(*(part.column(c) for c in ("node", "n", "shared")), strict=True):
                s = shared.values
                df, token = s.field("df").to_numpy(), s.field("token").to_numpy()
                order = np.lexsort((token, df))
                entries = index_entries(n.as_py(), df[order], token[order], percent, rare)
                if len(entries):
                    rows.append((node.as_py(), n.as_py(), n.as_py() - len(token), entries))
                    sketches.append(odd_sketch(token))
            if not rows:
                continue
            count = [len(r[3]) for r in rows]
            held = sum(count)
            columns = [pa.array(np.concatenate([r[3] for r in rows]).tolist() + [None] * len(rows), pa.int64())]
            for k in range(3):
                each = np.array([r[k] for r in rows], np.int64)
                columns.append(pa.array(np.concatenate([np.repeat(each, count), each])))
            for k in range(len(_SKETCH_COLS)):
                columns.append(pa.array([None] * held + [int(s[k]) for s in sketches], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["entry", "node", "n", "own", *_SKETCH_COLS])

    return run


def _may_link(n1: Column, n2: Column, apart: Column, percent: int) -> Column:
    """Sizes within the threshold, and ``apart`` elements (those unique to either
    side, at least) within the difference that linked sets of these sizes can have."""
    sizes = (F.lit(100) * n1 >= F.lit(percent) * n2) & (F.lit(100) * n2 >= F.lit(percent) * n1)
    return sizes & (apart * F.lit(100 + percent) <= (n1 + n2) * F.lit(100 - percent))


def _apart(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Lower bound of the elements two sets do not share."""
    total = x["own"] + y["own"]
    for s in _SKETCH_COLS:
        total = total + F.bit_count(x[s].bitwiseXOR(y[s]))
    return total


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), by their whole sets."""
    one, two = sets.select("node", "n", "tokens"), sets.select("node", "n", "tokens")
    both = pairs.join(one.toDF("a", "na", "ta"), "a").join(two.toDF("b", "nb", "tb"), "b")
    shared = F.size(F.array_intersect("ta", "tb")).cast("long")
    linked = F.lit(100) * shared >= F.lit(percent) * (F.col("na") + F.col("nb") - shared)
    return both.filter(linked).select("a", "b")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable, by label propagation with pointer
    jumping; every round is written to the shared folder."""
    both = written(spark, edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    side = shuffled if labels.count() > BROADCAST_LABELS else lambda df: df
    while True:
        near = both.join(side(labels), both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        met = labels.join(side(near), labels["node"] == near["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("up"), F.col("comp").alias("upper"))
        jumped = met.join(side(up), met["comp"] == up["up"], "left").select("node", "old", F.least("comp", "upper").alias("comp"))
        new = written(spark, jumped, "labels")
        if new.filter("comp <> old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _candidate_sets(spark: SparkSession, docs: DataFrame, sizes: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, key, n, tokens): whole sets of what extended prefixes leave, one row a set."""
    rows = docs.select("text").mapInArrow(
        _prefix_tokens(size, percent), "token long, kid long, w long, is_token boolean"
    )
    credit = rows.repartition("token").mapInArrow(_credit, "kid long, w long")
    left = credit.groupBy("kid").agg(F.sum("w").alias("w")).filter("w >= 0").select("kid")
    held = sizes.filter("n > 0").join(left, "kid", "left_semi")
    keys = written(spark, held.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "keys")
    ids = keys.select("doc_id").distinct()
    ids = F.broadcast(ids) if keys.count() <= BROADCAST_IDS else ids
    again = docs.join(ids, "doc_id", "left_semi").select("text")
    sets = again.mapInArrow(_whole_sets(size), "key binary, n long, tokens array<long>")
    # a doc_id may carry other texts too: keep the wanted sets, each once
    sets = sets.join(keys.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return written(spark, sets.withColumn("node", F.monotonically_increasing_id()), "sets")


def _index(spark: SparkSession, sets: DataFrame, percent: int, rare: int) -> DataFrame:
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    shared = tokens.join(df, "token").groupBy("node", "n").agg(
        F.collect_list(F.struct(F.col("df"), F.col("token"))).alias("shared")
    )
    shared = shared.filter(F.size("shared") * 100 >= F.lit(percent) * F.col("n"))
    columns = "entry long, node long, n long, own long, " + ", ".join(f"{s} long" for s in _SKETCH_COLS)
    return written(spark, shared.mapInArrow(_entries(percent, rare), columns), "index")


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _best_hub(near: DataFrame) -> DataFrame:
    """(a, b): each set with the hub it shares most buckets with."""
    best = near.groupBy("node", F.col("h.node").alias("hub")).agg(F.count("*").alias("c"))
    first = best.groupBy("node").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    return first.select(F.col("node").alias("a"), F.col("hub").alias("b"))


def links(spark: SparkSession, sets: DataFrame, percent: int = PERCENT, rare: int = RARE) -> DataFrame:
    """(node, comp) of all sets that link with another one."""
    both = _index(spark, sets, percent, rare)
    index = both.filter("entry is not null").select("entry", "node", "n", "own")
    sketches = both.filter("entry is null").select("node", *_SKETCH_COLS)
    # hubs: of each bucket the set with the fewest shingles of its own
    hub = index.groupBy("entry").agg(
        F.min(F.struct("own", "node", "n")).alias("h"), F.count("*").alias("held")
    ).filter("held > 1")
    near = index.join(hub, "entry").filter(
        (F.col("node") != F.col("h.node")) & _may_link(F.col("n"), F.col("h.n"), F.col("own") + F.col("h.own"), percent)
    )
    tried = written(spark, _best_hub(near), "hubs")
    found = written(spark, _verified(tried, sets, percent), "links")
    comp = components(spark, found)
    # from here on only buckets that still hold several components
    known = _with_comp(index, comp)
    mixed = known.groupBy("entry").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    open_ = index.join(mixed.select("entry"), "entry", "left_semi").join(sketches, "node")
    open_ = written(spark, open_, "open")
    cols = ["node", "n", "own", "comp", *_SKETCH_COLS]
    for k in range(1, ROUNDS + 1):
        known = _with_comp(open_, comp)
        drawn = F.struct(F.xxhash64("node", "entry", F.lit(k)).alias("draw"), *cols)
        hub = known.groupBy("entry").agg(F.min(drawn).alias("h"))
        near = known.join(hub, "entry").filter(
            (F.col("comp") != F.col("h.comp"))
            & _may_link(F.col("n"), F.col("h.n"), _apart({c: F.col(c) for c in cols}, {c: F.col(f"h.{c}") for c in cols}), percent)
        )
        pairs = written(spark, _best_hub(near), "hubs")
        found = written(spark, found.union(_verified(pairs, sets, percent)), "links")
        tried = tried.union(pairs)
        comp = components(spark, found)
    known = _with_comp(open_, comp)
    by = known.groupBy("entry", "comp").agg(F.count("*").alias("c"))
    top = by.groupBy("entry").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    mixed = written(spark, known.join(top.select("entry", "top"), "entry"), "mixed")
    x = mixed.filter("comp <> top").select("entry", *[F.col(c).alias(f"{c}1") for c in cols])
    y = mixed.select("entry", "top", *[F.col(c).alias(f"{c}2") for c in cols])
    apart = _apart({c: F.col(f"{c}1") for c in cols}, {c: F.col(f"{c}2") for c in cols})
    cross = x.join(y, "entry").filter(
        (F.col("comp1") != F.col("comp2"))
        & ((F.col("comp2") == F.col("top")) | (F.col("node1") < F.col("node2")))
        & _may_link(F.col("n1"), F.col("n2"), apart, percent)
    )
    pairs = cross.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    # without what the rounds have verified
    seen = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(spark, pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
    more = _verified(pairs, sets, percent)
    return components(spark, written(spark, found.union(more), "links"))


def jaccard_components(
    spark: SparkSession, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rare: int = RARE
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    sizes = written(spark, docs.mapInArrow(_sizes(size), "doc_id long, n long, key binary, kid long"), "sizes")
    real = docs.filter("doc_id is not null")
    sets = _candidate_sets(spark, real, sizes.filter("doc_id is not null"), size, percent)
    comp = links(spark, sets, percent, rare)
    # smallest doc_id of each set, then of each component of sets
    least = sizes.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    linked = sets.select("key", "node").join(comp, "node").select("key", "comp")
    of_key = least.join(linked, "key", "left")
    of_comp = of_key.filter("comp is not null").groupBy("comp").agg(F.min("least").alias("lowest"))
    named = of_key.join(of_comp, "comp", "left").select("key", F.coalesce("lowest", "least").alias("component"))
    return sizes.join(named, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (shingles of five
    words, similarity of 0.8 or more) the document with the smallest doc_id
    stays; documents without text or without doc_id stay, and so do all rows of
    the doc_id that stays."""
    same = jaccard_components(spark, docs, size=5, percent=80)
    first = same.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").select(docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))
