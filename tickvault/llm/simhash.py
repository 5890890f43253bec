"""SimHash near-duplicates by the generalised pigeonhole principle.

Documents link when their 64 bit SimHash fingerprints differ in at most tau
bits; components of the links are returned. No link is lost:

1. *Correlated bits together.* The 64 bits are grouped into m partitions, bits
   that go with each other in the same one (greedy, by the correlations of all
   distinct fingerprints), so that partitions are nearly independent.
2. *Unequal thresholds.* Partition i is given e_i >= 0 units, e_1 + .. + e_m =
   tau + 1, and is searched for values within e_i - 1 bits (0 units: not at
   all). Two fingerprints within tau bits cannot differ by e_i or more bits in
   every partition, so one search finds the pair, whatever the units: each
   fingerprint takes those of least estimated cost, by dynamic programming over
   the partitions. Estimates come from counts of the values of partition pieces
   of up to 16 bits, summed over Hamming spheres, and from the partition values
   that a 256th of all fingerprints or more hold; they steer cost only.
3. *Probe and verify.* An index maps (partition, value) to fingerprints; each
   fingerprint probes the values within its thresholds and keeps those within
   tau bits. The number of partitions is the one of least estimated total cost.

Dense groups are not paired out: equal fingerprints are one node, every bucket
of the index is first linked to a few of its members drawn by hash, and probes
then meet only members of other components; a bucket's largest component is met
by outsiders only. Large buckets are dealt into slices.

Every join is by shuffle: all sides grow with the table, and Spark, which takes
a probe list to be hardly larger than its fingerprints, would broadcast it.

Defined results: a null, empty or blank text has fingerprint zero, which links
like any other; a null doc_id gets a fingerprint, links with nothing and has a
null component; repeated rows have equal fingerprints; an empty table gives no
rows; only doc_id and text are read, so other columns cannot clash. Whole texts
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvault.llm.common import shuffled, table, written
from tickvault.llm.jaccard_join import components

BITS = 64
TAU = 4
SHINGLE = 4
SEED = 42
#: Cost of one probed value, in verified pairs: a probe is shuffled, sorted and
#: joined (1 microsecond measured), a pair is compared inside the join (50 ns).
PROBE_COST = 20.0
#: Members a bucket is first linked to.
HUBS = 3
#: Values held by this share of all fingerprints are counted exactly.
HOT_SHARE = 256
#: Fingerprints of a bucket that one slice holds, on average.
SLICE = 2048
_PIECE = 16


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; A-Z are folded, words are
    cut at ASCII blanks (what ``bytes`` methods do)."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(line[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in more than half of the hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    chosen = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(chosen, bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = part.column("text").cast(pa.binary())
                out = np.array([majority(shingle_hashes(t.as_py(), size)) for t in texts], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"]
                )

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row: the 64 bits as a long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(size), "doc_id long, fp long")


# ---------------------------------------------------------------- partitions

def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bits of one of ``width`` bits."""
    return sum(comb(width, r) for r in range(radius + 1))


def part_count(n: int, tau: int = TAU) -> int:
    """Partitions of least cost for ``n`` evenly spread fingerprints."""

    def cost(m: int) -> float:
        width, total = BITS // m, 0.0
        for i in range(m):
            units = (tau + 1) // m + (i < (tau + 1) % m)
            if units:
                total += ball(width, units - 1) * (PROBE_COST + n / 2.0**width)
        return total

    return min(range(2, tau + 2), key=cost)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` groups of the 64 bits, equal in size but for one. ``both[i, j]``
    counts the fingerprints with bits i and j set: the most correlated bits are
    joined first, while their group still fits."""
    one = both.diagonal() / max(n, 1)
    spread = np.sqrt(one * (1 - one))
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = np.abs(both / max(n, 1) - np.outer(one, one)) / np.outer(spread, spread)
    rho = np.nan_to_num(rho, nan=0.0, posinf=0.0)
    room = [BITS // m + (i < BITS % m) for i in range(m)]
    group = {b: [b] for b in range(BITS)}
    i, j = np.triu_indices(BITS, 1)
    for k in np.argsort(-rho[i, j], kind="stable").tolist():
        a, b = group[int(i[k])], group[int(j[k])]
        if a is not b and len(a) + len(b) <= min(room):
            a.extend(b)
            for x in b:
                group[x] = a
    parts: list[list[int]] = [[] for _ in range(m)]
    for g in sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), g)):
        # whole where it fits, else split over the emptiest partitions
        rest = list(g)
        while rest:
            free = [room[p] - len(parts[p]) for p in range(m)]
            fits = [p for p in range(m) if free[p] >= len(rest)]
            p = min(fits, key=lambda p: free[p]) if fits else int(np.argmax(free))
            parts[p] += rest[: free[p]]
            rest = rest[free[p] :]
    return [sorted(p) for p in parts]


def values_of(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint as one number."""
    u = fp.view(np.uint64)
    out = np.zeros(len(u), np.uint64)
    for k, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.astype(np.int64)


def _pieces(bits: list[int]) -> list[list[int]]:
    if len(bits) <= _PIECE:
        return [bits]
    half = (len(bits) + 1) // 2
    return [bits[:half], bits[half:]]


def spheres(counts: np.ndarray, width: int, radius: int) -> np.ndarray:
    """``out[r, v]``: how many are exactly r bits from v, given ``counts[v]``."""
    out = np.zeros((radius + 1, 1 << width))
    out[0] = counts
    at = np.arange(1 << width)
    for r in range(radius):
        # each value at distance r + 1 is next to r + 1 values at distance r,
        # each one at distance r - 1 to the other width - r + 1
        around = sum(out[r][at ^ (1 << b)] for b in range(width))
        before = out[r - 1] * (width - r + 1) if r else 0
        out[r + 1] = (around - before) / (r + 1)
    return out


def _masks(width: int, radius: int) -> list[np.ndarray]:
    """Per distance, the numbers of ``width`` bits with that many set."""
    return [
        np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.int64) for r in range(radius + 1)
    ]


def allocate(costs: np.ndarray, units: int) -> np.ndarray:
    """Units per partition of least total cost, for many fingerprints at once.
    ``costs[q, i, e]`` is the cost of e units in partition i."""
    n, m, _ = costs.shape
    best = np.full((n, units + 1), np.inf)
    best[:, 0] = 0.0
    taken = np.zeros((m, n, units + 1), np.int64)
    for i in range(m):
        options = np.full((n, units + 1, units + 1), np.inf)
        for e in range(units + 1):
            options[:, e:, e] = best[:, : units + 1 - e] + costs[:, i, e, None]
        taken[i] = options.argmin(axis=2)
        best = options.min(axis=2)
    out, left, row = np.zeros((n, m), np.int64), np.full(n, units), np.arange(n)
    for i in reversed(range(m)):
        out[:, i] = taken[i][row, left]
        left = left - out[:, i]
    return out


@dataclass
class Plan:
    """Partitions of the bits and what is known of their values."""

    parts: list[list[int]]
    n: int
    tau: int
    #: per partition, per piece: (bits, spheres of the counts)
    counted: list[list[tuple[list[int], np.ndarray]]]
    #: per partition: frequent values, their counts
    hot: list[tuple[np.ndarray, np.ndarray]]

    def near(self, i: int, fp: np.ndarray) -> np.ndarray:
        """``[q, r]``: estimated fingerprints within r bits in partition i."""
        exact = None
        for bits, counts in self.counted[i]:
            one = counts[:, values_of(fp, bits)]
            if exact is None:
                exact = one
            else:  # pieces taken as independent
                exact = np.stack(
                    [sum(exact[s] * one[r - s] for s in range(r + 1)) / max(self.n, 1) for r in range(self.tau + 1)]
                )
        within = np.cumsum(exact, axis=0).T
        if len(self.counted[i]) > 1 and len(self.hot[i][0]):
            values, held = self.hot[i]
            away = np.bitwise_count((values_of(fp, self.parts[i])[:, None] ^ values[None, :]).view(np.uint64))
            often = np.stack([(away <= r) @ held for r in range(self.tau + 1)], axis=1)
            within = np.maximum(within, often)
        return within

    def units(self, fp: np.ndarray) -> np.ndarray:
        """Units each fingerprint gives each partition."""
        costs = np.zeros((len(fp), len(self.parts), self.tau + 2))
        for i, bits in enumerate(self.parts):
            probes = np.array([ball(len(bits), r) for r in range(self.tau + 1)])
            costs[:, i, 1:] = self.near(i, fp) + PROBE_COST * probes
        return allocate(costs, self.tau + 1)


def _keys(part: int, values: np.ndarray) -> np.ndarray:
    return values + (part << 32)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS))
    for batch in batches:
        bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 65536):
            x = bits[k : k + 65536].astype(np.float32)  # counts up to 65,536 are exact
            both += x.T @ x
    i, j = np.indices(both.shape)
    yield pa.RecordBatch.from_arrays(
        [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(both.ravel().astype(np.int64))], names=["i", "j", "c"]
    )


def _histograms(pieces: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(p), np.int64) for p in pieces]
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for c, p in zip(counts, pieces, strict=True):
                c += np.bincount(values_of(fp, p), minlength=len(c))
        for k, c in enumerate(counts):
            v = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(v), k)), pa.array(v), pa.array(c[v])], names=["piece", "v", "c"]
            )

    return run


def _index_keys(parts: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            keys = [_keys(i, values_of(fp, bits)) for i, bits in enumerate(parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.tile(fp, len(parts)))], names=["key", "fp"]
            )

    return run


def _probes(plan: Plan):
    """Rows (key, fp, comp): every value a fingerprint has to look up."""
    masks = [_masks(len(bits), plan.tau) for bits in plan.parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                fp, comp = part.column("fp").to_numpy(), part.column("comp").to_numpy()
                units = plan.units(fp)
                for i, bits in enumerate(plan.parts):
                    values = values_of(fp, bits)
                    for r in range(plan.tau + 1):
                        who = np.flatnonzero(units[:, i] > r)
                        if not len(who):
                            break
                        keys = _keys(i, (values[who][:, None] ^ masks[i][r][None, :]).ravel())
                        of = np.repeat(who, len(masks[i][r]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys), pa.array(fp[of]), pa.array(comp[of])], names=["key", "fp", "comp"]
                        )

    return run


def make_plan(nodes: DataFrame, tau: int = TAU, m: int | None = None) -> Plan:
    """Partitions and counts for distinct fingerprints ``nodes`` (fp). What
    reaches the driver is bounded: 64 x 64 bit counts, at most 65,536 counts a
    piece (six pieces at most), 256 frequent values a partition."""
    pair = nodes.mapInArrow(_together, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
    both = np.zeros((BITS, BITS))
    both[pair["i"], pair["j"]] = pair["c"]
    n = nodes.count()
    m = m or part_count(n, tau)
    parts = group_bits(both, n, m)
    pieces = [p for bits in parts for p in _pieces(bits)]
    hist = nodes.mapInArrow(_histograms(pieces), "piece long, v long, c long").groupBy("piece", "v").agg(F.sum("c").alias("c")).toPandas()
    counted: list[list[tuple[list[int], np.ndarray]]] = [[] for _ in parts]
    k = 0
    for i, bits in enumerate(parts):
        for p in _pieces(bits):
            counts = np.zeros(1 << len(p))
            rows = hist[hist["piece"] == k]
            counts[rows["v"].to_numpy()] = rows["c"].to_numpy()
            counted[i].append((p, spheres(counts, len(p), tau)))
            k += 1
    hot = [(np.zeros(0, np.int64), np.zeros(0))] * m
    if any(len(c) > 1 for c in counted):
        often = nodes.mapInArrow(_index_keys(parts), "key long, fp long").groupBy("key").agg(F.count("*").alias("c"))
        often = often.filter((F.col("c") > 1) & (F.col("c") * HOT_SHARE >= n)).toPandas()
        part = often["key"].to_numpy() >> 32
        value = often["key"].to_numpy() & 0xFFFFFFFF
        hot = [(value[part == i], often["c"].to_numpy()[part == i].astype(float)) for i in range(m)]
    return Plan(parts, n, tau, counted, hot)


# ---------------------------------------------------------------- linking

def _differ(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def linked(spark: SparkSession, nodes: DataFrame, tau: int = TAU, m: int | None = None) -> DataFrame:
    """(fp, comp) of distinct fingerprints ``nodes`` (fp): comp is the least
    fingerprint of those reachable over links of at most ``tau`` bits."""
    nodes = nodes.select("fp")
    plan = make_plan(nodes, tau, m)
    index = nodes.mapInArrow(_index_keys(plan.parts), "key long, fp long")

    # every bucket's members against a few of them
    drawn = [F.min(F.struct(F.xxhash64("fp", "key", F.lit(k)).alias("draw"), "fp"))["fp"] for k in range(HUBS)]
    hubs = index.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("hubs"), F.count("*").alias("held"))
    stars = index.join(shuffled(hubs.filter("held > 1")), "key").select("fp", F.explode("hubs").alias("hub"))
    near = stars.filter((F.col("fp") != F.col("hub")) & (_differ("fp", "hub") <= tau))
    first = components(spark, near.select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    known = nodes.join(shuffled(first.withColumnRenamed("node", "fp")), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"))
    known = written(spark, known, "known")

    # buckets: largest component, and how many slices the rest and the whole take
    index = known.mapInArrow(_index_keys(plan.parts), "key long, fp long").join(shuffled(known), "fp")
    by = index.groupBy("key", "comp").agg(F.count("*").alias("c"))
    buckets = by.groupBy("key").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("top"), F.sum("c").alias("held"), F.count("*").alias("k")
    )
    buckets = buckets.withColumn("slices", F.ceil(F.col("held") / SLICE).cast("int"))
    members = index.join(shuffled(buckets), "key").select(
        "key", "fp", "comp", (F.col("comp") == F.col("top")).alias("is_top"), F.pmod(F.xxhash64("fp"), "slices").cast("int").alias("slice")
    )
    members = written(spark, members, "members")
    asked = known.mapInArrow(_probes(plan), "key long, fp long, comp long").join(shuffled(buckets), "key")
    # a bucket of the asker's own component only has nothing to tell
    asked = asked.filter((F.col("k") > 1) | (F.col("comp") != F.col("top")))
    asked = asked.select(
        "key",
        F.col("fp").alias("fp1"),
        F.col("comp").alias("comp1"),
        (F.col("comp") != F.col("top")).alias("outside"),
        (F.col("k") > 1).alias("mixed"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
    )
    asked = written(spark, asked, "asked")
    pairs = []
    for top, who in ((True, "outside"), (False, "mixed")):
        met = asked.filter(who).join(shuffled(members.filter(F.col("is_top") == F.lit(top))), ["key", "slice"])
        met = met.filter((F.col("comp1") != F.col("comp")) & (_differ("fp1", "fp") <= tau))
        pairs.append(met.select(F.least("comp1", "comp").alias("a"), F.greatest("comp1", "comp").alias("b")))
    joined = components(spark, pairs[0].union(pairs[1]).distinct())
    joined = joined.select(F.col("node").alias("comp"), F.col("comp").alias("lower"))
    return known.join(shuffled(joined), "comp", "left").select("fp", F.coalesce("lower", "comp").alias("comp"))


def simhash_components(
    spark: SparkSession, docs: DataFrame, size: int = SHINGLE, tau: int = TAU, m: int | None = None
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text)."""
    prints = written(spark, fingerprints(docs, size), "fingerprints")
    real = prints.filter("doc_id is not null")
    nodes = written(spark, real.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comp = written(spark, linked(spark, nodes, tau, m), "comp")
    of_fp = nodes.join(shuffled(comp), "fp")
    of_comp = of_fp.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = of_fp.join(shuffled(of_comp), "comp").select("fp", "component_id")
    return prints.join(shuffled(named), "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_components(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
