"""SimHash components against all pairs, and the parts of the method one by one."""

import random
from itertools import product

import numpy as np
import pytest
import xxhash

from tests.llm.fixtures import EDGES, SF, docs, prose
from tickvault.llm import jaccard_join, registry, simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + 4] for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64(b" ".join(g), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, tau=4):
    """Least index reachable from each, over all pairs."""
    lead = list(range(len(prints)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= tau:
                a, b = sorted((find(i), find(j)))
                lead[b] = a
    return [find(i) for i in range(len(prints))]


def flip(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(rng, n=160):
    """Chains, dense balls, far pairs, prints of few bits."""
    out = {0, 1, 3, (1 << 64) - 1}
    for _ in range(n):
        centre = rng.getrandbits(64)
        out.add(centre)
        for _ in range(rng.randrange(4)):
            centre = flip(rng, centre, rng.randrange(1, 7))
            out.add(centre)
    middle = rng.getrandbits(64)
    out |= {flip(rng, middle, rng.randrange(1, 6)) for _ in range(120)}
    out |= {sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(60)}
    return sorted(out)


def check_linked(spark, prints, m=None, tau=4):
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(4)
    got = {r.fp: r.comp for r in simhash.linked(spark, nodes, tau, m).collect()}
    lead = plain_components(prints, tau)
    assert len(got) == len(prints)
    of = {}
    for p, k in zip(prints, lead, strict=True):
        of.setdefault(k, set()).add(signed(p))
    for members in of.values():
        assert {got[f] for f in members} == {min(members)}


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_no_link_is_lost_with_any_number_of_partitions(spark, m):
    check_linked(spark, clusters(random.Random(m)), m)


@pytest.mark.parametrize("tau", [0, 1, 3])
def test_other_distances(spark, tau):
    check_linked(spark, clusters(random.Random(9), 60), tau=tau, m=2)


def test_buckets_of_several_slices(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 5)
    monkeypatch.setattr(simhash, "HUBS", 1)
    check_linked(spark, clusters(random.Random(21)), 4)


def test_any_units_that_add_up_find_every_pair():
    rng = random.Random(3)
    parts = [list(range(0, 20)), list(range(20, 50)), list(range(50, 64))]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = flip(rng, a, rng.randrange(0, 5))
        for units in product(range(6), repeat=3):
            if sum(units) == 5:
                away = [bin((a ^ b) & sum(1 << x for x in p)).count("1") for p in parts]
                assert any(d <= u - 1 for d, u in zip(away, units, strict=True))


def test_allocation_is_the_cheapest():
    rng = np.random.default_rng(1)
    costs = rng.random((50, 4, 6)).cumsum(axis=2)
    costs[:, :, 0] = 0
    got = simhash.allocate(costs, 5)
    assert (got.sum(axis=1) == 5).all()
    for q in range(50):
        least = min(sum(costs[q, i, e] for i, e in enumerate(u)) for u in product(range(6), repeat=4) if sum(u) == 5)
        assert np.isclose(sum(costs[q, i, e] for i, e in enumerate(got[q])), least)


def test_spheres_count_exactly():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 1 << 7).astype(float)
    got = simhash.spheres(counts, 7, 4)
    v = np.arange(1 << 7)
    away = np.bitwise_count((v[:, None] ^ v[None, :]).view(np.uint64))
    for r in range(5):
        assert np.allclose(got[r], (away == r) @ counts)


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_correlated_bits_share_a_partition(m):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (4000, 64))
    for a, b in ((3, 60), (10, 41), (17, 33)):
        x[:, b] = x[:, a]
    x[:, 5] = 0  # a bit that never changes
    parts = simhash.group_bits((x.T @ x).astype(float), len(x), m)
    assert sorted(sum(parts, [])) == list(range(64))
    assert {len(p) for p in parts} <= {64 // m, 64 // m + 1}
    for a, b in ((3, 60), (10, 41), (17, 33)):
        assert any(a in p and b in p for p in parts)


def test_a_frequent_value_is_given_no_units():
    n = 20_000
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, n, dtype=np.int64) << 1
    fp[: n // 3] = (fp[: n // 3] >> 16 << 16) | 0x5A5A
    parts = [list(range(16 * i, 16 * i + 16)) for i in range(4)]
    counted = []
    for p in parts:
        counts = np.bincount(simhash.values_of(fp, p), minlength=1 << 16)
        counted.append([(p, simhash.spheres(counts, 16, 4))])
    plan = simhash.Plan(parts, n, 4, counted, [(np.zeros(0, np.int64), np.zeros(0))] * 4)
    units = plan.units(fp[:100])
    assert (units[:, 0] == 0).all() and (units.sum(axis=1) == 5).all()
    assert (plan.units(fp[-100:])[:, 0] > 0).any()


def test_partitions_get_fewer_as_fingerprints_grow():
    counts = [simhash.part_count(n) for n in (0, 10**3, 10**5, 10**6, 10**8, 10**10)]
    assert counts == sorted(counts, reverse=True) and counts[0] == 5 and counts[-1] == 2


def test_documents_against_all_pairs(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for k in range(40):
        text = prose(rng, rng.choice([1, 2, 3, 4, 6, 40, 400]))
        rows.append((1000 - 7 * k, text))
        words = text.split()
        for c in range(rng.randrange(3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(["THE", "of", "new"])
            rows.append((2000 + 10 * k + c, "  ".join(copy).upper()))
    rows += EDGES
    registry.importable(spark)
    got = simhash.simhash_components(spark, docs(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = sorted({plain_print(t) for d, t in rows if d is not None})
    lead = dict(zip(prints, plain_components(prints), strict=True))
    least = {}
    for d, t in rows:
        if d is not None:
            k = lead[plain_print(t)]
            least[k] = min(least.get(k, d), d)
    want = sorted((str(d), signed(plain_print(t)), None if d is None else least[lead[plain_print(t)]]) for d, t in rows)
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in got) == want
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    again = registry.QUERIES["op11_simhash"](spark, str(tmp_path)).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in again) == sorted((d, f"{f % (1 << 64):016x}", c) for d, f, c in want)
    assert simhash.simhash_components(spark, docs(spark, rows).limit(0)).count() == 0


def test_no_side_is_broadcast_by_its_estimated_size(spark, monkeypatch):
    # all of these are small here; Spark takes a probe list to be as small as its fingerprints' file at any size
    plans, written = [], simhash.written

    def seen(spark, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(spark, df, name)

    monkeypatch.setattr(simhash, "written", seen)
    monkeypatch.setattr(jaccard_join, "written", seen)
    monkeypatch.setattr(jaccard_join, "BROADCAST_LABELS", -1)
    rng = random.Random(23)
    texts = [prose(rng, 30) for _ in range(20)]
    got = simhash.simhash_components(spark, docs(spark, list(enumerate(texts * 2))))
    rows = {r.doc_id: r.component_id for r in got.collect()}
    assert all(rows[k] == rows[k + 20] for k in range(20))
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert {"asked", "members", "known", "edges", "labels", "comp", "result"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
    assert sum("SortMergeJoin" in plan for _, plan in plans) > 5


def test_query_on_the_given_table(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op11_simhash"](spark, SF).collect()}
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: plain_print(r.text) for r in given if len(r.text or "") < 20_000}
    assert all(got[d].fingerprint == f"{p:016x}" for d, p in prints.items())
    order = sorted(got)
    lead = plain_components([int(got[d].fingerprint, 16) for d in order])
    assert [got[d].component_id for d in order] == [order[k] for k in lead]
