"""N-gram Jaccard join and I-Match fingerprints against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.fixtures import EDGES, docs, prose
from tickvault.llm import imatch, jaccard_join


def components(rows, size, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        grams = list(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else [tuple(w)] * bool(w)
        sets.append((i, frozenset(grams)))
    ids = sorted({i for i, _ in sets if i is not None})
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i is None, i or 0, len(s), None if i is None else find(i)) for i, s in sets)


def near_copies(seed, n_groups, copies, words, edits):
    rng = random.Random(seed)
    rows, i = [], 0
    passage = prose(rng, 40)
    for g in range(n_groups):
        base = prose(random.Random((seed, g).__hash__()), words).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            i += 1
            rows.append((i, " ".join(w) + (" " + passage if rng.random() < 0.3 else "")))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent,rare", [(4, 85, 32), (4, 85, 2), (5, 80, 3)])
def test_join_equals_brute_force(spark, size, percent, rare):
    rows = near_copies(7, 6, 14, 90, 5) + [(1000 + i, t) for i, t in near_copies(8, 10, 4, 30, 2)]
    rows += [(2000 + i, "a b c d e f") for i in range(5)] + [(3000, "A b c d e f g"), (3001, "a b c"), (3002, "A B c"), (3003, "b")]
    rows += EDGES
    got = jaccard_join.jaccard_components(spark, docs(spark, rows), size, percent, rare).collect()
    seen = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got)
    assert seen == components(rows, size, percent)


def test_index_entries_share_one_for_every_link():
    rng = np.random.default_rng(5)
    for n in (6, 7, 20, 90, 140, 400):
        a = rng.integers(0, 2**62, n)
        b = a.copy()
        lost = int(n * 0.07)
        b[:lost] = rng.integers(0, 2**62, lost)
        if 100 * (n - lost) < 85 * (n + lost):
            continue
        df = {int(x): int(c) for x, c in zip(np.concatenate([a, b]), rng.integers(2, 90, 2 * n), strict=True)}
        sides = []
        for s in (a, b):
            x = np.array(sorted((df[int(t)], int(t)) for t in s))
            sides.append(set(jaccard_join.index_entries(n, x[:, 0], x[:, 1]).tolist()))
        assert sides[0] & sides[1]


def test_join_of_an_empty_table_and_stage(spark):
    assert jaccard_join.jaccard_components(spark, docs(spark, EDGES).limit(0)).count() == 0
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "other words stand here now and then"), (4, ""), (None, "x")]
    kept = jaccard_join.stage(spark, docs(spark, rows), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]


def plain_imatch(rows):
    """Lexicon, fingerprints and likeness of (doc_id, text) rows, straight from the rule."""
    def words(t):
        return set(re.findall(r"[^\W_]+", (t or "").lower()))

    df = Counter(w for _, t in rows for w in words(t))
    n = len(rows)
    low, high = max(2, math.ceil(n * math.exp(-math.log(2000)))), n * math.exp(-math.log(20))
    lex = {w for w, c in df.items() if low <= c <= high}

    def slots(t):
        held = words(t) & lex or words(t) or {t}
        hashes = sorted(xxhash.xxh3_64_intdigest(w) for w in held)
        out = [hashes]
        for seed in imatch._SEEDS.tolist():
            mixed = sorted(int(imatch._mix(np.array([h ^ seed], np.uint64))[0]) for h in hashes)
            out += [[m for m in mixed if m < 1 << (64 - j)] for j in range(1, imatch.LEVELS + 1)]
        return [(len(x), x) for x in out]

    def text(t):
        def one(n, x):
            mix = lambda v: int(imatch._mix(np.array([v], np.uint64))[0])
            total = sum(mix(v ^ (k * int(imatch._PLACE) % 2**64)) for k, v in enumerate(x, 1)) % 2**64
            return f"{min(n, 15):x}{mix(total) & 0xFFFF:04x}" if n else "00000"

        return "".join(one(*s) for s in slots(t))

    def near(a, b):
        pairs = [(max(int(a[i], 16), int(b[i], 16)), a[i : i + 5] == b[i : i + 5]) for i in range(0, len(a), 5)]
        equal, unequal = sum(n for n, same in pairs if same), [n for n, same in pairs if not same]
        if not equal or not unequal:
            return float(bool(equal))
        lo, hi = 0.0, 1.0
        for _ in range(60):
            rho = (lo + hi) / 2
            if sum(n * rho**n / (1 - rho**n) for n in unequal) > equal:
                hi = rho
            else:
                lo = rho
        return lo

    real = sorted((d, t or "") for d, t in rows if d is not None)
    out = []
    for k, (d, t) in enumerate(real):
        after, m = real[(k + 1) % len(real)][1], len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(t), text(edited), near(text(t), text(edited)), near(text(t), text(after))))
    for d, t in rows:
        if d is None:
            t = t or ""
            edited = t[: len(t) - len(t) // 4]
            out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(t), text(edited), near(text(t), text(edited)), None))
    return sorted(out, key=str)


def check_imatch(got, rows):
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = plain_imatch(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[5] - w[5]) < 1e-5 and (g[6] is None) == (w[6] is None) and (g[6] is None or abs(g[6] - w[6]) < 1e-5)


def imatch_rows():
    rows = [(i, prose(random.Random(i), 30 + i) + f" term{i // 3} term{i // 7} only{i}") for i in range(90)]
    return rows + [r for r in EDGES if len(r[1] or "") < 20_000] + [(None, "term1 term2 term3 no id"), (None, None)]


@pytest.mark.parametrize("chars, bound", [(16_000_000, 2_000_000), (700, 2_000_000), (700, 0)])
def test_fingerprints_equal_the_plain_version(spark, monkeypatch, chars, bound):
    """One range and many; lexicon broadcast and joined by a shuffle."""
    monkeypatch.setattr(imatch, "RANGE_CHARS", chars)
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", bound)
    rows = imatch_rows()
    check_imatch(imatch.edited_fingerprints(spark, docs(spark, rows)), rows)


def test_ids_beyond_the_doubles(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_CHARS", 400)
    rows = [((1 << 60) + i * 7 % 101, prose(random.Random(i), 20)) for i in range(101)]
    rows += [(-(1 << 62) - i, prose(random.Random(-i), 9)) for i in range(20)]
    check_imatch(imatch.edited_fingerprints(spark, docs(spark, rows)), rows)


def test_fingerprints_of_small_tables(spark):
    assert imatch.edited_fingerprints(spark, docs(spark, EDGES).limit(0)).count() == 0
    for rows in ([(5, "one document alone with some words")], [(None, "x y z")], [(1, ""), (1, ""), (2, None)]):
        check_imatch(imatch.edited_fingerprints(spark, docs(spark, rows)), rows)


@pytest.mark.parametrize("n", [10, 30, 100, 400])
def test_likeness_follows_the_share_of_common_terms(n):
    rng = random.Random(n)
    known = np.sort(imatch._hash([f"t{i}" for i in range(5000)]))
    mark = lambda w: imatch.slots(imatch._held(" ".join(w), known))
    edits, others = [], []
    for _ in range(60):
        a = [f"t{rng.randrange(5000)}" for _ in range(n)]
        b = a[: n - n // 4] + [f"t{rng.randrange(5000)}" for _ in range(n // 4)]
        edits.append((mark(a), mark(b)))
        others.append((mark(a), mark([f"t{rng.randrange(5000)}" for _ in range(n)])))
    near, far = (imatch.likeness(*zip(*pairs, strict=True)) for pairs in (edits, others))
    assert abs(near.mean() - 0.6) < 0.1 and far.mean() < 0.05 and (near > far).mean() > 0.97
