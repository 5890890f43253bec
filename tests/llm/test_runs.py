"""Periodic runs against a plain search over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.fixtures import EDGES, SF, docs, prose
from tickvault.llm import registry, runs


def plain_runs(words):
    """Every maximal repetition, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            part = words[i : end + q]
            smallest = next(p for p in range(1, q + 1) if part[p:] == part[: length - p])
            if length >= max(6, 4 * q) and smallest == q:
                out.append((i, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_edit(words, doc_id):
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = plain_edit([w for w in _split(text or "") if w], doc_id)
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    return (doc_id, len(found), *head, sha(lines), sha(kept))


def _split(text):
    import re

    return re.split(r"[\x20\x09-\x0D]+", text)


def found(lists):
    ids, flat = {}, []
    for words in lists:
        flat += [ids.setdefault(w, len(ids)) for w in words]
    got = runs.find_runs(np.array(flat, np.int64), np.cumsum([len(w) for w in lists]))
    return [[(r.start, r.length, r.period) for r in one] for one in got]


def test_period_classes_keep_their_promises():
    classes = list(runs.period_classes(5000))
    assert [c[0] for c in classes[1:]] == [c[1] + 1 for c in classes[:-1]]
    assert classes[0][0] == 1 and classes[-1][1] == 5000
    for low, high, k in classes:
        assert k == min(runs.overlap(q) for q in range(low, high + 1))
        assert k >= 2 * high - 1


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_words_of_few_kinds(letters):
    rng = random.Random(letters)
    lists = [[rng.randrange(letters) for _ in range(rng.randrange(60))] for _ in range(300)]
    # powers of random words inside random words
    for _ in range(300):
        w = [rng.randrange(letters + 1) for _ in range(rng.randrange(1, 12))]
        before, after = ([rng.randrange(4) for _ in range(rng.randrange(8))] for _ in range(2))
        lists.append(before + w * rng.randrange(3, 7) + w[: rng.randrange(len(w) + 1)] + after)
    assert found(lists) == [plain_runs(w) for w in lists]


def test_fibonacci_and_thue_morse_words():
    fib, morse = ["a", "ab"], "a"
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    for _ in range(9):
        morse += morse.translate(str.maketrans("ab", "ba"))
    lists = [list(fib[-1]), list(morse), list("abc" * 80 + "abd" * 80), list("a" * 500)]
    assert found(lists) == [plain_runs(w) for w in lists]


def test_a_run_never_crosses_documents():
    assert found([["x"] * 3, ["x"] * 5, ["x"] * 6]) == [[], [], [(0, 6, 1)]]


def test_one_word_a_million_times_is_one_run():
    got = runs.find_runs(np.zeros(1_000_000, np.int64), np.array([1_000_000]))
    assert [(r.start, r.length, r.period) for r in got[0]] == [(0, 1_000_000, 1)]


def test_operator_on_edge_rows(spark):
    rows = EDGES + [(None, "go " * 9), (1, "a b a b a b a b"), (2, "a b a b a b a")]
    registry.importable(spark)
    got = runs.periodic_runs(docs(spark, rows)).collect()
    want = sorted(
        (str(d), tuple((s, n, q) for s, n, q in plain_runs([w for w in _split(t or "") if w])) if len(t or "") < 9000 else None)
        for d, t in rows
    )
    have = sorted((str(r.doc_id), tuple((x.start, x.length, x.period) for x in r.runs)) for r in got)
    for (d, w), (e, h) in zip(want, have, strict=True):
        assert d == e and (w is None or w == h)
    by_id = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by_id[905].runs] == [(0, 9000, 3)] and by_id[905].collapsed == "the cat sat"
    assert by_id[1].collapsed == "a b" and by_id[2].runs == []
    assert by_id[900].collapsed == "" and by_id[900].n_words == 0
    assert runs.periodic_runs(docs(spark, rows).limit(0)).count() == 0


def test_query_equals_the_plain_version(spark):
    got = registry.QUERIES["op12_periodic_runs"](spark, SF)
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in given if len((r.text or "").split()) < 1500]
    assert len(short) > 150
    have = {r[0]: tuple(r)[:8] for r in got.collect()}
    assert len(have) == len(given)
    for r in short:
        assert have[r.doc_id] == plain_row(r.doc_id, r.text)
    # edited documents of every size hold the run planted in them
    planted = [r.doc_id for r in given if zlib.crc32(str(r.doc_id).encode()) % 10 == 0]
    assert planted and sum(have[d][1] > 0 for d in planted) > len(planted) // 3


def test_query_edit_on_small_documents(spark, tmp_path):
    rng = random.Random(5)
    rows = [(d, prose(rng, rng.randrange(1, 120))) for d in range(-40, 260)] + EDGES[:5]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    have = sorted(map(str, (tuple(r)[:8] for r in registry.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())))
    assert have == sorted(str(plain_row(d, t)) for d, t in rows)
