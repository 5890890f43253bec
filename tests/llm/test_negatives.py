"""Hard negatives against plain scoring of all rows, and against SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import SF
from tickvault.llm import negatives, registry


def plain(rows, k=5):
    """(vec_id, label, ints) rows, each id once: the result by full scoring."""
    out = []
    for anchor, label, a in rows:
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), i, lab) for i, lab, v in rows if i != anchor]
        scored.sort()
        for p, positive, _ in [r for r in scored if r[2] == label][:k]:
            inside = [(s, i) for s, i, lab in scored if lab != label and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(anchor, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(inside)]
    return sorted(out)


def plain_rows(given):
    seen = {}
    for vec_id, label, v in given:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        ints = [max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v]
        key = (label, ints)
        seen[vec_id] = min(seen.get(vec_id, key), key)
    return [(i, *seen[i]) for i in sorted(seen)]


def run(spark, given, folder):
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int")
    for name in ("rb", "ab", "v", "positives", "score", "rank"):  # clashing names
        df = df.withColumn(name, F.lit(name))
    df.write.parquet(f"{folder}/embeddings.parquet")
    got = registry.QUERIES["op13_hard_negatives"](spark, str(folder))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(rng, n, dims=12, labels=4, spread=1.0):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        base = centres[rng.randrange(labels)] if rng.random() < 0.3 else centres[label]
        out.append((i, [c + rng.gauss(0, spread) for c in base], label))
    return out


@pytest.mark.parametrize("block", [64, 8192])
def test_query_equals_full_scoring(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(negatives.hard_negatives, "__defaults__", (5, 5, 80, 100, block))
    rng = random.Random(block)
    given = vectors(rng, 900)
    # a third of the rows share one vector: ties by id, over labels and blocks
    given += [(10_000 + i, [0.5] * 12, i % 3) for i in range(450)]
    given += [(20_000 + 100 * i, [0.5] * 12, i % 3) for i in range(3)]
    want = plain(plain_rows([(i, lab, v) for i, v, lab in given]))
    assert len(want) > 100
    assert run(spark, given, tmp_path) == want


def test_rows_that_take_no_part_and_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    given = vectors(random.Random(3), 120, dims=4, labels=2)
    given += [
        (None, [1.0] * 4, 1), (500, None, 1), (600, [1.0] * 4, None), (700, [nan] * 4, 1), (701, [inf, 0.0, 0.0, 0.0], 1),
        (702, [-inf, 0.0, 0.0, 0.0], 0), (703, [None, 1.0, 1.0, 1.0], 0), (800, [], 1), (801, [1.0], 0), (802, [2.0] * 9, 1),
        (900, [3e38, -3e38, 1.0, 0.0], 1), (901, [3e38, 1.0, 1.0, 0.0], 0), (902, [3e38, -2e9, 1.0, 0.0], 1),
        (1000, [0.0] * 4, 0), (1001, [0.0] * 4, 0), (1002, [-1.0] * 4, 1), (-100, [0.3] * 4, 1), (-7, [0.3] * 4, 9),
        (1100, [0.4] * 4, 1), (1100, [0.4] * 4, 1), (1101, [0.4] * 4, 0), (1101, [0.5] * 4, 0), (1102, [0.4] * 4, 1),
    ]
    want = plain([(i, lab, list(v) + [0] * (9 - len(v))) for i, lab, v in plain_rows([(i, lab, v) for i, v, lab in given])])
    assert {r[0] for r in want} >= {-100, 900, 1000, 1100}
    assert run(spark, given, tmp_path) == want


def test_empty_and_lonely_tables(spark, tmp_path):
    assert run(spark, [], tmp_path / "a") == []
    assert run(spark, [(0, [1.0], 1)], tmp_path / "b") == []
    assert run(spark, [(100, [1.0], 1), (2, [1.0], 1), (3, [1.0], 2)], tmp_path / "c") == [(100, 2, 1, 3, 65536, 65536)]


def test_threshold_stops_before_reading_everything():
    """Few strong dimensions: the lists settle the answer long before their end."""
    rng = np.random.default_rng(1)
    x = rng.integers(-256, 257, (20_000, 6)).astype(np.float32)
    lists = negatives.SortedLists(x)
    counted = []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            if self.ndim == 2:
                counted.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    lists.x = x.view(Counting)
    a = np.array([200, -3, 2, 0, 1, -1], np.float32)
    allowed = np.arange(len(x)) % 2 == 0
    ((rows, scores),) = lists.best(a, allowed, [(-negatives._FAR, negatives._FAR)], 5)
    s = np.where(allowed, x @ a, -1e9)
    want = np.lexsort((np.arange(len(x)), -s))[:5]
    assert rows.tolist() == want.tolist() and scores.tolist() == s[want].tolist()
    assert sum(counted) < len(x) // 4


def test_windows_of_any_kind_against_full_scoring():
    rng = np.random.default_rng(2)
    for n, dims, span in ((0, 3, 5), (1, 3, 5), (37, 1, 2), (400, 5, 3), (700, 16, 100)):
        x = rng.integers(-span, span + 1, (n, dims)).astype(np.float64)
        lists = negatives.SortedLists(x)
        for _ in range(20):
            a = rng.integers(-span, span + 1, dims).astype(np.float64)
            allowed = rng.random(n) < 0.7
            s = (x @ a).astype(int)
            windows = [tuple(sorted(rng.integers(-50, 400, 2).tolist())) for _ in range(4)] + [(5, 4), (0, 0)]
            for (low, high), (rows, scores) in zip(windows, lists.best(a, allowed, windows, 3), strict=True):
                inside = [i for i in np.lexsort((np.arange(n), -s)) if allowed[i] and low <= s[i] <= high][:3]
                assert rows.tolist() == inside and scores.tolist() == s[inside].tolist()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF.replace('0.001', '0.01')}/embeddings.parquet'")
    got = registry.QUERIES["op13_hard_negatives"](spark, SF.replace("0.001", "0.01"))
    want = con.sql(negatives.SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
