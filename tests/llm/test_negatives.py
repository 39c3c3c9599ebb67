"""Hard negatives against all scores, with Python's whole numbers."""

import math
import random

import numpy as np
import pytest

from quire.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, part int, q string, score long"


def brute(rows):
    table = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        table.append((i, math.fmod(label + 1, 10) if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    anchors = {}
    for i, label, q in table:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, w, strict=False)), i, other) for i, other, w in table), key=lambda s: s[:2])
        positives = [(i, -s) for s, i, other in scored if other == label and i != a][:5]
        for p, ps in positives:
            fit = [(i, -s) for s, i, other in scored if other != label and 30 * ps <= -100 * s <= 90 * ps][:10]
            out.extend((a, p, k + 1, n, ps, s) for k, (n, s) in enumerate(fit))
    return sorted(out)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(frame).collect()))


def vectors(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(0, 0.3, (n, width)) * scale).tolist()


@pytest.mark.parametrize(("chunk", "least", "scale"), [(8192, 2048, 1.0), (64, 50, 1.0), (64, 50, 3e3), (64, 50, 1e6)])
def test_equals_all_scores(spark, monkeypatch, chunk, least, scale):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "LEAST_ROWS", least)
    rng = random.Random(3)
    rows = [(i, v, rng.choice([0, 0, 0, 1, 2, 9])) for i, v in enumerate(vectors(450, 40, 1, scale))]
    if scale > 1e5:
        rows = [(i, v, label) for i, v, label in rows[:220]]
    want = brute(rows)
    assert want and got(spark, rows) == want


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 2)
    monkeypatch.setattr(negatives, "PART_ROWS", 100)
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(600, 20, 5))]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    good = [(i, v, i % 4) for i, v in enumerate(vectors(230, 8, 2))]
    odd = [
        (None, [0.1] * 8, 1), (300, None, 1), (301, [0.1] * 8, None), (302, [0.1, None], 1), (303, [float("nan")] * 8, 1), (304, [float("inf")] * 8, 1),
        (305, [1e307] * 8, 1), (400, [], 2), (401, [0.5] * 3, 3), (402, [0.5] * 20, 0), (500, [0.0] * 8, 1), (501, [-0.001] * 8, 1),
        *((510 + k, [0.3] * 8, k % 2) for k in range(30)), *((100, [0.3] * 8, 1) for _ in range(3)), (42, [0.3] * 8, 2), (42, [0.3] * 8, 2), (600, [0.3] * 8, -1), (700, [0.2] * 8, -5),
    ]
    assert got(spark, good + odd) == brute(good + odd)


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(100, [1.0], 1)]) == [] and got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_bounds_leave_few_candidates():
    """A scan looks at far fewer values than there are, where a few dimensions decide."""
    rng = np.random.default_rng(7)
    values = np.rint(rng.normal(0, 3, (4096, 64)))
    values[:, :8] = np.rint(rng.normal(0, 90, (4096, 8)))
    columns = negatives.Columns(values, np.arange(4096), np.zeros(4096, np.int64), np.float32)
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            read.append(out.size)
            return out

    columns.values = columns.values.view(Counted)
    windows = negatives.Windows([-np.inf], [np.inf], 5)
    for _ in range(2):  # the second time the floor is known
        read.clear()
        negatives.scan(columns, values[0].astype(np.float32), windows, 0, 4096, skip_id=0)
    want = np.argsort(-(values @ values[0]), kind="stable")
    assert [i for _, i in windows.best[0]][:1] == [i for i in want if i != 0][:1]
    assert sum(read) < 0.5 * values.size
