import numpy as np
import pytest
from pyspark.sql import functions as F

from flowwarden.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def brute(rows, scale=256):
    """(anchor, positive, rank, negative, scores) by the rule as it reads, in Python's whole numbers."""
    good = []
    for vec_id, label, v in rows:
        if vec_id is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = (vec_id, label, tuple(int(np.floor(scale * float(x))) for x in v))
        if row not in good:
            good.append(row)
    out = []
    for a in good:
        if a[0] % 50:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in good if b != a and len(b[2]) == len(a[2])]
        best = lambda some: sorted(some, key=lambda s: (-s[0], s[1][0]))
        for ps, p in best(s for s in scored if s[1][1] == a[1])[:5]:
            inside = [s for s in scored if s[1][1] != a[1] and 50 * ps <= 100 * s[0] <= 95 * ps]
            out += [(a[0], p[0], i + 1, n[0], ps, ns) for i, (ns, n) in enumerate(best(inside)[:3])]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    found = hn.hard_negatives(hn.quantised(docs), F.col("vec_id") % 50 == 0)
    return sorted(tuple(r) for r in found.collect())


def near_centres(seed, n, dims, spread, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, dims))
    vectors = base[rng.integers(5, size=n)] + spread * rng.normal(size=(n, dims))
    return [(i, int(x), v.astype(np.float32).tolist()) for i, (x, v) in enumerate(zip(rng.integers(labels, size=n), vectors))]


@pytest.mark.parametrize("dims, spread, small", [(16, 0.3, False), (16, 0.05, True), (3, 1.0, True), (1, 1.0, True)])
def test_against_all_pairs(spark, monkeypatch, dims, spread, small):
    if small:
        for name, value in (("TILE_ANCHORS", 3), ("LEAST_TILE", 40), ("TILE_ROWS", 40), ("STEP", 7), ("MEMBERS", 2)):
            monkeypatch.setattr(hn, name, value)
    rows = near_centres(dims, 600, dims, spread)
    rows += [(1000 + i, 9, rows[0][2]) for i in range(120)]  # many equal vectors: ties by id
    assert mined(spark, rows) == brute(rows)


def test_walks_end_early():
    rng = np.random.default_rng(3)
    base = np.eye(8)[rng.integers(8, size=20_000)] * 1000 + rng.normal(size=(20_000, 8)) * 20
    q = np.floor(base).astype(np.int64)
    members = q[:40][np.argmax(q[:40], axis=1) == 0]
    found = hn.Best(len(members), 5)
    done = hn._walk(members, np.eye(8)[0], q, lambda a, s, at: found.offer(a, s, at), lambda: found.score[:, -1])
    scores = members @ q.T
    order = np.lexsort((np.broadcast_to(np.arange(len(q)), scores.shape), -scores), axis=1)[:, :5]
    assert (found.id == order).all() and (found.score == np.take_along_axis(scores, order, 1)).all()
    assert done < 0.4 * scores.size


def test_odd_rows(spark):
    v, w = [1.0, 0.5, 0.25], [0.9, 0.5, 0.2]
    bad = [(50, None, v), (100, 1, None), (150, 1, [1.0, None, 1.0]), (200, 1, [float("nan"), 1.0, 1.0]), (None, 1, v), (250, 1, [])]
    rows = bad + [(0, 1, v), (0, 1, v), (0, 1, w), (3, 1, v), (4, 1, w), (5, 2, w), (6, 2, [0.7, 0.4, 0.1]), (8, 2, [1.0, 2.0]), (300, 1, [0.0] * 3), (350, 5, v), (9, 3, [0.6, 0.5, 0.0])]
    assert mined(spark, rows) == brute(rows)
    extra = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], f"{SCHEMA}, row int, cluster int, _a int, q string")
    found = hn.hard_negatives(hn.quantised(extra), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    huge = [(0, 1, [3e38, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.9])]
    assert mined(spark, huge) == []  # scores with the first would not fit a long: it takes no part
    assert mined(spark, rows[:0]) == []


def test_whole_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.normal(size=6) * 200_000).astype(np.float32).tolist()) for i in range(120)]
    assert mined(spark, rows) == brute(rows)
