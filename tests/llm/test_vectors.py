import contextlib
import glob
import os
import threading

import numpy as np
import pytest
from conftest_llm import Links

from flowwarden.llm import vector_links
from flowwarden.plans.sizing import ensure_checkpoint_dir


def vectors(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = base[rng.integers(6)] + spread * rng.normal(size=dims) if i % 3 else rng.normal(size=dims)
        out.append((v * rng.uniform(0.1, 9)).astype(np.float32).tolist())
    return out


def brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = Links(), {i: 0 for i, _ in rows}
    for a in range(len(good)):
        for b in range(a):
            (i, x), (j, y) = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                links.join(i, j)
                count[i] += 1
                count[j] += 1
    return {i: (count[i], min(j for j, _ in rows if links.find(j) == links.find(i))) for i, _ in rows}


@pytest.mark.parametrize("dims, tile, block", [(64, 2048, 16), (64, 8, 16), (10, 12, 3), (2, 9, 16), (1, 9, 16)])
def test_against_all_pairs(spark, dims, tile, block):
    rows = list(enumerate(vectors(dims, 150, dims, 0.12)))
    rows += [(1000 + i, rows[4][1]) for i in range(20)] + [(2000, [2 * x for x in rows[4][1]])]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = vector_links.near_vectors(docs, block_dims=block, tile_rows=tile).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    bad = [None, [], [0.0] * 3, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0]]
    rows = [(i, x) for i, x in enumerate(bad)] + [(10, v), (11, v), (11, v), (None, v), (12, [1.0, 2.0]), (13, [1e30, 2e30, 3e30]), (14, [1e-30, 2e-30, 3e-30]), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id int, embedding array<float>, node int, links int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vector_links.near_vectors(docs).collect())
    want = [(str(i), 0, str(i), True) for i in range(6)] + [("None", 0, "None", True), ("12", 0, "12", True)]
    # 10, 11 and the one without an id hold the same vector, 13 and 14 point the same way
    want += [("10", 4, "10", True), ("11", 4, "10", False), ("11", 4, "10", False), ("None", 4, "10", False), ("13", 4, "10", False), ("14", 4, "10", False)]
    assert got == sorted(want)
    assert vector_links.near_vectors(docs.limit(0)).count() == 0


def files(spark):
    """Sizes of the files that Spark has written and not deleted."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shared = ensure_checkpoint_dir(spark).removeprefix("file:")
    found = {}
    for f in (f for d in [*local, shared] for f in glob.glob(f"{d}/**/*", recursive=True)):
        with contextlib.suppress(OSError):  # it may go meanwhile
            found[f] = os.path.getsize(f) if os.path.isfile(f) else 0
    return found


def test_vectors_are_not_copied_to_those_they_meet(spark):
    x = np.random.default_rng(3).normal(size=(6000, 64)).astype(np.float32)
    x[5000:5040] = x[:40] + np.float32(0.01)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    before, most, done = files(spark), [0], threading.Event()

    def watch():
        while not done.wait(0.05):
            most.append(sum(size for f, size in files(spark).items() if f not in before))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.near_vectors(docs, tile_rows=256).collect()}
    finally:
        done.set()
        watcher.join()
    assert got == {i: (int(i < 40 or 5000 <= i < 5040), i - 5000 * (5000 <= i < 5040)) for i in range(6000)}
    assert 0 < max(most) < 4 * x.nbytes


def test_copies_and_links_across_files(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 12)), 40, axis=0) + 0.03 * rng.normal(size=(1200, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[i % 3].tolist()) for i in range(200)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = vector_links.near_vectors(docs, tile_rows=16).collect()  # a dozen files or so, cells cut apart
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_equal_vectors_have_the_same_cell_in_any_batch():
    x = np.random.default_rng(5).normal(size=(999, 20)).astype(np.float32)
    moment = np.diag([1.0] * 20 + [999.0])
    space = vector_links.Leading(moment, 0.95, 4)
    space.grow(space.coordinates(x).T, 64)
    cells = space.cells(x)
    assert len(set(cells.tolist())) == 64
    assert all(space.cells(x[i : i + 1])[0] == cells[i] for i in range(999))
    cut = space.coordinates(x)
    assert all((space.coordinates(x[i : i + n]) == cut[:, i : i + n]).all() for i, n in ((0, 1), (5, 7), (990, 9)))
