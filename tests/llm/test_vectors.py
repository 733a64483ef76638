import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import ann, collisions as C

FIELDS = "vec_id long, embedding array<float>, label int, node string, size int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters of all sizes, copies, and vectors that take no part."""
    rng, rows = np.random.default_rng(5), []
    for c in range(40):
        centre = rng.standard_normal(16)
        for _ in range((1, 2, 30)[c % 3]):
            rows.append(((centre + rng.standard_normal(16) * 0.06 * np.linalg.norm(centre) / 4).tolist(), c % 2))
    rows += [rows[5], rows[5], (rows[5][0], None), ([0.0] * 16, 0), (None, 1), ([float("nan")] * 16, 0), ([None] * 16, 0), ([], 0), ([1.0, 2.0], 0), ([1.0, 2.1], 0)]
    rows = [(i, v, label, "x", 3) for i, (v, label) in enumerate(rows)]
    return spark.createDataFrame([*rows, (None, rows[0][1], 0, "x", 3), (7, rows[9][1], 1, "x", 3)], FIELDS)


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicates_equal_brute_force(vectors):
    rows = vectors.collect()
    unit = [np.array(r.embedding, float) / np.linalg.norm(r.embedding) if usable(r.embedding) and r.label is not None else None for r in rows]
    near = [
        [j for j, w in enumerate(unit) if j != i and u is not None and w is not None and rows[i].label == rows[j].label and len(u) == len(w) and u @ w >= 0.98]
        for i, u in enumerate(unit)
    ]
    expected = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j].vec_id for j in seen if rows[j].vec_id is not None]
        root = min(ids) if ids else None
        expected.append((r.vec_id, len(near[i]), root, r.vec_id == root))
    for settings in (C.CollisionSettings(), C.CollisionSettings(block=16)):
        found = C.near_duplicates(vectors, settings=settings).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_no_pair_below_the_cosine_and_recall_by_the_binomial():
    s = C.CollisionSettings()
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * side
    lines = C.lines(64, s)
    shared = (np.abs(a @ lines - b @ lines) <= s.window * s.spread).sum(1)
    assert (shared >= s.least).mean() >= 0.99


def test_collisions_are_windows_around_the_asking_row():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((50, 7)), rng.standard_normal((60, 7))
    assert (C.collisions(a, b, 0.3) == (np.abs(a[:, None] - b) <= 0.3).sum(2)).all()


def test_recall_of_nearest_neighbours(vectors, spark):
    rows = [r for r in vectors.collect() if usable(r.embedding) and r.vec_id is not None]
    found = {}
    for r in ann.nearest(vectors, F.col("vec_id") % 5 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {r.vec_id for r in rows if r.vec_id % 5 == 0}
    hits = total = 0
    for q in (r for r in rows if r.vec_id % 5 == 0):
        others = [(float(np.linalg.norm(np.array(q.embedding, float) - np.array(r.embedding, float))), r.vec_id) for r in rows if r is not q and len(r.embedding) == len(q.embedding)]
        best = sorted(others)[:10]
        got = sorted(found[q.vec_id])
        assert [g[0] for g in got] == list(range(1, len(best) + 1))
        assert got == [(i + 1, *reversed(x)) for i, x in enumerate(sorted((s, v) for _, v, s in got))]
        hits += len({v for _, v in best} & {v for _, v, _ in got})
        total += len(best)
    assert hits >= 0.95 * total
    assert ann.nearest(vectors, F.col("vec_id") % 5 == 0).count() == total


def test_the_estimate_is_unbiased_and_within_its_bound():
    rng = np.random.default_rng(4)
    s = ann.CodeSettings()
    x, q, turn = rng.standard_normal((500, 32)), rng.standard_normal((20, 32)), ann.rotation(32, s)
    assert np.allclose(turn.T @ turn, np.eye(32))
    squared, error = ann.estimate(*ann.encode(x, np.zeros(32), turn), q, np.zeros(32), turn, s.bound)
    exact = ((q[:, None] - x) ** 2).sum(2)
    assert (np.abs(squared - exact) <= error).mean() >= 0.9
    assert abs((squared - exact).mean()) < 0.05 * exact.mean()


def test_empty_tables(vectors):
    none = vectors.where("false")
    assert ann.nearest(none, F.lit(True)).count() == 0 and C.near_duplicates(none).count() == 0
    unusable = vectors.where("embedding is null")
    assert ann.nearest(unusable, F.lit(True)).count() == 0
    assert [r.kept for r in C.near_duplicates(unusable).collect()] == [True]
