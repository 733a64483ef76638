import hashlib
import math

import numpy as np
import pytest

from mailsieve.llm import codes as C


def brute(rows, parts=4, entries=256, rounds=4):
    """The contract in plain Python over (vec_id, vector, label) rows."""
    ok = [r for r in rows if r[1] is not None and len(r[1]) > 0 and all(x is not None and math.isfinite(x) for x in r[1])]
    ok = [(i, [math.floor(1024 * float(x)) for x in v], g) for i, v, g in ok]
    big = float("inf")
    first = sorted(ok, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    width = len(first[0][1])
    ok = [r for r in ok if len(r[1]) == width]
    first = [r for r in first if len(r[1]) == width][:entries]
    w = width // parts
    book = [[r[1][j * w:(j + 1) * w] for r in first] for j in range(parts)]

    def nearest(j, v):
        best, at = big, 0
        for k, e in enumerate(book[j]):
            d = sum((a - b) ** 2 for a, b in zip(v, e))
            if d < best:
                best, at = d, k
        return at, best

    for _ in range(rounds):
        sums = {}
        for _, v, _ in ok:
            for j in range(parts):
                k, _ = nearest(j, v[j * w:(j + 1) * w])
                s = sums.setdefault((j, k), [[0] * w, 0])
                s[0] = [a + b for a, b in zip(s[0], v[j * w:(j + 1) * w])]
                s[1] += 1
        for (j, k), (s, n) in sums.items():
            book[j][k] = [a // n for a in s]
    out = []
    for i, v, g in ok:
        found = [nearest(j, v[j * w:(j + 1) * w]) for j in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), g))
    digest = hashlib.sha256(",".join(str(x) for j in book for e in j for x in e).encode()).hexdigest()
    return out, digest


def run(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    df = spark.createDataFrame(rows, schema)
    coded, book = C.compress(df)
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label, r.group_error) for r in coded.collect())
    return got, C.digest(book)


def test_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8).astype(np.float32)], int(rng.integers(0, 3))) for i in range(300)]
    rows += [(1000, None, 1), (1001, [1.0, float("nan")] * 4, 1), (1002, [float("inf")] * 8, 2), (1003, [0.5] * 4, 2)]
    rows += [(1004, [0.0] * 8, None), (1004, [0.0] * 8, None), (5, rows[5][1], 2), (None, [0.1] * 8, None)]
    rows += [(1005, [None] + [0.0] * 7, 1), (1006, [], 1)]
    got, digest = run(spark, rows)
    want, want_digest = brute(rows)
    errors = {}
    for i, code, error, g in want:
        errors[g] = errors.get(g, 0) + error
    assert got == sorted((i if i is not None else -1, c, e, g, errors[g]) for i, c, e, g in want)
    assert digest == want_digest
    assert len(got) == 300 + 4


def test_few_rows_ties_and_empty(spark):
    rows = [(i % 3, [0.25, -0.25, 0.5, 1e-4] * 2, 1) for i in range(9)]  # all equal: every tie goes to entry 0
    got, digest = run(spark, rows)
    want, want_digest = brute(rows)
    assert [(i, c, e) for i, c, e, _, _ in got] == sorted((i, c, e) for i, c, e, _ in want)
    assert {c for _, c, _, _, _ in got} == {"00000000"} and digest == want_digest
    empty, book = C.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert empty.count() == 0 and book.size == 0


def test_cells_equal_a_full_scan():
    rng = np.random.default_rng(7)
    book = rng.integers(-300, 300, (2, 40, 5))
    book[0, 7] = book[0, 3]  # equal entries: the lower index wins
    x = np.concatenate([rng.integers(-400, 400, (500, 2, 5)), np.repeat(book[:, 3][None], 3, 0)])
    cells = C.Cells(book, step=16)
    codes, dist = cells.assign(x)
    for j in range(2):
        full = ((x[:, j, None, :] - book[j][None]) ** 2).sum(-1)
        assert (codes[:, j] == full.argmin(1)).all() and (dist[:, j] == full.min(1)).all()
    again, _ = cells.assign(x)
    assert (again == codes).all() and cells.computed < cells.looked


def test_wide_values_stay_exact():
    book = np.array([[[0, 0], [3 << 40, 1]]], dtype=np.int64)
    x = np.array([[[(3 << 40) - 5, 1]], [[1 << 41, 0]]], dtype=np.int64)
    codes, dist = C.Cells(book).assign(x)
    assert codes[:, 0].tolist() == [1, 1] and int(dist[0, 0]) == 25


def test_parts_must_divide(spark):
    with pytest.raises(ValueError):
        C.compress(spark.createDataFrame([(1, [0.0] * 6, 1)], "vec_id long, embedding array<float>, label int"))
