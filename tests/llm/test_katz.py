import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailsieve.llm import katz as K

SMALL = K.KatzSettings(chunk_chars=1 << 14, shard_bytes=1 << 14)


def plain(rows):
    """Scores by the formulas; rows are (id, text, held out)."""
    toks = [(t or "").encode().lower().split() + [b"\n"] for _, t, _ in rows]
    c1, c2, cx = Counter(), Counter(), Counter()
    for t, r in zip(toks, rows, strict=True):
        if not r[2]:
            before = [b" ", *t[:-1]]
            c1.update(t), c2.update(zip(before, t, strict=True)), cx.update(before)
    n, v = sum(c1.values()), len(c1)
    d1, d2 = (K.discounts(np.array([list(c.values()).count(r) for r in range(1, 7)])) for c in (c1, c2))
    cut = lambda d, r: (d[r] if r <= 5 else 1) * r
    z = sum(cut(d1, r) for r in c1.values())
    u = max(1 - z / n, 0.5 / (n + 0.5 * (v + 1))) if n else 1.0
    p1 = lambda w: (1 - u) * cut(d1, c1[w]) / z if c1[w] else u
    kept, below = defaultdict(float), defaultdict(float)
    for (a, b), r in c2.items():
        kept[a] += cut(d2, r)
        below[a] += p1(b)

    def prob(a, b):
        if not cx[a]:
            return p1(b)
        total = cx[a] + (kept[a] >= cx[a] * (1 - 1e-12))
        return cut(d2, c2[a, b]) / total if c2[a, b] else (1 - kept[a] / total) / (1 - below[a]) * p1(b)

    out = []
    for t, r in zip(toks, rows, strict=True):
        base = sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = sum(math.log10(prob(a, b)) for a, b in zip([b" ", *t[:-1]], t, strict=True))
        out.append((r[0], bool(r[2]), len(t), sum(c1[w] > 0 for w in t), n, base, score))
    return out, prob, c1


def same(found, expected):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_equal_the_formulas(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").repartition(3, "doc_id")
    docs = docs.selectExpr("doc_id", "text", "doc_id % 5 = 1 AS held_out")
    same(K.score(docs, settings=SMALL).collect(), plain([tuple(r) for r in docs.collect()])[0])


def test_probabilities_sum_to_one():
    _, prob, c1 = plain([(1, "a b a c a b d", False), (2, "a b b c c c", False), (3, "x y", True)])
    for context in (b"a", b"c", b" ", b"unseen"):
        assert math.isclose(sum(prob(context, w) for w in c1) + prob(context, b"never"), 1, rel_tol=1e-12)


@pytest.mark.parametrize("held", ["doc_id = 1", "true", "false", "cast(null as boolean)"])
def test_odd_rows(odd_docs, held):
    docs = odd_docs.selectExpr("*", f"coalesce({held}, false) AS held_out").coalesce(1)
    rows = [(r.doc_id, r.text, r.held_out) for r in docs.collect()]
    same(K.score(docs).collect(), plain(rows)[0])


def test_no_rows(no_docs):
    assert K.score(no_docs.selectExpr("*", "false AS held_out")).count() == 0


def test_packing():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (K._unpack_sorted(K._pack_sorted(keys)) == keys).all()
    assert len(K._unpack_sorted(K._pack_sorted(keys[:0]))) == 0


def test_totals_do_not_wrap_at_32_bits():
    import numpy as np
    import pandas as pd

    from mailsieve.llm import katz as K

    keys = np.array([7, 9], np.uint64)
    counts = np.array([3_000_000_000, 1], np.uint32)
    row = ("b", 0, 0, K._pack_sorted(keys), K._pack(counts))
    frame = pd.DataFrame([row, (*row[:1], 1, *row[2:])], columns=["kind", "chunk", "shard", "keys", "data"])
    out = K._count(frame)
    answer = K._unpack(out.iloc[0]["keys"], np.uint64)
    assert answer.tolist() == [6_000_000_000, 2]
    stats = np.frombuffer(out.iloc[-1]["data"], np.int64)
    assert stats[-1] == 6_000_000_002
