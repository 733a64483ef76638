import random

import pytest

from mailsieve.llm import jaccard_join as J


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in near[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids and len(seen) > 1 else (rows[i][0] if len(seen) == 1 else (min(ids) if ids else None)), len(near[i])))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    shared = [word() for _ in range(12)]
    out = []
    for i in range(60):  # documents that share a passage only
        out.append([word() for _ in range(60)] + shared)
    for size in (2, 3, 45):  # groups of near copies
        base = [word() for _ in range(90)]
        for _ in range(size):
            copy = list(base)
            copy[rng.randrange(90)] = word()
            out.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    return rows + [(500, rows[70][1]), (501, None), (502, ""), (503, "too short"), (504, "too short"), (505, "a b c d e"), (None, rows[70][1])]


@pytest.mark.parametrize("leaf", [384, 8])
def test_links_and_classes_equal_brute_force(spark, rows, leaf):
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, path string")
    found = J.join(df, settings=J.JoinSettings(leaf=leaf, recall=0.999)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))


def test_one_of_each_class_stays(spark, rows):
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, text string")
    stay = [r.doc_id for r in J.deduplicate(df).collect()]
    classes = {c for d, c, _ in brute(rows) if d is not None}
    assert sorted(i for i in stay if i is not None) == sorted(classes) and stay.count(None) == 1


def test_driver_rows_equal_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, J.join(docs).collect())) == sorted(brute([tuple(r) for r in docs.collect()]))


def test_odd_rows(odd_docs, no_docs):
    assert J.join(odd_docs).count() == odd_docs.count()
    kept = J.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    expected = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert {r.doc_id for r in kept.collect()} == {i for i, c, _ in expected if i == c} | {None}
    assert J.join(no_docs).count() == 0 and J.deduplicate(no_docs).count() == 0


def test_unlike_texts_under_one_key_all_stay(spark):
    a = "the river runs past the old mill and into the quiet town every single morning"
    other = "no other document has these seven words in this order at all anywhere"
    x = "green hills stand behind the station where trains wait for the night to end"
    y = "numbers on the board count the days until the harvest festival opens its gates"
    rows = [(1, a), (5, a), (5, other), (9, x), (9, y), (9, y), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in J.deduplicate(df).collect())
    assert kept == sorted([(-1, a), (-1, a), (1, a), (5, other), (9, x), (9, y)])


@pytest.fixture(scope="module")
def dense():
    """One group whose members are not all alike, chains that leave it, and others that share its words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    base = [word() for _ in range(100)]
    out = []
    for i in range(150):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(100)] = word()
        out.append(copy)
    for _ in range(3):  # each link leads further from the group
        copy = list(base)
        for at in (10, 40, 70, 90):
            copy[at] = word()
            out.append(list(copy))
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("leaf, hubs", [(16, 2), (8, 4), (30, 1)])
def test_classes_without_links_are_the_same(spark, dense, rows, leaf, hubs):
    df = spark.createDataFrame(dense + [(1000 + i if i is not None else None, t) for i, t in rows], "doc_id long, text string")
    settings = J.JoinSettings(leaf=leaf, hubs=hubs, recall=0.999)
    classes = lambda found: sorted((str(r.doc_id), str(r.class_id)) for r in found.collect())
    assert classes(J.join(df, settings=settings, links=False)) == classes(J.join(df, settings=settings))


def test_a_dense_leaf_moves_rows_by_its_size(spark):
    """Tiles of leaves ten times larger hold ten times the rows, where the leaf hangs together by its first links."""
    s = J.JoinSettings(leaf=16, hubs=2)
    def rows(n):
        leaf = spark.range(n).selectExpr("1L AS path", "cast(cast(id as string) as binary) AS set_id", f"{n}L AS size")
        first = J._first_tiles(leaf, s).count()
        one = leaf.selectExpr("set_id AS node", "cast('0' as binary) AS root")
        strays = one.where("cast(node as string) not in ('5', '7')")
        return first, J._other_tiles(leaf, one, s).count(), J._other_tiles(leaf, strays, s).count()
    (a, b, c), (d, e, f) = rows(800), rows(8000)
    assert d <= 13 * a and (b, e) == (0, 0) and f <= 11 * c and c <= 3 * 800
