import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from mailsieve.llm import packing as P
from mailsieve.llm.queries import tokenizer_path


def brute_pieces(rows, capacity=2048):
    tok = Tokenizer.from_file(tokenizer_path())
    out = []
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        n, first = len(ids), len(ids) % capacity
        starts = [0] if n <= capacity else ([0] if first else []) + list(range(first, n, capacity))
        cuts = starts + [n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return out


def valid(rows, capacity=2048):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_pieces_and_packing_against_brute_force(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = brute_pieces(rows)
    found = P.pack(P.pieces(odd_docs, tokenizer_path()), slot_rows=4).collect()
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert Counter(got) == Counter(want)
    assert valid(found) >= P.sequences_lower_bound(np.array([w[3] for w in want]))


def test_many_slots_are_nearly_optimal(spark):
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(1, 300, 3000), rng.integers(900, 1300, 300), np.full(20, 2048)])
    items = spark.createDataFrame(
        [(int(i), 0, 0, int(s), 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    found = P.pack(items, slot_rows=200, carry=4).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(sizes)))
    n = valid(found)
    assert n <= P.sequences_lower_bound(sizes) * 1.02 + 2


def test_slots_structure_is_best_fit():
    s = P._Slots(2048)
    for room, b in [(5, 0), (100, 1), (100, 2), (2000, 3)]:
        s.add(room, b)
    assert s.take(6) == 2 and s.take(6) == 1 and s.take(1) == 0 and s.take(2001) is None and s.take(1) == 3 and s.take(1) is None


def test_empty_and_too_long(spark, no_docs):
    assert P.pack(P.pieces(no_docs, tokenizer_path())).count() == 0
    items = spark.createDataFrame([(1, 0, 0, 5000, 0)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    with pytest.raises(ValueError):
        P.pack(items)


def test_a_small_bin_finds_room_among_many_fuller_ones(spark):
    """The one bin with room for it is the least full of its slot's large bins, behind 70 fuller ones."""
    sizes = [2000] * 560 + [1500, 500, 40]
    items = spark.createDataFrame(
        [(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long"
    ).repartition(1)
    for slot_rows in (71, 10, 4):
        assert valid(P.pack(items, slot_rows=slot_rows).collect()) == 561


def test_what_goes_up_is_bounded_and_enough():
    """Of equal rooms only as many go up as small bins can ever come to them; no room is left out."""
    packer = P._Packer(2048, 1, 0, 0)
    for size in [1600] * 100 + [1500] * 3 + [1200] * 100:
        packer.put(size, [(0, 0, 0, size, 0)])
    rows = packer.close(False, 16)
    up = Counter(r["fill"] for r in rows if not r["final"])
    assert up == {1600: 16, 1500: 3, 1200: 16} and len({r["sequence_id"] for r in rows}) == 203
