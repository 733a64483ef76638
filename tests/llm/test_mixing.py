import re
from collections import Counter

from mailsieve.llm import mixing as M


def filled(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        share = (total - sum(cap * sizes[s] for s in full)) / free
        above = {s for s in names if s not in full and share * weight[s] > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in full else share * weight[s] for s in names}
        full |= above


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    targets = filled(sizes)
    planned = M.plan_mix(docs, keep=("source",)).collect()
    assert len(planned) == len(rows)
    taken, longest = Counter(), Counter()
    for p in planned:
        assert p.source_size == sizes[p.source] and abs(p.target - targets[p.source]) < 1e-6
        assert 0 <= p.copies <= 3
        taken[p.source] += p.copies * p.size
        longest[p.source] = max(longest[p.source], p.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6, (s, taken[s], t)
    return planned


def test_targets_are_met_to_half_a_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    planned = check(docs)
    again = M.plan_mix(docs.repartition(5), keep=("source",)).collect()
    assert sorted(map(str, planned)) == sorted(map(str, again))


def test_odd_rows(odd_docs, no_docs):
    planned = check(odd_docs.drop("size"))
    assert M.plan_mix(no_docs).count() == 0
    mixed = M.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(p.copies for p in planned)
    assert M.plan_mix(odd_docs.where("text is null")).where("copies > 0").count() == 0
