import hashlib
import math
import random
from collections import Counter, defaultdict

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import conform as C
from mailsieve.operators import dedup as D
from mailsieve.operators import split as S
from mailsieve.operators.lineage import lookup, run_folder, scratch_path


def _messages(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        channel = "email" if rng.random() < 0.4 else "sms"
        rows.append((f"m_{i}", f"text {i}", channel, int(rng.random() < 0.2), f"s{i % 3}", "en"))
    return spark.createDataFrame(
        rows, "id string, text string, channel string, label int, source string, lang string"
    ), rows


def _expected_split(rows, seed, val, test):
    """Plain restatement: rank by hash within stratum against largest-remainder quotas."""
    strata = defaultdict(list)
    for r in rows:
        strata[f"{r[3]}_{r[2]}"].append(hashlib.sha256(f"{seed}|{r[0]}".encode()).hexdigest() + r[0])

    def share(sizes, draw):
        total = sum(sizes.values())
        got = {k: v * draw // total for k, v in sizes.items()}
        order = sorted(sizes, key=lambda k: (-(sizes[k] * draw % total), k))
        for k in order[: draw - sum(got.values())]:
            got[k] += 1
        return got

    sizes = {k: len(v) for k, v in strata.items()}
    hold = math.ceil(len(rows) * (val + test))
    train = share(sizes, len(rows) - hold)
    held = {k: sizes[k] - train[k] for k in sizes}
    n_val = share(held, hold - math.ceil(hold * (test / (val + test))))
    out = {}
    for k, members in strata.items():
        for place, key in enumerate(sorted(members)):
            name = "train" if place < train[k] else "val" if place < train[k] + n_val[k] else "test"
            out[key[64:]] = name
    return out


@pytest.mark.parametrize("val,test", [(0.1, 0.1), (0.15, 0.05)])
def test_split_equals_plain_ranking(spark, val, test):
    df, rows = _messages(spark)
    got = {r["id"]: r["split"] for r in S.stratified_split(df, 42, val, test).collect()}
    assert got == _expected_split(rows, 42, val, test)
    again = S.stratified_split(df.repartition(13, "text"), 42, val, test)
    assert {r["id"]: r["split"] for r in again.collect()} == got


def test_split_is_disjoint_and_seeded(spark):
    df, rows = _messages(spark)
    one = S.stratified_split(df, 1)
    assert one.columns == [*df.columns, "split"]
    assert one.count() == len(rows) and one.drop("split").exceptAll(df).isEmpty()
    two = S.stratified_split(df, 2)
    assert one.join(two, ["id", "split"]).count() < len(rows)
    sizes = {r["split"]: r["count"] for r in one.groupBy("split").count().collect()}
    assert sizes == {"train": 480, "val": 60, "test": 60}


def test_published_split_sizes(spark):
    strata = spark.createDataFrame(
        [("0_email", 185), ("1_email", 184), ("0_sms", 4503), ("1_sms", 958)], "_stratum string, _n long"
    )
    q = S.split_quotas(strata).agg(F.sum("n_train"), F.sum("n_val"), F.sum("n_test")).first()
    assert tuple(q) == (4664, 583, 583)


def test_thin_stratum(spark):
    df, _ = _messages(spark, 40)
    odd = df.withColumn("channel", F.when(F.col("id") == "m_0", "fax").otherwise(F.col("channel")))
    with pytest.raises(ValueError, match="fax"):
        S.stratified_split(odd)
    assert S.stratified_split(odd, strict=False).count() == 40


def test_cap_rows(spark):
    df, rows = _messages(spark)
    got = {r["id"] for r in S.cap_rows(df, 100, seed=9).collect()}
    key = lambda i: hashlib.sha256(f"9|{i}".encode()).hexdigest()
    assert got == set(sorted((r[0] for r in rows), key=key)[:100])
    for n in (0, -1, 600, 700):
        assert S.cap_rows(df, n).count() == 600


def test_checksum_ignores_layout_and_sees_changes(spark):
    df, _ = _messages(spark)
    sums = [
        S.content_checksum(d).first()["sha256"]
        for d in (df, df.repartition(7), df.orderBy(F.desc("text")), df.unionByName(df.limit(1)),
                  df.withColumn("text", F.when(F.col("id") == "m_3", "x").otherwise(F.col("text"))))
    ]
    assert sums[0] == sums[1] == sums[2] and len(set(sums)) == 3
    moved = spark.createDataFrame([("ab", "c")], "a string, b string")
    other = spark.createDataFrame([("a", "bc")], "a string, b string")
    nulls = spark.createDataFrame([(None, "bc")], "a string, b string")
    assert len({S.content_checksum(d).first()["sha256"] for d in (moved, other, nulls)}) == 3


def test_manifest(spark):
    df, rows = _messages(spark)
    for r in S.manifest(S.stratified_split(df)).collect():
        assert r["rows"] == r["n_email"] + r["n_sms"] and len(r["sha256"]) == 64


def test_class_weights(spark):
    df, rows = _messages(spark)
    n = Counter(r[3] for r in rows)
    got = {r["label"]: r["weight"] for r in S.class_weights(df).collect()}
    assert got == pytest.approx({k: 600 / (2 * v) for k, v in n.items()})


def test_dedup_keeps_first_in_order(spark):
    rows = [("b.parquet", 0, "Hello  World"), ("a.parquet", 5, "hello world\n"), ("a.parquet", 7, "HELLO WORLD")]
    rows += [("a.parquet", 9, None), ("b.parquet", 1, " "), ("c.parquet", 0, "other")]
    df = spark.createDataFrame(rows, "_file string, _row long, text string")
    kept = D.dedup_text(df, ("_file", "_row"))
    assert {(r[0], r[1]) for r in kept.collect()} == {("a.parquet", 5), ("a.parquet", 9), ("c.parquet", 0)}
    assert D.dedup_text(kept, ("_file", "_row")).count() == 3
    single = D.dedup_text(df.withColumn("n", F.xxhash64("_file", "_row")), ("n",))
    assert single.count() == 3
    assert tuple(D.dedup_summary(df).first()) == (6, 3, 3)


def test_conform(spark):
    df = spark.createDataFrame([("hi", "1", 5)], "sms string, label string, extra int")
    got = C.conform(df, {"sms": "text"}, {"id": "x", "channel": "sms", "source": "s", "lang": "en"})
    assert got.columns == ["id", "text", "channel", "label", "source", "lang"]
    assert dict(got.dtypes)["label"] == "int" and got.first()["label"] == 1
    with pytest.raises(ValueError, match="id, channel, source, lang"):
        C.conform(df, {"sms": "text"})
    bad = df.withColumn("label", F.lit(2))
    bad = C.conform(bad, {"sms": "text"}, {"id": "x", "channel": "sms", "source": "s", "lang": "en"})
    with pytest.raises(Exception, match="label outside 0 and 1"):
        bad.collect()


def test_ids(spark):
    rows = [("b", 0), ("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    df = spark.createDataFrame(rows, "_file string, _row long")
    dense = {(r["_file"], r["_row"]): r["id"] for r in C.assign_ids(df, "p", dense=True).collect()}
    assert dense == {("a", 0): "p_0", ("a", 1): "p_1", ("a", 2): "p_2", ("b", 0): "p_3", ("c", 0): "p_4"}
    assert {r["id"] for r in C.assign_ids(df, "p").collect()} == {f"p_{f}_{r}" for f, r in rows}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_the_same_beyond_broadcast(spark, how):
    rows = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k")
    )
    table = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = rows.join(table, "k", how)
    salted = lookup(rows, table, "k", F.col("id"), how, broadcast_bytes=10, hot_rows=500)
    broad = lookup(rows, table, "k", F.col("id"), how)
    cold = lookup(rows, table, "k", F.col("id"), how, broadcast_bytes=10)
    for other in (salted, broad, cold):
        other = other.select(*plain.columns)
        assert other.count() == plain.count() and other.exceptAll(plain).isEmpty()


def test_a_flow_deletes_its_scratch(spark):
    with run_folder(spark) as folder:
        path = scratch_path(spark, "t")
        spark.range(3).write.parquet(path)
        assert path.startswith(folder) and Path(path.removeprefix("file:")).exists()
    assert not Path(folder.removeprefix("file:")).exists()
