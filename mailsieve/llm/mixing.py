"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words; a document is wanted target /
source size times. The whole part of that is taken for certain. The fraction
left is an inclusion probability p, different from source to source. Documents
are ranked by Pareto's number, their random odds u / (1 - u) divided by their
inclusion odds p / (1 - p), and the smallest are taken until the source's words
are as near to its target as a whole document allows: a sample of fixed size.

The cut is found from sums over bins of the ranking number, three times finer
in turn, so no task sorts a source. Only documents in the last bin, a billionth
of the range, are ordered one by one. The random number is a hash of seed and
id: reruns, retries and partitions do not change the choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mailsieve.llm.frames import WORD, put_back, set_apart, with_small, written

_BITS, _LEVELS = 10, 3
CAP = 3


def _targets(sources: DataFrame, cap: int) -> DataFrame:
    """(source, source_size, target). Sources in code-point order, null last, weigh 1, 2, 3, 1, …

    Shares of the total by weight; a source above ``cap`` times its size stops
    there and the rest is shared again, until none is above. Ranks come from
    range slices, so the sources themselves may be many.
    """
    by_name = F.asc_nulls_last("source")
    ordered = written(sources.repartitionByRange(by_name).withColumn("slice", F.spark_partition_id()), "sources")
    before = W.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # a row a slice
    offsets = ordered.groupBy("slice").count().select("slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("slice").orderBy(by_name)) + F.col("offset") - 1
    weighed = written(
        ordered.join(F.broadcast(offsets), "slice").select(  # a row a slice
            "source", "source_size", (rank % 3 + 1).alias("weight"), (F.col("source_size") * cap).alias("most")
        ),
        "weights",
    )
    total = weighed.agg(F.sum("source_size")).head()[0] or 0
    share, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(share) > F.col("most")
        row = weighed.agg(
            F.count_if(above).alias("full"), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("taken"),
            F.sum(F.when(~above, F.col("weight"))).alias("free"),
        ).head()
        if row["full"] == full or not row["free"]:
            break
        full, share = row["full"], (total - row["taken"]) / row["free"]
    wanted = F.least(F.col("weight") * F.lit(share), F.col("most").cast("double"))
    return weighed.select("source", "source_size", wanted.alias("target"))


def _uniform(seed: int, key: Column) -> Column:
    """In [0, 1): 52 bits of md5 over seed and key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, cap: int = CAP,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(key, size, source_size, target, copies) and the kept columns, a row for every row.

    Size is the number of words, 0 for null text. A null source is a source of
    its own. Equal ids share their random number; ties go by key and size, so
    tied rows that differ in neither are alike in the result as well. A source
    without words, or an empty table, has target 0 and no copies.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    extra = [F.col(c).alias(f"_keep_{c}") for c in keep]
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), *extra)
    sized = written(sized, "sizes") if not keep else sized
    targets = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = written(
        targets.withColumn("whole", F.floor(wanted)).withColumn("p", wanted - F.col("whole"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    ).withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    u = _uniform(seed, F.col("key"))
    pareto = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    place = F.floor(pareto / (1 + pareto) * (1 << _BITS * _LEVELS))
    ranked = with_small(sized, targets, same, "inner").withColumn("place", F.when(F.col("p") > 0, place))

    cuts = targets.where("p > 0").select("_source", F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("before"), "left")
    for level in range(1, _LEVELS + 1):
        bin_ = F.shiftright("place", _BITS * (_LEVELS - level))
        inside = with_small(ranked.where("p > 0").select("source", "size", bin_.alias("bin")), cuts, same, "inner")
        sums = inside.where(F.shiftright("bin", _BITS) == F.col("cut")).groupBy("_source", "before", "left", "bin").agg(F.sum("size").alias("words"))
        upto = F.col("before") + F.sum("words").over(W.partitionBy("_source").orderBy("bin"))  # at most 1,024 rows
        crossing = sums.withColumn("upto", upto).where("upto >= left")
        cuts = written(
            crossing.groupBy("_source", "left").agg(
                F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before")
            ),
            "cuts",
        )
    placed = with_small(ranked, cuts.select(F.col("_source").alias("_cut_of"), "cut", "before"), F.col("source").eqNullSafe(F.col("_cut_of")))
    kept = [F.col(f"_keep_{c}").alias(c) for c in keep]
    out = [F.col("key").alias(key), *kept, "size", "source_size", "target"]
    # Without a crossing (rounding at p near 1) every document of the source is below the cut.
    sure = placed.where("place is null or cut is null or place != cut").select(
        *out, (F.col("whole") + F.when(F.col("place") < F.coalesce(F.col("cut"), F.lit(1 << 62)), 1).otherwise(0)).alias("copies")
    )
    order = W.partitionBy("source").orderBy("place", "pareto", "key", "size")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    at_cut = placed.where("place = cut").withColumn("pareto", pareto).withColumn("upto", upto).select(
        *out, (F.col("whole") + F.when(F.col("upto") - F.col("size") / 2 <= F.col("left"), 1).otherwise(0)).alias("copies")
    )
    return sure.unionByName(at_cut)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, cap: int = CAP) -> DataFrame:
    """The documents themselves, each as often as the plan takes it."""
    base, names = set_apart(docs)
    planned = plan_mix(base, names[key], names[text], names[source], seed, cap, keep=tuple(n for c, n in names.items() if c != key))
    copies = F.expr("explode(sequence(1L, copies))").alias("_copy")
    return planned.where("copies > 0").select("*", copies).select(*put_back(names))
