"""Exact, seeded, stratified splits and exact seeded row caps.

A row's place is decided by a hash of its id. What has to be found is only the
hash at which each stratum is cut, and that takes narrow columns: a histogram
of hash prefixes says in which prefix each cut falls, and only the rows of that
prefix are ranked. Wide rows are then compared with the cuts where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mailsieve.functions.hashing import seeded_hash
from mailsieve.operators.lineage import lookup, settle

_PREFIX = 4


def stratum_key(label: str = "label", channel: str = "channel") -> Column:
    return F.concat_ws("_", F.col(label).cast("string"), F.col(channel))


def _hashed(df: DataFrame, stratum: Column, seed: int, key: str) -> DataFrame:
    hashed = df.select(stratum.alias("_stratum"), seeded_hash(seed, F.col(key)).alias("_hash"))
    return hashed.withColumn("_prefix", F.substring("_hash", 1, _PREFIX))


def _cut_hashes(hashed: DataFrame, histogram: DataFrame, ranks: DataFrame) -> DataFrame:
    """The hash standing at each asked rank: (_stratum, _cut, _at).

    ``ranks`` holds (_stratum, _cut, _rank); rank 0 cuts before every hash.
    """
    running = W.partitionBy("_stratum").orderBy("_prefix")
    spans = histogram.select(
        "_stratum",
        "_prefix",
        F.sum("_n").over(running).alias("_to"),
        (F.sum("_n").over(running) - F.col("_n")).alias("_from"),
    )
    wanted = settle(
        ranks.where("_rank > 0")
        .join(spans, "_stratum")
        .where("_rank > _from and _rank <= _to")
        .select("_stratum", "_prefix", "_cut", (F.col("_rank") - F.col("_from")).alias("_local"))
    )
    prefixes = wanted.select("_stratum", "_prefix").distinct()
    ranked = hashed.join(prefixes, ["_stratum", "_prefix"], "left_semi").withColumn(
        "_local", F.row_number().over(W.partitionBy("_stratum", "_prefix").orderBy("_hash"))
    )
    found = ranked.join(wanted, ["_stratum", "_prefix", "_local"]).select(
        "_stratum", "_cut", F.col("_hash").alias("_at")
    )
    return found.unionByName(
        ranks.where("_rank = 0").select("_stratum", "_cut", F.lit("").alias("_at"))
    )


def _largest_remainder(strata: DataFrame, size: str, draw: Column, out: str) -> DataFrame:
    """Share ``draw`` rows among strata by size; left-over rows by largest remainder, then key.

    Whole-number arithmetic in decimals, exact far beyond 64 bits. The window
    runs over one row a stratum.
    """
    everything = W.partitionBy(F.lit(0))
    shared = strata.withColumns(
        {"_all": F.sum(size).over(everything), "_draw": draw.cast("decimal(18,0)")}
    )
    product = (F.col(size).cast("decimal(18,0)") * F.col("_draw")).cast("decimal(38,0)")
    shared = shared.withColumn("_rest", F.when(F.col("_all") > 0, product % F.col("_all")).otherwise(0))
    shared = shared.withColumn(
        "_whole",
        F.when(F.col("_all") > 0, ((product - F.col("_rest")) / F.col("_all")).cast("bigint")).otherwise(0),
    )
    left = F.col("_draw").cast("bigint") - F.sum("_whole").over(everything)
    turn = F.row_number().over(everything.orderBy(F.desc("_rest"), "_stratum"))
    return shared.withColumn(out, F.col("_whole") + (turn <= left).cast("bigint")).drop(
        "_all", "_draw", "_rest", "_whole"
    )


def split_quotas(strata: DataFrame, val_frac: float = 0.1, test_frac: float = 0.1) -> DataFrame:
    """Rows of every stratum (_stratum, _n) for train, val and test.

    First everything held out, rounded up; then test out of that, rounded up.
    """
    everything = W.partitionBy(F.lit(0))
    total = F.sum("_n").over(everything)
    hold = F.ceil(total * F.lit(val_frac + test_frac))
    quotas = _largest_remainder(strata, "_n", total - hold, "n_train")
    quotas = quotas.withColumn("_hold", F.col("_n") - F.col("n_train"))
    held = F.sum("_hold").over(everything)
    test = F.ceil(held * F.lit(test_frac / (val_frac + test_frac)))
    quotas = _largest_remainder(quotas, "_hold", held - test, "n_val")
    return quotas.select(
        "_stratum", "_n", "n_train", "n_val", (F.col("_hold") - F.col("n_val")).alias("n_test")
    )


def stratified_split(
    messages: DataFrame,
    seed: int = 42,
    val_frac: float = 0.1,
    test_frac: float = 0.1,
    key: str = "id",
    stratum: Column | None = None,
    strict: bool = True,
) -> DataFrame:
    """Adds ``split``: train, val or test, exact in every stratum and order-free.

    ``strict`` refuses a stratum with fewer than two rows in either step.
    """
    stratum = stratum_key() if stratum is None else stratum
    hashed = _hashed(messages, stratum, seed, key)
    histogram = settle(hashed.groupBy("_stratum", "_prefix").agg(F.count("*").alias("_n")))
    strata = histogram.groupBy("_stratum").agg(F.sum("_n").alias("_n"))
    quotas = settle(split_quotas(strata, val_frac, test_frac))
    if strict:
        thin = quotas.where("_n < 2 or n_val + n_test < 2").select("_stratum").head(5)
        if thin:
            raise ValueError(f"strata too thin to split: {[row[0] for row in thin]}")
    ranks = quotas.select(
        "_stratum",
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("_cut"), F.col("n_train").alias("_rank")),
                F.struct(F.lit("val").alias("_cut"), (F.col("n_train") + F.col("n_val")).alias("_rank")),
            )
        ).alias("_c"),
    ).select("_stratum", "_c.*")
    cuts = settle(
        _cut_hashes(hashed, histogram, ranks)
        .groupBy("_stratum")
        .agg(
            F.max(F.when(F.col("_cut") == "train", F.col("_at"))).alias("_train_to"),
            F.max(F.when(F.col("_cut") == "val", F.col("_at"))).alias("_val_to"),
        )
    )
    placed = messages.select("*", stratum.alias("_stratum"), seeded_hash(seed, F.col(key)).alias("_hash"))
    placed = lookup(placed, cuts, "_stratum", spread_by=F.col("_hash"))
    split = (
        F.when(F.col("_hash") <= F.col("_train_to"), "train")
        .when(F.col("_hash") <= F.col("_val_to"), "val")
        .otherwise("test")
    )
    return placed.select(*messages.columns, split.alias("split"))


def cap_rows(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly ``n`` rows drawn by hash without replacement; all when n <= 0 or n >= count.

    The draw is a filter at the n-th hash, so rows are neither sorted nor moved.
    """
    if n <= 0:
        return df
    hashed = _hashed(df, F.lit("all"), seed, key)
    histogram = settle(hashed.groupBy("_stratum", "_prefix").agg(F.count("*").alias("_n")))
    ranks = histogram.groupBy("_stratum").agg(F.sum("_n").alias("_n")).where(F.col("_n") > n)
    ranks = ranks.select("_stratum", F.lit("cap").alias("_cut"), F.lit(n).cast("bigint").alias("_rank"))
    found = _cut_hashes(hashed, histogram, ranks).head()
    if found is None:
        return df
    return df.where(seeded_hash(seed, F.col(key)) <= F.lit(found["_at"]))


def manifest(splits: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, positives, channels and content checksum of every split, in one aggregate."""
    columns = columns or [c for c in splits.columns if c != "split"]
    lanes = checksum_lanes(columns)
    counted = splits.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum("label").alias("n_phish"),
        F.count_if(F.col("channel") == "email").alias("n_email"),
        F.count_if(F.col("channel") == "sms").alias("n_sms"),
        *lanes,
    )
    return counted.select(
        "split", "rows", "n_phish", "n_email", "n_sms", checksum_of_lanes(F.col("rows")).alias("sha256")
    )


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: every value with its length in front, nulls marked apart."""
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        parts.append(
            F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit(":"), value), F.lit("~"))
        )
    return F.sha2(F.concat_ws("|", *parts), 256)


def checksum_lanes(columns: list[str]) -> list[Column]:
    """Sums over the four 64-bit parts of the row digests; partial sums are all that moves."""
    digest = row_digest(columns)
    return [
        F.sum(
            F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)").cast("decimal(28,0)")
        ).alias(f"_lane{i}")
        for i in range(4)
    ]


def checksum_of_lanes(rows: Column) -> Column:
    lanes = [F.coalesce(F.col(f"_lane{i}").cast("string"), F.lit("0")) for i in range(4)]
    return F.sha2(F.concat_ws("|", rows.cast("string"), *lanes), 256)


def content_checksum(df: DataFrame, columns: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Checksum of the rows as a bag: independent of order, files and partitions."""
    columns = columns or [c for c in df.columns if c not in by]
    summed = df.groupBy(*by).agg(F.count("*").alias("rows"), *checksum_lanes(columns))
    return summed.select(*by, "rows", checksum_of_lanes(F.col("rows")).alias("sha256"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight of every label: n / (labels * rows of the label)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = W.partitionBy(F.lit(0))
    total = F.sum("n").over(everything) / F.count("*").over(everything)
    return counts.select(label, "n", (total / F.col("n")).alias("weight"))
