"""Look-alike domains against a large table of legitimate names, by an inverted index of q-grams.

A candidate domain imitates a legitimate one when it contains the
legitimate domain's first label and is not that domain. With a few names this
is one ``contains`` a name in the row (``domains.lookalike_count``); with
thousands that is a nested loop. Here every first label is indexed under one
of its own grams: of its grams of length ``min(q, len(label))``, the one that
the fewest distinct candidates hold. A candidate can contain a label only if
it contains each of the label's grams, that one included, so joining the
candidates' grams with the chosen grams finds every pair; each found pair is
then verified exactly. A label of length 0 is in every candidate; such names
are counted as a number, less the candidates that equal them, and never
joined. All joins are equi-joins; a side is broadcast only by its measured
size, and a hot key (a gram most candidates hold, a domain of a third of the
rows) is salted over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsieve.operators.lineage import lookup

#: Longest gram a label is indexed by.
Q = 3


def first_label(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def grams(text: Column, length: Column | int) -> Column:
    """Every substring of ``length`` code points, in order; none if the text is shorter or null."""
    n = F.lit(length) if isinstance(length, int) else length
    count = F.length(text) - n + 1
    return F.when(
        (n > 0) & (count > 0),
        F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, n)),
    ).otherwise(F.array().cast("array<string>"))


def _candidate_grams(candidates: DataFrame, q: int) -> DataFrame:
    """(d, gram): the distinct grams of lengths 1 to q of every distinct candidate."""
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col("d"), g) for g in range(1, q + 1)])))
    return candidates.select("d", F.explode(every).alias("gram"))


def pairs(candidates: DataFrame, legitimate: DataFrame, q: int = Q) -> DataFrame:
    """(d, legit, copies): candidates ``d`` that imitate ``legit``, ``copies`` rows of it in the table.

    ``candidates`` has a column ``d`` and ``legitimate`` a column ``legit``;
    nulls in either match nothing. Pairs with an empty first label are not
    here (see ``counts``).
    """
    cands = candidates.select("d").where(F.col("d").isNotNull()).distinct()
    names = (
        legitimate.where(F.col("legit").isNotNull()).groupBy("legit").agg(F.count("*").alias("copies"))
        .withColumn("label", first_label(F.col("legit")))
        .where(F.length("label") > 0)
    )
    held = _candidate_grams(cands, q)
    rarity = held.groupBy("gram").agg(F.count("*").alias("held"))
    own = names.select("legit", "label", "copies", F.explode(F.array_distinct(grams(F.col("label"), F.least(F.length("label"), F.lit(q))))).alias("gram"))
    # A gram that no candidate holds has rarity 0: such a name can match nothing, and finds nothing.
    ranked = own.join(rarity, "gram", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    chosen = ranked.groupBy("legit", "label", "copies").agg(F.min(F.struct("held", "gram")).getField("gram").alias("gram"))
    found = lookup(held, chosen, "gram", F.col("d"), how="inner")
    return found.where(F.col("d").contains(F.col("label")) & (F.col("d") != F.col("legit"))).select("d", "legit", "copies")


def counts(candidates: DataFrame, legitimate: DataFrame, q: int = Q) -> DataFrame:
    """(d, lookalikes): for every distinct non-null candidate, the rows of ``legitimate`` it imitates."""
    cands = candidates.select("d").where(F.col("d").isNotNull()).distinct()
    by_index = pairs(cands, legitimate, q).groupBy("d").agg(F.sum("copies").alias("n"))
    empty = legitimate.where(F.col("legit").isNotNull() & (F.length(first_label(F.col("legit"))) == 0))
    everywhere = empty.count()
    total = cands.join(by_index, "d", "left").select("d", F.coalesce("n", F.lit(0)).alias("n"))
    if everywhere:
        same = empty.groupBy(F.col("legit").alias("d")).agg(F.count("*").alias("same"))
        total = total.join(same, "d", "left").select(
            "d", (F.col("n") + F.lit(everywhere) - F.coalesce("same", F.lit(0))).alias("n")
        )
    return total.select("d", F.col("n").cast("long").alias("lookalikes"))


def row_lookalikes(rows: DataFrame, key: str, domains: str, legitimate: DataFrame, q: int = Q) -> DataFrame:
    """(key, lookalikes): per row, the (element, legitimate row) pairs that are look-alikes.

    Elements are counted as often as they occur in the row's array; null or
    empty arrays and null elements give 0. Rows with equal keys are summed.
    """
    elements = rows.select(key, F.explode_outer(domains).alias("d"))
    per = counts(elements, legitimate, q)
    joined = lookup(elements, per, "d", F.col(key), how="left")
    return joined.groupBy(key).agg(F.coalesce(F.sum("lookalikes"), F.lit(0)).cast("long").alias("lookalikes"))
