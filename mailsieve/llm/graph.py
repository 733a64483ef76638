"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsieve.llm.frames import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of the links (a, b), the smallest node that it can be reached from.

    Every round a node takes the smallest root around it, then its root's root
    (pointer jumping), so rounds grow with the logarithm of the longest path.
    Each round's table is written, which cuts the lineage; minima are taken in
    each task before anything moves, so a node with many links is no burden.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        around = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        hooked = roots.join(around, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # The root itself takes the smallest root that one of its own nodes has found.
        offers = hooked.groupBy(F.col("was").alias("_to")).agg(F.min("root").alias("offer"))
        hooked = hooked.join(offers, F.col("node") == F.col("_to"), "left").select("node", "was", F.least("root", "offer").alias("root"))
        hooked = written(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("_root"), F.col("root").alias("jumped"))
        new = hooked.join(jump, F.col("root") == F.col("_root"), "left").select("node", "was", F.least("root", "jumped").alias("root"))
        new = written(new, "roots")
        if new.where("root != was").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")
