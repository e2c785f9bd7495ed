"""Connected components of a link table, by contraction rounds that survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rainrisk.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: non-null longs); nodes share a root if and only if links connect them.

    Each round, a node hooks onto the neighbour with the least random priority if that beats its own, and links move
    to the hooks. Priorities change every round, so chains shrink by a constant factor; a star or clique
    goes in one round. Aggregates combine before their shuffle and joins read stored tables on both sides, so
    adaptive execution can split a node that many links share. Self links and repeats are ignored.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots, turn = None, 0
    while not links.isEmpty():
        def priority(c: str):
            return F.xxhash64(F.lit(turn), F.col(c))

        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.min(F.struct(priority("b").alias("p"), F.col("b").alias("node"))).alias("best"))
                       .select(F.col("a").alias("node"), F.when(F.struct(F.col("best.p"), F.col("best.node")) < F.struct(priority("a"), F.col("a")),
                                                                F.col("best.node")).otherwise(F.col("a")).alias("hook")))
        if roots is None:
            roots = hooks.withColumnRenamed("hook", "root")
        else:
            roots = stored(roots.join(hooks.withColumnRenamed("node", "root"), "root", "left")
                           .select("node", F.coalesce("hook", "root").alias("root")))
        for end in ("a", "b"):
            links = stored(links.join(hooks.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("hook", end))
        links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        turn += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
