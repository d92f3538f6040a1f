"""Connected components of a graph held in DataFrames, by contraction towards neighbours of least rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import materialise


def _ranked(node: str, round_: int) -> Column:
    """A node behind its rank of a round: its own number in even rounds, a hash of its own for each odd one."""
    rank = F.col(node) if round_ % 2 == 0 else F.xxhash64(F.lit(round_), F.col(node))
    return F.struct(rank.alias("rank"), F.col(node).alias("to"))


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: bigint); root is the smallest node it reaches.

    Each round, every node steps to whichever of itself and its neighbours has
    the least rank; edges are drawn between where their ends went, loops and
    repeated edges go. Ranks are the nodes' numbers in every other round, which
    makes a star around its smallest node one node at once, and hashes in the
    others, which leave half of a path's nodes on average in whatever order they
    are numbered. So a chain of n nodes takes about 2 log2(n) rounds. Every
    round's tables are written to the shared folder; only whether any edge is
    left reaches the driver. Joins read written tables on both sides, so
    adaptive execution can split a node that many edges share. `rounds`, if
    given, gets one number per round.
    """
    spark = edges.sparkSession
    tidy = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    left = materialise(tidy(edges), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        k = len(steps)
        both = left.select(F.col("a").alias("node"), _ranked("b", k).alias("near")).unionByName(left.select(F.col("b").alias("node"), _ranked("a", k).alias("near")))
        best = both.groupBy("node").agg(F.min("near").alias("near"))
        step = materialise(best.select("node", F.least("near", _ranked("node", k))["to"].alias("to")), "step")
        steps.append(step)
        moved = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        left = materialise(tidy(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), "edges")
        if rounds is not None:
            rounds.append(k)
    if not steps:
        return spark.createDataFrame([], "node bigint, root bigint")
    found = steps[0].select("node", F.col("to").alias("end"))
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("end"), "to")
        found = materialise(found.join(onward, "end", "left").select("node", F.coalesce("to", "end").alias("end")), "ends")
    least = materialise(found.groupBy("end").agg(F.min("node").alias("root")), "least")
    return found.join(least, "end").select("node", "root")
