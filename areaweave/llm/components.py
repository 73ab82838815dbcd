"""Connected components of a graph whose links are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.llm.common import join_facts, written


def _state(edges: DataFrame) -> tuple:
    """Number and hash sums of distinct edges: equal only for equal tables, bar a chance of 2 ** -128."""
    sums = [F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *sums).head())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for all nodes of ``links`` (a, b).

    Rounds of "large star" and "small star": every node ties its larger neighbours, and then
    itself and its smaller ones, to the smallest.  Each round roughly halves all distances,
    so the number of rounds grows with the logarithm of the longest path.  A node's
    neighbours are aggregated to their minimum before the shuffle and never collected, and
    rows of a node with very many neighbours stay where they are (``join_facts``).
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = join_facts(both.filter("v > u"), written(least), ["u"], "_n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct())
        smallest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = (
            join_facts(large, written(smallest), ["u"], "_n")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        edges, before = written(small), state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
