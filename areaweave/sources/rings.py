"""Closed rings from the open ways of a relation, as a distributed contraction of paths.

Every way has two ends.  Where exactly two ends of one relation and role meet at a node, whoever
arrives through one leaves through the other, so a way, taken in either direction, has one
follower.  The directed ways form cycles, two for each ring, one a direction.

Cycles are ordered by pointer doubling: after k rounds a way knows its 2^k-th follower, the least
way among those on the path to it, and how far that one is.  When nothing changes any more, all ways
of a cycle know the same least one, and their distances to it are their order.  A round is one
equi-join of small rows on keys that hold the way's own place, so a relation of any number of members
never meets in one row before it is rings, and the number of rounds grows with the logarithm of the
longest ring.

Both sides of these joins grow with the data, and packed files say little of the rows in memory, so
they are merge joins by hint: Spark's own size check would send many of them through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.operators.scale import through_table

_WAY = ["relation_id", "role", "pos"]


def ends(ways: DataFrame) -> DataFrame:
    """The two ends of every way: relation_id, role, pos, side (0 first, 1 last) and node."""
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.col("first_node").alias("node")),
        F.struct(F.lit(1).alias("side"), F.col("last_node").alias("node")),
    )
    return ways.select(*_WAY, F.inline(both))


def _directed(meetings: DataFrame) -> DataFrame:
    """Directed ways (dir 0: as drawn) with their follower, from the two ends that meet at each node."""
    one, two = F.col("_one"), F.col("_two")

    def step(arrives, leaves):
        # Arriving at the last end means going as drawn; so does leaving from the first end.
        return F.struct(
            arrives["pos"].alias("pos"),
            (1 - arrives["side"]).alias("dir"),
            leaves["pos"].alias("next_pos"),
            leaves["side"].alias("next_dir"),
        )

    return meetings.select("relation_id", "role", F.inline(F.array(step(one, two), step(two, one))))


def ordered_cycles(directed: DataFrame) -> DataFrame:
    """Adds to each directed way ``lead`` (pos, dir), the least of its cycle, and ``ahead``, the steps to it."""
    own = F.struct("pos", "dir")
    state = through_table(
        directed.select(
            "relation_id", "role", "pos", "dir", F.struct(F.col("next_pos").alias("pos"), F.col("next_dir").alias("dir")).alias("next"),
            own.alias("lead"), F.lit(0).cast("bigint").alias("ahead"),
        )
    )
    reach = 1
    while True:
        there = state.select(
            "relation_id", "role", F.struct("pos", "dir").alias("next"), F.col("next").alias("_next"),
            F.col("lead").alias("_lead"), (F.col("ahead") + reach).alias("_ahead"),
        )
        nearer = F.col("_lead") < F.col("lead")
        state = through_table(
            state.join(there.hint("merge"), ["relation_id", "role", "next"]).select(
                "relation_id", "role", "pos", "dir", F.col("_next").alias("next"),
                F.when(nearer, F.col("_lead")).otherwise(F.col("lead")).alias("lead"),
                F.when(nearer, F.col("_ahead")).otherwise(F.col("ahead")).alias("ahead"),
                nearer.alias("_changed"),
            )
        )
        if not state.where("_changed").limit(1).count():
            return state.drop("next", "_changed")
        reach *= 2


def stitch(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings (relation_id, role, pos, way_id, path) from open ways, and relations that fail.

    ``ways`` has relation_id, role, pos (unique within a relation), way_id, path, first_node and
    last_node.  A ring starts with its way of the least ``pos``, in the direction that one is drawn.
    Failing relations come with a reason: ``member_not_closed`` where an end meets no other,
    ``ring_branches`` where more than two meet, ``ring_too_short`` where a ring is no area.
    """
    met = ends(ways).groupBy("relation_id", "role", "node").agg(
        F.count("*").alias("_n"),
        F.min(F.struct("pos", "side")).alias("_one"),
        F.max(F.struct("pos", "side")).alias("_two"),
    )
    met = through_table(met.drop("node"))
    unfit = met.groupBy("relation_id").agg(F.bool_or(F.col("_n") == 1).alias("open"), F.bool_or(F.col("_n") > 2).alias("branches"))
    bad = unfit.where("open OR branches").select(
        "relation_id", F.when(F.col("open"), "member_not_closed").otherwise("ring_branches").alias("reason")
    )
    sound = met.join(bad.select("relation_id").hint("merge"), "relation_id", "left_anti")
    # Of a ring's two cycles the one counts that takes its first way as drawn.
    cycles = ordered_cycles(_directed(sound)).where("lead.dir = 0")
    taken = ways.join(cycles.hint("merge"), _WAY)
    turned = F.when(F.col("dir") == 0, F.col("path")).otherwise(F.reverse("path"))
    # The leader comes first; who is one step before it has the greatest place.  Each way brings all its vertices but the last.
    place = F.when(F.col("ahead") == 0, F.lit(0).cast("bigint")).otherwise(-F.col("ahead"))
    piece = F.struct((F.col("ahead") != 0).alias("later"), place.alias("place"), F.slice(turned, 1, F.size("path") - 1).alias("part"))
    first = F.col("lead.pos").alias("lead_pos")
    joined = taken.groupBy("relation_id", "role", first).agg(
        F.min_by("way_id", "pos").alias("way_id"), F.flatten(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["part"])).alias("_open")
    )
    closed = F.concat("_open", F.slice("_open", 1, 1))
    rings = joined.select("relation_id", "role", F.col("lead_pos").alias("pos"), "way_id", closed.alias("path"))
    rings = through_table(rings)
    short = rings.where(F.size("path") < 4).select("relation_id", F.lit("ring_too_short").alias("reason")).distinct()
    return rings.join(short.select("relation_id").hint("merge"), "relation_id", "left_anti"), bad.unionByName(short)
