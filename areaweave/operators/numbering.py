"""Row numbers 0..n-1 per group without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaweave.operators.scale import through_table

# More copies of one row than this are spread over several tasks when unfolded.
_COPIES_PER_TASK = 100_000


def number_rows(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the position of each row in its group, by ``order``.

    ``order`` must tell any two different rows apart; equal rows are numbered in
    turn.  Equal rows are folded first (combining on the map side), so no sort key
    is crowded and the ranges are balanced.  Each range then numbers
    its own rows, and the counts of the ranges before it are added.  The ranges
    are written to a table first, since both steps must see the same ones.
    """
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    placed = through_table(
        folded.repartitionByRange(*groups, *order).withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*groups, "_slice")
        .agg(F.sum("_copies").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = (
        Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    started = (
        placed.withColumn("_start", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
        .join(offsets, [*groups, "_slice"])
        .withColumn("_start", F.col("_start") + F.col("_offset"))
    )
    started = started.withColumn("_stop", F.col("_start") + F.col("_copies") - 1)
    most = placed.agg(F.max("_copies")).head()[0] or 0
    if most > _COPIES_PER_TASK:
        chunk = F.explode(F.sequence(F.col("_start"), F.col("_stop"), F.lit(_COPIES_PER_TASK)))
        started = (
            started.withColumn("_start", chunk)
            .withColumn("_stop", F.least("_stop", F.col("_start") + _COPIES_PER_TASK - 1))
            .repartition(*groups, "_start")
        )
    numbered = started.withColumn(name, F.explode(F.sequence("_start", "_stop")))
    return numbered.select(*df.columns, name)
