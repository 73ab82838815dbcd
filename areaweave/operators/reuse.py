"""Reuse of finished runs by content: an area is run again if its rules or what lies in it changed.

The fingerprint of an area is independent of the order and the partitioning of its features: two sums of
row hashes with different seeds, merged before the shuffle like any other aggregate.  Repeated
rows count as often as they occur.  It covers the boundary itself as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaweave.operators.audit import rules_hash

# Arrays within arrays hash as their elements do, so the sizes of parts and rings are hashed beside them.
_SHAPE = "flatten(transform({0}.parts, p_ -> concat(array(size(p_)), transform(p_, r_ -> size(r_)))))"


def _row_hash(df: DataFrame, columns: Sequence[str], seed: int) -> Column:
    """64 bits of a row; nulls leave Spark's hash as it is, so each column says whether it is one."""
    parts: list[Column] = [F.lit(seed)]
    for name in columns:
        parts += [F.col(name).isNull(), F.col(name)]
        if name == "geom":
            parts.append(F.expr(_SHAPE.format("geom")))
    return F.xxhash64(*parts)


def content_fingerprints(features: DataFrame, boundaries: DataFrame, marks: Sequence[str] = ()) -> DataFrame:
    """lga_id and content_hash of every area, those without features included.

    ``features`` are raw layer rows (extract_features), ``boundaries`` the accepted ones; all their
    columns count.  ``marks`` are notes that concern every area, such as those about broken input files.
    """
    columns = sorted(c for c in features.columns if c != "lga_id")
    # A sum of 64-bit hashes leaves 64 bits soon, and 38 digits only after 10^19 rows.
    sums = [F.sum(_row_hash(features, columns, seed).cast("decimal(28,0)")).cast("string").alias(f"_s{seed}") for seed in (1, 2)]
    found = features.groupBy("lga_id").agg(F.count(F.lit(1)).cast("string").alias("_n"), *sums)
    own = sorted(c for c in boundaries.columns if c != "lga_id")
    of_boundary = [_row_hash(boundaries, own, seed).cast("string").alias(f"_b{seed}") for seed in (1, 2)]
    every = boundaries.select("lga_id", *of_boundary).join(found, "lga_id", "left")
    text = F.concat_ws("|", "_b1", "_b2", F.coalesce("_n", F.lit("0")), "_s1", "_s2", *[F.lit(m) for m in sorted(marks)])
    return every.select("lga_id", F.md5(text).alias("content_hash"))


def pending_areas(fingerprints: DataFrame, runs: DataFrame, rules: dict | None = None) -> DataFrame:
    """lga_id of the areas without a record under the same rules and of the same content.

    Records from before fingerprints were kept have none, so their areas are run again.
    """
    if "content_hash" not in runs.columns:
        return fingerprints.select("lga_id")
    done = runs.where(F.col("rules_hash") == rules_hash(rules)).select("lga_id", "content_hash")
    return fingerprints.join(done, ["lga_id", "content_hash"], "left_anti").select("lga_id")
