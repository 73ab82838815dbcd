"""A training corpus from raw documents: five stages, each a table for the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All
but the last return the columns of ``docs``.  Null and empty texts, null doc_ids, repeated
rows and further columns pass as each operator's docstring says; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import bpe, decontaminate, lines, neardup, quality
from areaweave.llm.common import table, written
from areaweave.operators.scale import broadcast_checked


def _names(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _own(columns: list[str], rest: str) -> list[Column]:
    """The columns of a table of which all but doc_id and text are fields of ``rest``."""
    return [F.col(c) if c in ("doc_id", "text") else F.col(rest).getField(c).alias(c) for c in columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for the lowest grade."""
    rest = [F.col(c) for c in _names(docs.columns) if c not in ("`doc_id`", "`text`")] or [F.lit(0)]
    judged = quality.select_quality(docs.select("doc_id", "text", F.struct(*rest).alias("_rest")), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*_own(docs.columns, "_rest"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages of three lines; ``n_chars`` follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = lines.remove_lines(docs, rest=rest)

    def value(c: str) -> Column:
        if c == "n_chars":
            return F.length("kept_text").cast(docs.schema[c].dataType).alias(c)
        plain = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
        return plain[c].alias(c) if c in plain else F.col("rest").getField(c).alias(c)

    return done.select(*map(value, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    judged = neardup.near_duplicates(docs)
    # A doc_id goes only if none of its rows stays.
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id")
    return docs.join(broadcast_checked(written(gone), row_bytes=32), "doc_id", "left_anti").select(*_names(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text they decode to, as digests."""
    return bpe.digests(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifier, the graph's components and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
