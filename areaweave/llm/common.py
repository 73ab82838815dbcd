"""What several operators share: reading, intermediate tables, joins on keys that may be hot."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.operators.scale import shared_folder

#: A key is hot if it has more than one in so many rows, so there are at most so many hot keys.
HOT_KEYS = 1000
#: Bytes of a batch between Spark and Python.
BATCH = 2 << 20


def limit_batches(spark: SparkSession) -> None:
    """From now on batches between Spark and Python hold at most BATCH bytes, unless the session has its own limit.

    An executor holds several batches for each of its tasks, on both sides, so Spark's default of
    64 MB costs most of a small one.  Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe when executors are lost."""
    limit_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in the table."""
    return docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of many ``rows`` with at most one row of ``facts`` a key, safe for hot keys.

    ``count`` is the column of ``facts`` that says how many of ``rows`` have the key.  Keys
    with more than a thousandth of all counted rows are at most a thousand, so these facts
    are broadcast and their rows stay where they are.  Any other key is at most a thousandth
    of the rows, which no shuffle partition feels.
    """
    total = facts.agg(F.sum(count)).head()[0] or 0
    hot = facts.filter(F.col(count) * HOT_KEYS > total)
    cool = facts.filter(F.col(count) * HOT_KEYS <= total)
    if total < 100 * HOT_KEYS:
        return rows.join(F.broadcast(facts), keys)  # fewer than 100,000 rows in all
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    most = marked.filter("_hot IS NULL").drop("_hot").join(cool, keys)
    return most.unionByName(rows.join(F.broadcast(hot), keys).select(most.columns))


def labelled(docs: DataFrame, labels: DataFrame, grade: Column, most: int) -> DataFrame:
    """Up to ``most`` labelled documents of each value of ``grade``: doc_id, text, grade.

    The choice follows a hash of doc_id, so it is the same at any partitioning.  Rows of
    ``labels`` with a null doc_id or grade do not count; of several for one document the
    lowest grade does, and of several documents with one doc_id any one.
    """
    known = labels.select("doc_id", grade.cast("int").alias("grade")).dropna()
    known = known.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    known = written(known)
    # One bounded top list for each value; the values of a grade are few.
    lists = [
        known.filter(F.col("grade") == row["grade"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for row in known.select("grade").distinct().orderBy("grade").collect()
    ]
    chosen = known.limit(0)
    for one in lists:
        chosen = chosen.unionAll(one)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
