"""Which input files of a Parquet table can be read, and what that means for the layers.

A scan that skips broken files would lose rows unseen, and one that does not ends the whole job.  The
ledger lists all files and holds them against what reading them yields, in the tasks: a file whose
rows cannot all be decoded has a problem, and every layer that it feeds gets a note.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from areaweave.operators.rules import LayerExtractionError
from areaweave.settings import DEFAULT_RULES

#: The last four bytes of every complete Parquet file (fixed value of that format).
_END_MARK = "PAR1"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All files of the table, whatever they hold: only names are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("_metadata.file_path").alias("file"), "length")


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per file of the table: file, n (rows that can be decoded) and problem, null if there is none.

    ``unreadable``: the file has no end mark or no row of it can be read; ``damaged``: its footer
    promises more rows than can be decoded.  A complete file without rows is sound.
    """
    scan = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").parquet(path)
    name = F.col("_metadata.file_path").alias("file")
    # A sum over hashes makes the scan decode every column; a count of rows alone comes from the footers.
    plain = [c for c in scan.columns if not isinstance(scan.schema[c].dataType, MapType)]
    maps = [F.map_entries(c) for c in scan.columns if c not in plain]
    decoded = scan.select(name, F.xxhash64(*plain, *maps).alias("h"))
    decoded = decoded.groupBy("file").agg(F.when(F.bit_xor("h").isNotNull(), F.count(F.lit(1))).alias("n"))
    promised = scan.select(name).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    known = _files(spark, path).join(decoded, "file", "left").join(promised, "file", "left")
    silent = known.where("n IS NULL").select("file")
    # Only of files without a row are the bytes looked at.
    bytes_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ends = bytes_.select(F.col("_metadata.file_path").alias("file"), "content").join(silent, "file", "left_semi")
    ends = ends.select("file", (F.substring("content", -4, 4) == F.lit(_END_MARK).cast("binary")).alias("ended"))
    judged = known.join(ends, "file", "left")
    problem = (
        F.when(F.col("n").isNull() & ~F.coalesce("ended", F.lit(False)), "unreadable")
        .when(F.col("n").isNull() & (F.coalesce("rows", F.lit(0)) > 0), "unreadable")
        .when(F.col("n") < F.col("rows"), "damaged")
    )
    return judged.select("file", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), problem.alias("problem"))


def input_notes(ledger: DataFrame, rules: dict | None = None) -> DataFrame:
    """layer, position, failed and message for every layer with a broken input file.

    A file in a folder ``layer=…`` feeds that layer, any other file all of them.
    """
    names = list(DEFAULT_RULES if rules is None else rules)
    listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("layer")) for i, n in enumerate(names)])
    own = F.nullif(F.regexp_extract("file", r"/layer=([^/]+)/", 1), F.lit(""))
    broken = ledger.where("problem IS NOT NULL").withColumn("_own", own).select("_own", F.inline(listed))
    counts = broken.where("_own IS NULL OR _own = layer").groupBy("position", "layer").agg(F.count(F.lit(1)).alias("n"))
    message = F.format_string("Layer '%s' failed to extract: %d of its input files cannot be read.", "layer", "n")
    return counts.select("position", "layer", F.lit(True).alias("failed"), message.alias("message"))


def check_inputs(notes: DataFrame) -> None:
    """Raise for the first layer, in rule order, with a broken input; all layers are known by then."""
    first = notes.orderBy("position").limit(1).collect()
    if first:
        raise LayerExtractionError(first[0]["message"])
