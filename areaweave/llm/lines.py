"""Line dedup: drop lines of passages of three lines that also stand earlier.

Method: hash every run of three consecutive lines of a text, find the runs that occur more
than once in the whole table, and remove what later occurrences cover; overlapping ones
merge.  Only built-in functions; only hashes and places are shuffled until the texts meet
the places to drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm.common import join_facts, table, written
from areaweave.operators.scale import compute_once

WIDTH = 3
_WORD = r"[^\x20\x09-\x0D]"


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """Two independent hashes and the first line's number of each run of lines that has a word."""
    split = compute_once(rows, _lines=r"split(text, '\n', -1)").filter(F.size("_lines") >= width)
    lines = F.col("_lines")

    def run(i):
        parts = [F.get(lines, i + k) for k in range(width)]
        filled = F.concat(*parts).rlike(_WORD)
        # Two hashes of 64 bits: together no two runs of any corpus share them by chance.
        return F.when(filled, F.struct(i.alias("_at"), F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit(7), *parts).alias("_b")))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - width), run), lambda x: x.isNotNull())
    return split.select("_id", "_copy", F.inline(found))


def remove_lines(docs: DataFrame, width: int = WIDTH, rest: tuple[str, ...] = ()) -> DataFrame:
    """Each document without the lines that a repeated run of ``width`` lines covers.

    A line goes if it lies in a run of ``width`` consecutive lines, one of them with a word,
    that also stands earlier: in a smaller doc_id, or earlier in the same document.  Runs are
    judged on the input, not on what is left.  ``text`` null counts as empty; ``doc_id`` null
    comes last; rows that share a doc_id are ordered by a hash of their text, and rows equal
    in both share one verdict; other columns do not count.  Texts of fewer lines stay whole.

    Returns doc_id, kept_text, n_lines, n_removed, and, if columns are named as ``rest``, a
    struct ``rest`` that carries them along.
    """
    carried = [F.struct(*[f"`{c}`" for c in rest]).alias("rest")] if rest else []
    rows = docs.select(
        *carried,
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_id"),
        F.xxhash64("text").alias("_copy"),
    )
    windows = written(_windows(rows, width))
    place = F.struct("_id", "_copy", "_at")
    repeated = (
        windows.groupBy("_a", "_b")
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    later = join_facts(windows, written(repeated), ["_a", "_b"], "_n").filter(place != F.col("_first"))
    # A document's places stay within one row; there are no more of them than it has lines.
    marks = later.groupBy("_id", "_copy").agg(F.collect_set("_at").alias("_marks"))
    marked = rows.join(marks, ["_id", "_copy"], "left").select(*(["rest"] if rest else []), "doc_id", "text", "_marks")
    split = compute_once(
        marked,
        _lines=r"split(text, '\n', -1)",
        _gone=f"coalesce(array_distinct(flatten(transform(_marks, p -> sequence(p, p + {width - 1})))), array())",
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    return split.select(
        *(["rest"] if rest else []),
        "doc_id",
        F.when(F.size("_gone") == 0, F.col("text")).otherwise(text).alias("kept_text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table without repeated passages of three lines."""
    done = remove_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
numbered AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS i FROM lines),
runs AS (
  SELECT doc_id, i, line AS x, lead(line) OVER w AS y, lead(line, 2) OVER w AS z
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, i) AS nth
  FROM runs WHERE z IS NOT NULL AND regexp_matches(x || y || z, '[^\x20\x09-\x0D]')
),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE nth > 1)
SELECT n.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN n.line END, chr(10) ORDER BY n.i), '')) AS kept_sha256
FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i
GROUP BY n.doc_id
"""
