"""Periodic runs of words in whole texts, by recursive frequency splitting and lag scans.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(MIN_LENGTH, MIN_EXPONENT * q) that no neighbouring word extends with the same period.

1. Splitting.  Every word of such a run occurs in it at least MIN_EXPONENT times, so a word that
   occurs less often in the current segment lies in no run and splits the segment.  The parts
   are segments again, with fewer words to count, until nothing splits any more.
2. Lags.  In a run of smallest period q, a window of t words, q <= t < 2q, occurs next exactly q
   words later.  So at each doubling of t the distances to the next equal window, where they
   stay the same long enough, name all lags that can have a run; they are few.
3. Lag scan.  A surviving segment is compared with itself at each of its lags; stretches of equal
   words that are long enough are the runs.

A task works on a batch of about two MB of texts (or one text) in flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import table

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Rounds of splitting; what a text made to need more has left is scanned all the same.
ROUNDS = 200


def _ids(found: W.Words) -> np.ndarray:
    """A number for each word, equal only for equal bytes."""
    _, sample, which = np.unique(W.word_hashes(found), return_index=True, return_inverse=True)
    odd = np.flatnonzero(W.differ(found, np.arange(len(which)), sample[which])).tolist()
    own: dict[bytes, int] = {}
    for i in odd:  # another word with the hash of one before
        which[i] = own.setdefault(found.text(i), len(sample) + len(own))
    return which


def surviving(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Segments (start, end) that the splitting leaves, in order."""
    done: list[tuple[int, int]] = []
    place = np.arange(len(ids))
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for _ in range(ROUNDS):
        if not len(place):
            break
        _, which, count = np.unique(segment * (int(ids.max()) + 1) + ids[place], return_inverse=True, return_counts=True)
        stays = count[which] >= MIN_EXPONENT
        broken = np.zeros(int(segment[-1]) + 1, bool)
        broken[segment[~stays]] = True
        whole = ~broken[segment]
        done += _stretches(place[whole], segment[whole])
        place, segment = place[stays & ~whole], segment[stays & ~whole]
        # What is left falls into new segments; those too short for a run go.
        new = _stretches(place, segment)
        keep = [(a, b) for a, b in new if b - a >= MIN_LENGTH]
        sizes = np.array([b - a for a, b in keep], np.int64)
        segment = np.repeat(np.arange(len(keep)), sizes)
        place = np.arange(len(segment)) + np.repeat(np.array([a for a, _ in keep], np.int64) - np.cumsum(sizes) + sizes, sizes)
    done += _stretches(place, segment)
    return sorted(s for s in done if s[1] - s[0] >= MIN_LENGTH)


def _stretches(place: np.ndarray, segment: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive places within a segment."""
    if not len(place):
        return []
    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(segment) != 0)) + 1
    start = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(place)]])
    return list(zip(place[start].tolist(), (place[end - 1] + 1).tolist(), strict=True))


def lags(ids: np.ndarray) -> list[int]:
    """The periods that a run in the segment ``ids`` may have, ascending."""
    found: set[int] = set()
    n, t = len(ids), 1
    code = np.unique(ids, return_inverse=True)[1]
    while True:
        # code[i] stands for the t words from i on; d[i] is the distance to the next equal one.
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        d = np.zeros(len(code), np.int64)
        d[order[:-1][same]] = np.diff(order)[same]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1, [len(d)]])
        q, size = d[cut[:-1]], np.diff(cut)
        fits = (2 * q > t) & (q <= t) & (size >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q) - q - t + 1)
        found.update(q[fits].tolist())
        if 4 * t >= n:  # the next doubling is for periods beyond t, whose runs have over 4 * t words
            return sorted(found)
        code = np.unique(code[:-t] * np.int64(len(code)) + code[t:], return_inverse=True)[1]
        t *= 2


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs within a segment, by start and then period."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for q in lags(ids):
        equal = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edge = np.flatnonzero(np.diff(equal.view(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(MIN_LENGTH, MIN_EXPONENT * q):
                out.setdefault((a, b + q), (a, b - a + q, q))  # a smaller period of the same stretch came before
    return sorted(out.values(), key=lambda r: (r[0], r[2]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        found = W.split(batch.column("text"))
        first, n = found.first, batch.num_rows
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        keep = np.ones(len(found.start), np.int8)
        if len(found.start):
            ids = _ids(found)
            for a, b in surviving(ids, first):
                text = int(np.searchsorted(first, a, "right")) - 1
                for start, length, period in runs_of(ids[a:b]):
                    keep[a + start + period : a + start + length] = 0
                    runs[text].append((a + start - int(first[text]), length, period))
        # The kept words of every text, each followed by a space.
        kept = np.flatnonzero(keep)
        size = found.end[kept] - found.start[kept]
        stop = np.cumsum(size + 1)
        data = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
        inner = np.arange(int(size.sum()))
        shift = np.repeat(np.cumsum(size) - size, size)
        data[inner - shift + np.repeat(stop - size - 1, size)] = found.data[inner - shift + np.repeat(found.start[kept], size)]
        cut = np.concatenate([[0], stop])[np.searchsorted(kept, first)].tolist()
        raw = data.tobytes()
        flat = [r for of in runs for r in of]
        columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(of) for of in runs])]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(first)),
                pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, ["start", "length", "period"])),
                pa.array([raw[a : max(a, b - 1)].decode("utf-8") for a, b in zip(cut, cut[1:])], pa.string()),
            ],
            ["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period) and ``collapsed`` for each row.

    ``runs`` are sorted by start, then period; ``collapsed`` is the text without the words that
    some run holds after its first period, joined by one space.  ``text`` null or empty has no
    words and no runs; texts of any length are one row's work; rows with a null or repeated
    doc_id are judged each by its own text; other columns do not count.
    """
    schema = "doc_id BIGINT, n_words BIGINT, runs ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>, collapsed STRING"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_found, schema)


def with_cycles(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth, chosen by crc32 of doc_id, repeat a passage from some word to their end.

    With h = crc32(doc_id), g = h div 10 and n words, the words from a = g % n on repeat with
    period 1 + (n - a) div (3 + g % 8) where h is divisible by ten.  A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "w", F.expr(r"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END")
    )
    sized = words.withColumn("a", F.expr("CASE WHEN size(w) > 0 THEN h div 10 % size(w) END")).withColumn(
        "p", F.expr("1 + (size(w) - a) div (3 + h div 10 % 8)")
    )
    turned = "array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[int(a + (i - a) % p)] END), ' ')"
    return sized.select("doc_id", F.expr(f"CASE WHEN a IS NOT NULL THEN {turned} ELSE text END").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_cycles(table(spark, sf_dir, "documents")))
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("_best", longest).select(
        "doc_id",
        "n_words",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.s").alias("start"),
        (-F.col("_best.l")).alias("length"),
        F.col("_best.p").alias("period"),
        F.expr("-1000 * _best.l div _best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The polynomial of crc32 is a fixed value.  Equal stretches grow from pairs of equal triples of words.
ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295::BIGINT, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))
    )) AS h
  FROM documents
),
cycles AS (
  SELECT doc_id, w, len(w) AS n, h, (h // 10) % nullif(len(w), 0) AS a FROM hashed
),
texts AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1]
      ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END)
    ELSE w END AS w
  FROM cycles
),
triples AS MATERIALIZED (
  SELECT doc_id, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g
  FROM (SELECT doc_id, n, w, unnest(range(0, n - 2)) AS i FROM texts WHERE n > 2)
),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM triples x JOIN triples y
  ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + 3 + q - min(i) AS l
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island
),
runs AS MATERIALIZED (
  SELECT doc_id, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l
),
of_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS all_runs,
    min({'l': -l, 's': s, 'q': q}) AS best
  FROM runs GROUP BY doc_id
),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT t.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS collapsed
  FROM texts t, (SELECT doc_id AS d, unnest(range(0, n)) AS i, unnest(w) AS word FROM texts) x
  WHERE x.d = t.doc_id AND NOT EXISTS (SELECT 1 FROM dropped y WHERE y.doc_id = x.d AND y.i = x.i)
  GROUP BY t.doc_id
)
SELECT t.doc_id, t.n::BIGINT AS n_words, coalesce(r.n_runs, 0)::BIGINT AS n_runs, r.best.s::BIGINT AS start,
  (-r.best.l)::BIGINT AS length, r.best.q::BIGINT AS period, ((-1000 * r.best.l) // r.best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(r.all_runs, '')) AS runs_sha256, sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM texts t LEFT JOIN of_doc r ON r.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""
