"""Substring dedup: drop every word inside a long passage that also stands earlier.

Method: Rabin-Karp hashes of every window of ``width`` words, counted in Spark; windows
whose hash occurs earlier merge into maximal intervals, which are removed.

1. A task hashes all windows of its documents.  Of windows that repeat within a unit of
   a million, only the first is sent on; the later ones are already known to go.  So a
   passage that a third of all documents share is sent once a unit, not once a document.
2. The first ones go to buckets by one hash, packed by document: another hash of 7 bytes,
   the document and the place.  Each bucket finds the earliest of each hash.
3. The places of the others go back to their documents, where they merge into intervals.

The bucket's number and the 7 bytes come from independent hashes; the number of buckets
grows with the input, and so does the number of bits that two windows must share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import table, text_bytes

WIDTH = 20
#: Windows whose repeats a task finds by itself; about 150 bytes of memory each.
UNIT = 1_000_000
#: Bytes of text for each bucket: about 1.5 million windows.
BUCKET_BYTES = 10 << 20
#: Fewer buckets than this would leave a cluster idle.
LEAST_BUCKETS = 48
_PRIME = 2**31 - 1
_BLOCKS = (
    "bucket INT, rows INT, runs INT, hashes BINARY, ids BINARY, copies BINARY, sizes BINARY, places BINARY"
)
_MARKS = "part BIGINT, rows INT, runs INT, ids BINARY, copies BINARY, sizes BINARY, places BINARY"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type, size: int) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(data, size * kind.itemsize, "zstd", asbytes=True), kind)


def _by_document(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal documents: index of each run's first, its size; places as steps within a run."""
    fresh = np.ones(len(docs), bool)
    fresh[1:] = docs[1:] != docs[:-1]
    at = np.flatnonzero(fresh)
    steps = places.astype(np.int64).copy()
    steps[1:] -= places[:-1]
    steps[at] = places[at]
    return at, np.diff(np.append(at, len(docs))).astype(np.uint32), steps.astype(np.uint32)


def _restored(sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Places from the steps of ``_by_document``."""
    total = np.cumsum(steps.astype(np.int64))
    at = np.cumsum(sizes.astype(np.int64)) - sizes
    return total - np.repeat(total[at] - steps[at], sizes)


def _schema(names: str) -> pa.Schema:
    kinds = {"BIGINT": pa.int64(), "INT": pa.int32(), "BINARY": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in names.split(", "))])


def _batches(columns: list[list], names: str, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Lists of column values as record batches with the names and types of a schema string."""
    fields = _schema(names)
    for i in range(0, len(columns[0]), most):
        arrays = [pa.array(c[i : i + most], f.type) for c, f in zip(columns, fields, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=fields)


def _not_first(key: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Which windows have a key that one at a smaller spot has too.

    Windows at one spot are of rows that are equal in document and text; these are one
    document, so they do not remove each other.
    """
    order = np.lexsort((spot, key))
    sorted_key, sorted_spot = key[order], spot[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    later = np.empty(len(key), bool)
    later[order] = sorted_spot != sorted_spot[head]
    return later


def _ranks(ids: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct documents in order (ids, copies), and the rank among them of each given one."""
    order = np.lexsort((copies, ids))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (np.diff(ids[order]) != 0) | (np.diff(copies[order]) != 0)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    return ids[first], copies[first], rank


def _part(ids: np.ndarray, copies: np.ndarray, parts: int) -> np.ndarray:
    """The part of the table in which a document meets its marks; ``_part_column`` says the same."""
    mixed = (ids % _PRIME * 31 + copies) % _PRIME * 48271 % _PRIME
    return mixed % parts


def _part_column(parts: int):
    mixed = F.pmod(F.pmod(F.pmod("_id", F.lit(_PRIME)) * 31 + F.col("_copy"), F.lit(_PRIME)) * 48271, F.lit(_PRIME))
    return F.pmod(mixed, F.lit(parts))


def _hashed(width: int, buckets: int):
    """Documents to packed windows, as rows of _BLOCKS.

    Rows with a negative bucket hold, without hashes, the windows that are known to go already.
    """

    def emit(parts: list) -> Iterator[pa.RecordBatch]:
        ids, copies, docs, places, key, deal = (np.concatenate(x) for x in zip(*parts, strict=True))
        own_ids, own_copies, rank = _ranks(ids, copies)
        spot = rank[docs] << 32 | places
        later = _not_first(key ^ W.mix(deal), spot)
        aside = -1 - int(W.mix(key[:1])[0] % np.uint64(buckets))
        bucket = np.where(later, aside, (deal % np.uint64(buckets)).astype(np.int64))
        order = np.lexsort((spot, bucket))
        rows: list[list] = [[] for _ in range(8)]
        for run in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            at, sizes, steps = _by_document(spot[run] >> 32, spot[run] & 0xFFFFFFFF)
            owner = spot[run[at]] >> 32
            hashes = b"" if bucket[run[0]] < 0 else key[run].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
            arrays = map(_packed, (own_ids[owner], own_copies[owner], sizes, steps))
            for column, value in zip(rows, (int(bucket[run[0]]), len(run), len(at), hashes, *arrays), strict=True):
                column.append(value)
        yield from _batches(rows, _BLOCKS, 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, base = [], 0, 0
        for batch in W.slices(batches):
            found = W.split(batch.column("text"))
            hashes = W.word_hashes(found)
            start = W.window_starts(found, width)
            count = np.diff(found.first)
            text = np.repeat(np.arange(len(count)), count)[start]
            parts.append(
                (
                    batch.column("_id").to_numpy(),
                    batch.column("_copy").to_numpy(),
                    (text + base).astype(np.int64),
                    start - found.first[text],
                    W.window_hashes(hashes, width, W.ROLL_A)[start],
                    W.window_hashes(hashes, width, W.ROLL_B)[start],
                )
            )
            base, held = base + batch.num_rows, held + len(start)
            if held >= UNIT:
                yield from emit(parts)
                parts, held, base = [], 0, 0
        if held:
            yield from emit(parts)

    return run


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents (ids, copies), their numbers of windows, and the windows' places, of a row of _BLOCKS or _MARKS."""
    n, runs = row["rows"], row["runs"]
    sizes = _unpacked(row["sizes"], np.uint32, runs)
    places = _restored(sizes, _unpacked(row["places"], np.uint32, n))
    return _unpacked(row["ids"], np.int64, runs), _unpacked(row["copies"], np.int32, runs), sizes, places


def _marks(ids: np.ndarray, copies: np.ndarray, spot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Windows to go, at sorted spots of the ranked documents, as rows of _MARKS: one a part."""
    part = _part(ids, copies, parts)[spot >> 32]
    order = np.argsort(part, kind="stable")
    rows: list[list] = [[] for _ in range(7)]
    for run in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        at, sizes, steps = _by_document(spot[run] >> 32, spot[run] & 0xFFFFFFFF)
        owner = spot[run[at]] >> 32
        arrays = map(_packed, (ids[owner], copies[owner], sizes, steps))
        for column, value in zip(rows, (int(part[run[0]]), len(run), len(at), *arrays), strict=True):
            column.append(value)
    yield from _batches(rows, _MARKS)


def _later(parts: int):
    """Of a bucket, the windows whose hash an earlier one has, as rows of _MARKS."""

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        rows = blocks.to_pylist()
        ids, copies, sizes, places = (np.concatenate(x) for x in zip(*map(_opened, rows), strict=True))
        ids, copies, rank = _ranks(ids, copies)
        spot = np.repeat(rank, sizes) << 32 | places
        if key[0].as_py() >= 0:
            wide = np.zeros((len(spot), 8), np.uint8)
            wide[:, :7] = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint8).reshape(-1, 7)
            spot = spot[_not_first(wide.view(np.uint64).ravel(), spot)]
        return pa.Table.from_batches(list(_marks(ids, copies, np.unique(spot), parts)), _schema(_MARKS))

    return run


def _removed(width: int):
    """A part's documents and their marks to documents without the covered words."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        rows = marks.to_pylist()
        none = np.zeros(0, np.int64)
        ids, copies, sizes, places = (
            (np.concatenate(x) for x in zip(*map(_opened, rows), strict=True)) if rows else [none] * 4
        )
        owned: dict[tuple[int, int], list[np.ndarray]] = {}
        stop = np.cumsum(sizes.astype(np.int64))
        for i, c, a, b in zip(ids.tolist(), copies.tolist(), (stop - sizes).tolist(), stop.tolist(), strict=True):
            owned.setdefault((i, c), []).append(places[a:b])
        done = []
        for batch in W.slices(iter(docs.to_batches())):
            found = W.split(batch.column("text"))
            kept, gone, total, spans = [], [], np.diff(found.first), []
            keys = zip(batch.column("_id").to_pylist(), batch.column("_copy").to_pylist(), strict=True)
            for i, key in enumerate(keys):
                a, b = found.first[i], found.first[i + 1]
                covered = np.zeros(b - a + 1, np.int32)
                for some in owned.get(key, ()):
                    np.add.at(covered, some, 1)
                    np.add.at(covered, some + width, -1)
                out = np.cumsum(covered)[: b - a] > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                spans.append([{"start": int(s), "stop": int(e)} for s, e in turn.reshape(-1, 2)])
                gone.append(int(out.sum()))
                kept.append(b" ".join(found.text(j) for j in np.flatnonzero(~out) + a).decode("utf-8"))
            columns = [batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(total, pa.int64())]
            columns += [pa.array(gone, pa.int64()), pa.array(spans, _DONE.field("removed").type)]
            done.append(pa.RecordBatch.from_arrays(columns, schema=_DONE))
        return pa.Table.from_batches(done, _DONE)

    return run


_DONE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("kept_text", pa.string()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ]
)


def remove_substrings(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Each document without the words that repeated windows cover.

    Columns of ``docs`` that count: ``doc_id`` (BIGINT; null: after all others) and ``text``
    (null: no words); others are ignored.  A word goes if a window of ``width`` words covers
    it whose words also start earlier: in a smaller doc_id, or earlier in the same document.
    Documents that share a doc_id are ordered by a hash of their text; rows equal in both are
    one document, and get the same result.  Texts below ``width`` words keep everything.

    Returns doc_id, kept_text (words joined by a space), n_words, n_removed and ``removed``:
    the maximal intervals of removed words (start, stop exclusive).
    """
    buckets = max(LEAST_BUCKETS, -(-text_bytes(docs) // bucket_bytes))
    rows = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_id"),
        F.hash("text").alias("_copy"),
    )
    blocks = rows.select("_id", "_copy", "text").mapInArrow(_hashed(width, buckets), _BLOCKS)
    # As many partitions as buckets: a task's share does not grow with the table.
    marks = blocks.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_later(buckets), _MARKS)
    dealt = rows.withColumn("part", _part_column(buckets))
    return (
        dealt.repartition(buckets, "part")
        .groupBy("part")
        .cogroup(marks.repartition(buckets, "part").groupBy("part"))
        .applyInArrow(
            _removed(width),
            "doc_id BIGINT, kept_text STRING, n_words BIGINT, n_removed BIGINT, "
            "removed ARRAY<STRUCT<start: BIGINT, stop: BIGINT>>",
        )
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table without the words of passages that stand earlier."""
    done = remove_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM words WHERE len(w) >= 20)
),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS nth FROM windows
  ) WHERE nth > 1
),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(0, 20) AS t(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM words)
SELECT d.doc_id, count(e.i) AS n_words, count(g.i) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN g.i IS NULL THEN e.word END, ' ' ORDER BY e.i), '')) AS kept_sha256
FROM words d LEFT JOIN each e ON e.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
GROUP BY d.doc_id
"""
