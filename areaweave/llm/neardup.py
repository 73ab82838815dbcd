"""Near-duplicate documents by HyperMinHash, banding, and exact checks.

1. Signature.  A document's set is hashed; the high bits of a hash choose one of REGISTERS
   buckets, the least rest in a bucket is kept as its number of leading zeros and MANTISSA
   bits after them.  Empty buckets borrow from others by a fixed random probing, so that
   short texts compare as well as long ones.
2. Documents with the same set are one class; only its smallest doc_id goes on.
3. Banding.  BAND registers in a row, hashed, make a key; documents that share a key may be
   linked.  Two sets with a similarity of 0.75 share none with a probability of 1e-8.
4. Leader round.  Everyone is compared with the smallest document of each key: first by the
   collision-corrected estimate, then, if that is near enough, on the full sets.
5. Closing round.  Keys whose members are not all in one component yet: members are dealt to
   blocks, and every pair of blocks is one small task, which compares members of different
   components, again first by estimate.  So no key, however many members it has, meets in
   one task, no pairs are shuffled, and no link is lost.
6. Components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import join_facts, table, written
from areaweave.llm.components import components
from areaweave.operators.scale import broadcast_checked

SHINGLE, PERCENT = 5, 75
REGISTERS, MANTISSA, BAND = 256, 10, 4
#: Keys of each document; the registers beyond them serve the estimate alone.
KEYS = 48
#: Estimates this far below the threshold are still checked: five standard deviations.
MARGIN = 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Members of a block; a task of the closing round compares two blocks.
BLOCK = 1024
_BITS = int(REGISTERS).bit_length() - 1


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, A-Z lowered."""
    found = W.split(texts, lower=True)
    hashes = W.word_hashes(found)
    out = []
    rolled = W.window_hashes(hashes, SHINGLE, W.ROLL_B)
    for a, b in zip(found.first.tolist(), found.first[1:].tolist(), strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:  # fewer words: all of them as one
            out.append(W.window_hashes(hashes[a:b], b - a, W.ROLL_A + 2 * (b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _probes() -> np.ndarray:
    """For each bucket, the buckets it looks at in turn when it is empty."""
    at = np.arange(REGISTERS, dtype=np.uint64)
    tries = np.arange(1, 16 * REGISTERS + 1, dtype=np.uint64)
    return (W.mix(tries[:, None] * np.uint64(0x9E3779B97F4A7C15) + at) % np.uint64(REGISTERS)).astype(np.int64)


_PROBES: list[np.ndarray] = []


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each set; zeros for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if not _PROBES:
        _PROBES.append(_probes())
    for i, s in enumerate(sets):
        if not len(s):
            continue
        bucket = (s >> np.uint64(64 - _BITS)).astype(np.int64)
        first = np.ones(len(s), bool)
        first[1:] = bucket[1:] != bucket[:-1]  # the set is sorted: a bucket's first is its least
        rest = s[first] << np.uint64(_BITS) | np.uint64(1 << (_BITS - 1))
        zeros = 64 - np.frexp(rest.astype(np.float64))[1]
        zeros = np.maximum(zeros, 0)
        after = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        out[i, bucket[first]] = (np.minimum(zeros, 62) + 1) << MANTISSA | after.astype(np.int64)
    row, column = np.nonzero((out == 0) & (out.max(1) > 0)[:, None])
    filled = out > 0
    for probe in _PROBES[0]:
        if not len(row):
            break
        source = probe[column]
        ready = filled[row, source]
        out[row[ready], column[ready]] = out[row[ready], source[ready]]
        row, column = row[~ready], column[~ready]
    for r, c in zip(row.tolist(), column.tolist(), strict=True):  # no luck in all probes
        out[r, c] = out[r, np.flatnonzero(filled[r])[c % filled[r].sum()]]
    return out


def similarity(equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of equal registers, less those equal by chance."""
    ratio = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
    chance = 0.1699 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return (equal / REGISTERS - chance) / (1 - chance)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        sets = shingle_sets(batch.column("text"))
        registers = signatures(sets)
        mixed = [W.mix(s ^ np.uint64(0x5851F42D4C957F2D)) for s in sets]
        prints = np.array([[s.sum(dtype=np.uint64), np.bitwise_xor.reduce(m)] if len(s) else [0, 0] for s, m in zip(sets, mixed, strict=True)], np.uint64)
        prints = prints.reshape(-1, 2).view(np.int64)
        columns = [
            batch.column("doc_id"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array(prints[:, 0].copy()),
            pa.array(prints[:, 1].copy()),
            pa.array([r.tobytes() for r in registers], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "p", "q", "registers"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures to one row of all band keys."""
    for batch in batches:
        registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16)
        bands = registers.reshape(batch.num_rows, REGISTERS // BAND, BAND).astype(np.uint64)
        packed = sum(bands[:, :, k] << np.uint64(16 * k) for k in range(BAND))
        keys = W.mix(packed[:, :KEYS] + W.mix(np.arange(KEYS, dtype=np.uint64)))
        flat = pa.array(keys.view(np.int64).ravel())
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * KEYS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["node", "keys"]
        )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of equal ``task``; they come sorted by it, and a run is small."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        task = batch.column("task").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1), len(task)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b == a:
                continue
            part = batch.slice(a, b - a)
            if held and held[-1].column("task")[0] != part.column("task")[0]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _estimated(group: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of a task, the later ones that it must be compared with and may be linked to.

    Members of one component need no comparison; where the task has a leader, only that one
    is compared; and a pair that shares an earlier key than this task's is left to that.
    """
    side = group.column("side").to_numpy()
    part = group.column("part").to_numpy()
    n = group.column("n").to_numpy().astype(float)
    band = group.column("band")[0].as_py()
    registers = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(n), REGISTERS)
    leader = band < 0
    bands = registers.reshape(len(n), REGISTERS // BAND, BAND)
    for i in range(len(n) - 1):
        if leader and i:
            break
        later = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        later = later[np.minimum(n[later], n[i]) * 100 >= PERCENT * np.maximum(n[later], n[i])]
        if not leader:
            if (side != side[0]).any():  # two blocks: only pairs across them
                later = later[side[later] != side[i]]
            if band and len(later):
                later = later[~(bands[later, :band] == bands[i, :band]).all(2).any(1)]
        if len(later):
            equal = (registers[later] == registers[i]).sum(1)
            yield i, later[similarity(equal, n[later], n[i]) >= PERCENT / 100 - MARGIN]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task, the members that the estimate lets through with some other."""
    for group in _groups(batches):
        chosen = np.zeros(group.num_rows, bool)
        for i, others in _estimated(group):
            chosen[others] = True
            chosen[i] |= len(others) > 0
        if chosen.any():
            yield group.filter(pa.array(chosen))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links confirmed on the full sets; within a task only those that join its components."""
    for group in _groups(batches):
        text = group.column("text")
        sets: dict[int, np.ndarray] = {}
        part = {p: p for p in group.column("part").to_pylist()}
        own, nodes = group.column("part").to_pylist(), group.column("node").to_pylist()

        def root(p: int, part: dict[int, int] = part) -> int:
            while part[p] != p:
                part[p] = part[part[p]]
                p = part[p]
            return p

        def of(i: int, sets: dict[int, np.ndarray] = sets, text: pa.Array = text) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets(text.slice(i, 1))[0]
            return sets[i]

        links = []
        for i, others in _estimated(group):
            for j in others.tolist():
                if root(own[i]) != root(own[j]):
                    a, b = of(i), of(j)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if 100 * both >= PERCENT * (len(a) + len(b) - both):
                        links.append((nodes[i], nodes[j]))
                        part[root(own[j])] = root(own[i])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


_TASK = "task BIGINT, node BIGINT, part BIGINT, side INT, band INT, n BIGINT, registers BINARY"


def _confirmed(tasks: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of the tasks' members: ``tasks`` has task, node, part, side and band."""
    members = tasks.join(nodes.select("node", "n", "registers"), "node")
    dealt = members.repartition("task").sortWithinPartitions("task", "side", "node")
    near = written(dealt.select(*[c.split()[0] for c in _TASK.split(", ")]).mapInArrow(_candidates, _TASK))
    # Few documents are left; while their ids are few enough to be sent around, only their texts move.
    needed = texts.join(broadcast_checked(near.select("node").distinct(), row_bytes=64), "node", "left_semi")
    full = near.join(needed, "node").repartition("task").sortWithinPartitions("task", "side", "node")
    return written(full.mapInArrow(_linked, "a BIGINT, b BIGINT"))


def _blocks(count: str):
    return F.ceil(F.col(count) / BLOCK).cast("int")


def _leader_tasks(members: DataFrame) -> DataFrame:
    """Each document beside the smallest one of each of its keys, at most BLOCK a task."""
    pairs = members.filter("node <> leader").select("leader", "node").distinct()
    degree = written(pairs.groupBy("leader").agg(F.count("*").alias("_degree")))
    dealt = join_facts(pairs, degree, ["leader"], "_degree")
    block = F.pmod(F.xxhash64("node"), _blocks("_degree"))
    dealt = dealt.select("leader", "node", F.xxhash64("leader", block).alias("task"))
    led = dealt.select("task", F.col("leader").alias("node"), F.lit(0).alias("side")).distinct()
    both = led.unionByName(dealt.select("task", "node", F.lit(1).alias("side")))
    return both.select("task", "node", F.col("node").alias("part"), "side", F.lit(-1).alias("band"))


def _closing_tasks(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of keys that are not of one component yet, in pairs of blocks."""
    part = F.coalesce("component", "node")
    parted = written(members.join(found, "node", "left").select("key", "band", "node", part.alias("part")))
    still = (
        parted.groupBy("key")
        .agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.count("*").alias("_n"))
        .filter("_low <> _high")
        .drop("_low", "_high")
    )
    dealt = join_facts(parted, written(still), ["key"], "_n")
    own = F.pmod(F.xxhash64("node"), _blocks("_n"))
    dealt = dealt.select("key", "band", "node", "part", own.alias("_own"), F.explode(F.sequence(F.lit(0), _blocks("_n") - 1)).alias("_other"))
    return dealt.select(
        F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("task"),
        "node",
        "part",
        (F.col("_own") > F.col("_other")).cast("int").alias("side"),
        "band",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept, for each row.

    Links are confirmed on full sets: 100 * intersection >= 75 * union.  ``text`` null counts
    as empty, which is linked with nothing; a null doc_id takes no part (component null, kept
    true); repeated rows are kept or not together; rows that share a doc_id but not the text
    are judged each by its own; other columns do not count.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = written(rows.mapInArrow(_signed, "doc_id BIGINT, n BIGINT, p BIGINT, q BIGINT, registers BINARY"))
    known = signed.filter("doc_id IS NOT NULL AND n > 0")
    # Of each class of equal sets one document stands for all.
    nodes = written(
        known.groupBy("n", "p", "q").agg(
            F.min("doc_id").alias("node"), F.min_by("registers", "doc_id").alias("registers"), F.count("*").alias("_copies")
        )
    )
    keys = nodes.select(F.col("node").alias("doc_id"), "registers").mapInArrow(_keyed, "node BIGINT, keys ARRAY<BIGINT>")
    keyed = written(keys.select("node", F.posexplode("keys").alias("band", "key")))
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("_n")).filter("_n > 1")
    members = written(join_facts(keyed, written(shared), ["key"], "_n").select("key", "band", "node", "leader"))
    texts = rows.select(F.col("doc_id").alias("node"), "text").filter("node IS NOT NULL")

    first = _confirmed(_leader_tasks(members), nodes, texts)
    rest = _confirmed(_closing_tasks(members, components(first)), nodes, texts)
    found = components(first.unionAll(rest))

    of_class = nodes.join(found, "node", "left").select(
        "n", "p", "q", "_copies", F.coalesce("component", "node").alias("component_id")
    )
    linked = join_facts(known.select("doc_id", "n", "p", "q"), written(of_class), ["n", "p", "q"], "_copies")
    alone = signed.filter("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = linked.select("doc_id", "n", "component_id").unionByName(alone)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT DISTINCT a AS node, a AS other FROM edges
  UNION
  SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS kept
FROM words d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reached r ON r.node = d.doc_id
GROUP BY d.doc_id, s.n
"""
