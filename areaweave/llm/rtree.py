"""Jaccard join of word n-gram sets through an R-tree of count vectors.

1. Points.  The n-grams of a document are hashed into groups, and the numbers in each group are
   the coordinates of its point.  Two sets share at most the sum of the lesser coordinates, so
   a pair whose sum is too small is no link.  Equal sets are one point.
2. Pages.  A link of sets with a and b members differs in at most (a + b) / 19 of them (at 90 %).  For
   documents of about one size the groups are dealt to more blocks than that, so linked points agree
   in all coordinates of some block.  A page of the tree holds the points that agree in a block: its
   box is flat there.  No link is lost, and a page of unlike documents has few points.
3. Boxes.  Within a page points are packed into leaves by size and by their widest coordinate; a
   leaf's box has the greatest coordinates and the least size.  Pairs of leaves, and then of points,
   go on only if the sum of the lesser coordinates reaches what their sizes need.
4. Verification of the surviving pairs on full sets, components of all links.

Every point of a page first meets the page's smallest document.  Only pages whose points are not
all in one component after that are searched for pairs; a page of more than PAGE points is dealt
to parts, and each pair of parts is one small task.  So no page, however full, meets in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import join_facts, table, written
from areaweave.llm.components import components
from areaweave.operators.scale import broadcast_checked

GRAM, PERCENT = 3, 90
#: Coordinates of a point, and groups of each block that decides on pages.
GROUPS, BLOCK_GROUPS = 64, 32
#: Points of a part of a page, of a leaf, and page keys kept with a point to meet a pair once.
PAGE, LEAF, SKETCH = 1024, 32, 32
_FULL = np.iinfo(np.uint16).max
_FACTORS = W.mix(np.arange(1, BLOCK_GROUPS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text, A-Z lowered; all words as one if they are fewer."""
    found = W.split(texts, lower=True)
    hashes = W.word_hashes(found)
    rolled = W.window_hashes(hashes, GRAM, W.ROLL_A)
    out = []
    for a, b in zip(found.first.tolist(), found.first[1:].tolist(), strict=False):
        if b - a >= GRAM:
            out.append(np.unique(rolled[a : b - GRAM + 1]))
        else:
            out.append(W.window_hashes(hashes[a:b], b - a, W.ROLL_B + 2 * (b - a)) if b > a else np.zeros(0, np.uint64))
    return out


#: Least set size of each class: a link's sizes lie in one class or in two that follow each other.
_CLASSES = [1]


def size_class(n: int) -> int:
    while _CLASSES[-1] <= n:
        _CLASSES.append(_CLASSES[-1] * 100 // PERCENT + 1)
    return bisect_right(_CLASSES, n) - 1


def blocks_of(size: int) -> int:
    """One more than a link between sets of this class, or the one before it, can differ in; 1: not at all."""
    while len(_CLASSES) < size + 2:
        _CLASSES.append(_CLASSES[-1] * 100 // PERCENT + 1)
    most = _CLASSES[size + 1] - 1
    return 2 * most * (100 - PERCENT) // (100 + PERCENT) + 1


def page_keys(grams: np.ndarray) -> np.ndarray:
    """The pages of a set: for its size class and the next one, a hash of the counts in each block."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    own, out = size_class(len(grams)), []
    spread = W.mix(grams ^ np.uint64(0x2545F4914F6CDD1D))
    group = (spread & np.uint64(BLOCK_GROUPS - 1)).astype(np.int64)
    for size in (own, own + 1):
        blocks = blocks_of(size)
        if blocks > 1:  # else a link must be the same set
            block = ((spread >> np.uint64(8)) % np.uint64(blocks)).astype(np.int64)
            counts = np.bincount(block * BLOCK_GROUPS + group, minlength=blocks * BLOCK_GROUPS)
            total = (counts.reshape(blocks, BLOCK_GROUPS).astype(np.uint64) * _FACTORS).sum(1, dtype=np.uint64)
            out.append(W.mix(total + W.mix(np.arange(blocks, dtype=np.uint64) + np.uint64(size << 40))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def point(grams: np.ndarray) -> np.ndarray:
    """Number of members in each group; the greatest number stands for it and all beyond."""
    counts = np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, _FULL).astype(np.uint16)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        sets = gram_sets(batch.column("text"))
        keys = [page_keys(s) for s in sets]
        prints = [
            (int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(W.mix(s ^ np.uint64(0x5851F42D4C957F2D))))) if len(s) else (0, 0)
            for s in sets
        ]
        prints = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(prints[:, 0].copy()),
                pa.array(prints[:, 1].copy()),
                pa.array([point(s).tobytes() for s in sets], pa.binary()),
                pa.array([np.sort(k)[:SKETCH].tobytes() for k in keys], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
            ],
            ["doc_id", "n", "p", "q", "point", "sketch", "pages"],
        )


_SIGNED = "doc_id BIGINT, n BIGINT, p BIGINT, q BIGINT, point BINARY, sketch BINARY, pages ARRAY<BIGINT>"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in runs of equal ``task``; they come sorted by it, and a run is small."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        task = batch.column("task").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and part.num_rows and held[-1].column("task")[0] != part.column("task")[0]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _points(group: pa.RecordBatch) -> np.ndarray:
    found = np.frombuffer(b"".join(group.column("point").to_pylist()), np.uint16).reshape(-1, GROUPS).astype(np.int64)
    found[found == _FULL] = 1 << 40
    return found


def enough(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` members that share at most ``shared`` can be, or exactly that many are, a link."""
    return shared * (100 + PERCENT) >= PERCENT * (a + b)


def leaves(points: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Points packed by size into strips, and in each by the coordinate that varies most, into leaves."""
    strip = LEAF * max(1, int((len(n) / LEAF) ** 0.5))
    by_size = np.argsort(n, kind="stable")
    out = []
    for a in range(0, len(n), strip):
        own = by_size[a : a + strip]
        widest = int(np.argmax(np.ptp(points[own], axis=0)))
        own = own[np.argsort(points[own, widest], kind="stable")]
        out += [own[b : b + LEAF] for b in range(0, len(own), LEAF)]
    return out


def near_pairs(points: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each point the others, of leaves not before its own, that the bound lets through; every pair once."""
    packed = leaves(points, n)
    high = np.array([points[own].max(0) for own in packed])
    least, most = np.array([n[own].min() for own in packed]), np.array([n[own].max() for own in packed])
    for x, own in enumerate(packed):
        fits = enough(np.minimum(high[x:], high[x]).sum(1), least[x:], least[x])
        fits &= (100 * most[x:] >= PERCENT * least[x]) & (100 * most[x] >= PERCENT * least[x:])
        rest = [packed[x + k] for k in np.flatnonzero(fits).tolist()]
        if not rest:
            continue
        beside = bool(fits[0])
        others = np.concatenate(rest)
        for k, i in enumerate(own.tolist()):
            later = others[k + 1 :] if beside else others  # its own leaf comes first
            yield i, later[enough(np.minimum(points[later], points[i]).sum(1), n[later], n[i])]


def _surviving(group: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of a task that may be a link, join two components, and belong to this page.

    Where the task has a leader, it alone is compared with the others; where it has two parts of a
    page, only pairs across them; and a pair that has another page with a smaller key is met there.
    """
    side, part, n = (group.column(c).to_numpy() for c in ("side", "part", "n"))
    points = _points(group)
    if group.column("led")[0].as_py():
        first = int(np.argmin(side))
        others = np.flatnonzero((part != part[first]) & (side != side[first]))
        yield first, others[enough(np.minimum(points[others], points[first]).sum(1), n[others], n[first])]
        return
    page = group.column("page")[0].as_py() % (1 << 64)
    sketches = [np.frombuffer(s, np.uint64) for s in group.column("sketch").to_pylist()]
    earlier = [set(s[s < page].tolist()) for s in sketches]
    across = (side != side[0]).any()
    for i, others in near_pairs(points, n):
        others = others[part[others] != part[i]]
        if across:
            others = others[side[others] != side[i]]
        yield i, np.array([j for j in others.tolist() if earlier[i].isdisjoint(earlier[j])], np.int64)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task, the points that the bound lets through with some other."""
    for group in _groups(batches):
        chosen = np.zeros(group.num_rows, bool)
        for i, others in _surviving(group):
            chosen[others] = True
            chosen[i] |= len(others) > 0
        if chosen.any():
            yield group.filter(pa.array(chosen))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links confirmed on the full sets; within a task only those that join its components."""
    for group in _groups(batches):
        text, nodes, own = group.column("text"), group.column("node").to_pylist(), group.column("part").to_pylist()
        sets: dict[int, np.ndarray] = {}
        above = {p: p for p in own}

        def root(p: int, above: dict[int, int] = above) -> int:
            while above[p] != p:
                above[p] = above[above[p]]
                p = above[p]
            return p

        def grams(i: int, sets: dict[int, np.ndarray] = sets, text: pa.Array = text) -> np.ndarray:
            if i not in sets:
                sets[i] = gram_sets(text.slice(i, 1))[0]
            return sets[i]

        links = []
        for i, others in _surviving(group):
            for j in others.tolist():
                if root(own[i]) != root(own[j]):
                    a, b = grams(i), grams(j)
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    if enough(shared, len(a), len(b)):
                        links.append((nodes[i], nodes[j]))
                        above[root(own[j])] = root(own[i])
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


_TASK = "task BIGINT, page BIGINT, led BOOLEAN, node BIGINT, part BIGINT, side INT, n BIGINT, point BINARY, sketch BINARY"


def _confirmed(tasks: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of the tasks' members: ``tasks`` has task, page, led, node, part and side."""
    members = tasks.join(nodes.select("node", "n", "point", "sketch"), "node")
    dealt = members.repartition("task").sortWithinPartitions("task", "side", "node")
    near = written(dealt.select(*[c.split()[0] for c in _TASK.split(", ")]).mapInArrow(_candidates, _TASK))
    # Few documents are left; while their ids are few enough to be sent around, only their texts move.
    needed = texts.join(broadcast_checked(near.select("node").distinct(), row_bytes=64), "node", "left_semi")
    full = near.join(needed, "node").repartition("task").sortWithinPartitions("task", "side", "node")
    return written(full.mapInArrow(_linked, "a BIGINT, b BIGINT"))


def _parts(count: str):
    return F.ceil(F.col(count) / PAGE).cast("int")


def _leader_tasks(members: DataFrame) -> DataFrame:
    """Each point beside the smallest one of each of its pages, at most about PAGE a task."""
    pairs = members.filter("node <> leader").select("leader", "node").distinct()
    degree = written(pairs.groupBy("leader").agg(F.count("*").alias("_degree")))
    dealt = join_facts(pairs, degree, ["leader"], "_degree")
    dealt = dealt.select("leader", "node", F.xxhash64("leader", F.pmod(F.xxhash64("node"), _parts("_degree"))).alias("task"))
    led = dealt.select("task", F.col("leader").alias("node"), F.lit(0).alias("side")).distinct()
    both = led.unionByName(dealt.select("task", "node", F.lit(1).alias("side")))
    return both.select("task", F.lit(0).cast("bigint").alias("page"), F.lit(True).alias("led"), "node", F.col("node").alias("part"), "side")


def _page_tasks(members: DataFrame, found: DataFrame) -> DataFrame:
    """Points of pages that are not of one component yet, in pairs of parts."""
    parted = written(members.join(found, "node", "left").select("page", "node", F.coalesce("component", "node").alias("part")))
    still = (
        parted.groupBy("page")
        .agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.count("*").alias("_n"))
        .filter("_low <> _high")
        .drop("_low", "_high")
    )
    dealt = join_facts(parted, written(still), ["page"], "_n")
    dealt = dealt.select(
        "page",
        "node",
        "part",
        F.pmod(F.xxhash64("node"), _parts("_n")).cast("int").alias("_own"),
        F.explode(F.sequence(F.lit(0), _parts("_n") - 1)).alias("_other"),
    )
    task = F.xxhash64("page", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return dealt.select(
        task.alias("task"), "page", F.lit(False).alias("led"), "node", "part", (F.col("_own") > F.col("_other")).cast("int").alias("side")
    )


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links lead to) for each row.

    Two documents link when 100 * intersection >= 90 * union of their sets.  ``text`` null, empty or
    without words has no set and is linked with nothing; a null doc_id takes no part (component
    null); rows that share a doc_id but not the text are judged each by its own, and repeated rows
    alike; texts of any length are one row's work; other columns do not count.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = written(rows.mapInArrow(_signed, _SIGNED))
    known = signed.filter("doc_id IS NOT NULL AND n > 0")
    # Of each class of equal sets one document stands for all.
    row = F.min_by(F.struct("point", "sketch", "pages"), "doc_id").alias("_row")
    nodes = written(
        known.groupBy("n", "p", "q")
        .agg(F.min("doc_id").alias("node"), row, F.count("*").alias("_copies"))
        .select("n", "p", "q", "node", "_copies", "_row.*")
    )
    paged = nodes.select("node", F.explode("pages").alias("page"))
    shared = paged.groupBy("page").agg(F.min("node").alias("leader"), F.count("*").alias("_n")).filter("_n > 1")
    members = written(join_facts(paged, written(shared), ["page"], "_n").select("page", "node", "leader"))
    texts = rows.select(F.col("doc_id").alias("node"), "text").filter("node IS NOT NULL")
    first = _confirmed(_leader_tasks(members), nodes, texts)
    rest = _confirmed(_page_tasks(members, components(first)), nodes, texts)
    found = components(first.unionAll(rest))

    of_class = nodes.join(found, "node", "left").select("n", "p", "q", "_copies", F.coalesce("component", "node").alias("component_id"))
    linked = join_facts(known.select("doc_id", "n", "p", "q"), written(of_class), ["n", "p", "q"], "_copies")
    alone = signed.filter("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = linked.select("doc_id", "n", "component_id").unionByName(alone)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 2))) AS i FROM words WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)
),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT DISTINCT a AS node, a AS other FROM edges
  UNION
  SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM words d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reached r ON r.node = d.doc_id
GROUP BY d.doc_id, s.n
"""
