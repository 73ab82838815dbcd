"""Ranked lexical search by the Best Position Algorithm, over segments of the documents.

Statistics come first: the number of documents with a term, the sum of all their terms, and of
each query term the number of documents that hold it, summed by Spark.  Then every task cuts
its documents into segments.  A segment lists, for each query term, its documents by falling
impact, and each query searches these lists (``best``):

* the lists are read from their tops together; a document met for the first time is looked up in all
  the query's lists (direct access), so its score is complete, and its place in each list is marked;
* the best position of a list is the last one before its first unmarked place: marks left by direct
  accesses count, so it lies at or beyond the place read last;
* no unseen document can score more than the impacts at the best positions together.  The search
  ends when that sum is strictly below the k-th score, so equal scores are never lost.

A task hands on the k best of each query, and the k best of those are the answer.  Queries come
in blocks of bounded size; the documents are searched once for each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import table
from areaweave.operators.scale import shared_folder

TOP = 50
#: Bytes of query texts in a block, and of document texts in a segment.
QUERY_BYTES, SEGMENT_BYTES = 8 << 20, 8 << 20
#: Places of each list read in the first round; every round reads twice as many.
STEP = 16
_NULL = -(2**63)

#: Bytes of terms: digits, ASCII letters, and all bytes of other characters.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True


def terms(texts: pa.Array) -> W.Words:
    """The terms of every text, A-Z lowered: maximal runs of letters, digits and bytes beyond ASCII."""
    data, offset = W.flat(texts)
    return W.split_bytes(W.lowered(data), offset, ~_TERM)


class Queries(NamedTuple):
    """A block of queries: known: sorted hashes of their terms; rows: for each query, the numbers of its terms."""

    known: np.ndarray
    rows: list[np.ndarray]

    @staticmethod
    def of(texts: list[str]) -> Queries:
        found = terms(pa.array(texts, pa.string()))
        known, which = np.unique(W.word_hashes(found), return_inverse=True)
        return Queries(known, [np.unique(which[a:b]) for a, b in zip(found.first.tolist(), found.first[1:].tolist())])


class Postings(NamedTuple):
    """Of a batch of texts: how often (tf) text ``doc`` holds the query term ``term``, by term and doc; n: terms of each text."""

    term: np.ndarray
    doc: np.ndarray
    tf: np.ndarray
    n: np.ndarray


def postings(texts: pa.Array, known: np.ndarray) -> Postings:
    found = terms(texts)
    n = np.diff(found.first)
    hashes = W.word_hashes(found)
    term = np.searchsorted(known, hashes)
    hit = np.flatnonzero(term < len(known))
    hit = hit[known[term[hit]] == hashes[hit]]
    doc = np.repeat(np.arange(len(n)), n)[hit]
    pair, tf = np.unique(term[hit].astype(np.int64) * max(1, len(n)) + doc, return_counts=True)
    return Postings(pair // max(1, len(n)), pair % max(1, len(n)), tf.astype(np.int64), n)


def weights(df: np.ndarray, total: int) -> np.ndarray:
    """Weight of terms that ``df`` of ``total`` documents hold."""
    return np.floor(1000 * np.log((2.0 * total + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


class Segment:
    """For each query term the documents of a segment: by number for direct access, and by falling impact."""

    def __init__(self, parts: list[Postings], weight: np.ndarray, total: int, length: int):
        n = np.concatenate([p.n for p in parts])
        shift = np.cumsum([0, *(len(p.n) for p in parts)])
        term, doc, tf = (np.concatenate([getattr(p, f) for p in parts]) for f in ("term", "doc", "tf"))
        doc = doc + np.repeat(shift[:-1], [len(p.doc) for p in parts])
        m = 50 + (50 * n * total) // max(1, length)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        by_doc = np.lexsort((doc, term))
        self.doc, self.impact, term = doc[by_doc], impact[by_doc], term[by_doc]
        #: The k-th place of a list is entry order[k]; rank is the inverse.
        self.order = np.lexsort((self.doc, -self.impact, term))
        self.rank = np.empty(len(doc), np.int64)
        self.rank[self.order] = np.arange(len(doc))
        self.first = np.searchsorted(term, np.arange(len(weight) + 1))
        self.docs = len(n)

    def best(self, query: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the query's k best (ties by number), and how many places were read.

        Documents that score less than ``floor`` may be missing.
        """
        lists = [(a, b) for a, b in zip(self.first[query].tolist(), self.first[query + 1].tolist()) if b > a]
        none = np.zeros(0, np.int64)
        seen, marked = np.zeros(self.docs, bool), [np.zeros(b - a + 1, bool) for a, b in lists]
        position = [0] * len(lists)
        docs, scores, depth, step, read = [none], [none], 0, STEP, 0
        while True:
            tops = [self.doc[self.order[a + depth : min(b, a + depth + step)]] for a, b in lists]
            read += sum(map(len, tops))
            new = np.unique(np.concatenate([none, *tops]))
            new = new[~seen[new]]
            seen[new] = True
            score = np.zeros(len(new), np.int64)
            bound = 0
            for j, (a, b) in enumerate(lists):
                at = np.searchsorted(self.doc[a:b], new)
                hit = np.flatnonzero(at < b - a)
                hit = hit[self.doc[a + at[hit]] == new[hit]]
                entry = a + at[hit]
                score[hit] += self.impact[entry]
                marked[j][self.rank[entry] - a] = True
                position[j] += int(np.argmin(marked[j][position[j] :]))  # the first unmarked place
                if position[j] < b - a:
                    bound += int(self.impact[self.order[a + max(0, position[j] - 1)]])
            docs.append(new)
            scores.append(score)
            depth, step = depth + step, 2 * step
            every = np.concatenate(scores)
            kth = max(floor, int(np.partition(every, -k)[-k]) if len(every) >= k else 0)
            if bound < kth or all(p == b - a for p, (a, b) in zip(position, lists)):
                break
        all_docs = np.concatenate(docs)
        chosen = np.lexsort((all_docs, -every))
        chosen = chosen[every[chosen] > 0]
        return all_docs[chosen], every[chosen], read


def _counts(known: np.ndarray):
    """Of each batch: term -1 with the documents that have a term, -2 with all terms, then documents by query term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 2, np.int64)
        for batch in W.slices(batches):
            found = postings(batch.column("text"), known)
            total[0] += (found.n > 0).sum()
            total[1] += found.n.sum()
            total[2:] += np.bincount(found.term, minlength=len(known))
        at = np.flatnonzero(total)
        names = np.concatenate([[-1, -2], np.arange(len(known))])
        yield pa.RecordBatch.from_arrays([pa.array(names[at], pa.int64()), pa.array(total[at])], ["term", "n"])

    return run


def _searched(queries: Queries, weight: np.ndarray, total: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries.rows]
        parts: list[Postings] = []
        ids: list[np.ndarray] = []

        def search() -> None:
            segment = Segment(parts, weight, total, length)
            own = np.concatenate(ids)
            for i, query in enumerate(queries.rows):
                docs, scores = top[i]
                floor = int(scores[-1]) if len(scores) >= k else 0
                new, points, _ = segment.best(query, k, floor)
                docs, scores = np.concatenate([docs, own[new]]), np.concatenate([scores, points])
                order = np.lexsort((docs, -scores))[:k]
                top[i] = docs[order], scores[order]
            parts.clear()
            ids.clear()

        held = 0
        for batch in W.slices(batches):
            parts.append(postings(batch.column("text"), queries.known))
            ids.append(pa.compute.fill_null(batch.column("doc_id"), _NULL).to_numpy(zero_copy_only=False))
            held += batch.column("text").nbytes
            if held >= SEGMENT_BYTES:
                search()
                held = 0
        if parts:
            search()
        row = np.repeat(np.arange(len(top)), [len(d) for d, _ in top])
        docs = np.concatenate([d for d, _ in top]) if top else row
        columns = [
            pa.array(row, pa.int64()),
            pa.array(docs, pa.int64(), mask=docs == _NULL),
            pa.array(np.concatenate([s for _, s in top]) if top else row, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """For each row of ``items`` the k best documents: item_id, rank (from 1), doc_id, score.

    ``items`` has item_id and text, ``docs`` doc_id and text; other columns do not count.  Scores are
    above 0; equal ones rank by ascending doc_id, null first.  ``text`` null or empty has no term: such
    a document is never found and such an item finds nothing.  Repeated documents are ranked each;
    repeated items are one; items that share an item_id but not the text are ranked each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    path = f"{shared_folder(spark)}/llm-search-{uuid.uuid4().hex}"
    for block in range(blocks):  # a block of queries is bounded; its answers go to the shared folder
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        queries = Queries.of(part.column("text").to_pylist())
        counts = rows.select("text").mapInArrow(_counts(queries.known), "term BIGINT, n BIGINT").groupBy("term").agg(F.sum("n").alias("n"))
        sums = counts.toArrow()  # a number for each query term of the block
        n = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist(), strict=True))
        total, length = n.get(-1, 0), n.get(-2, 0)
        df = np.array([n.get(t, 0) for t in range(len(queries.known))], np.float64)
        found = rows.mapInArrow(
            _searched(queries, weights(df, total), total, length, k), "query BIGINT, doc_id BIGINT, score BIGINT"
        )
        # Each task sends at most k rows a query, and Spark cuts them to k again before they move.
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(
            pa.table({"query": pa.array(range(part.num_rows), pa.int64()), "item_id": part.column("item_id")})
        )
        done = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        done.write.mode("append").parquet(path)
    return spark.read.schema(done.schema).parquet(path)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH doc_terms AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
counted AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
sizes AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sizes),
item_terms AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
weighted AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM counted SEMI JOIN (SELECT DISTINCT term FROM item_terms) q USING (term), totals GROUP BY term, nn
),
impacts AS MATERIALIZED (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS impact
  FROM counted JOIN weighted USING (term) JOIN sizes USING (doc_id), totals
),
scores AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
) WHERE rank <= 50
"""
