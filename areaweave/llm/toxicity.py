"""Toxicity: a lexicon met by a Levenshtein automaton, weighed by its context.

1. The lexicon is learned from labelled documents: words and beginnings of words that almost
   only toxic ones hold.  It is a trie; entries that are beginnings accept any ending.
2. Each distinct word runs through the intersection of that trie and a Levenshtein automaton:
   a deterministic automaton over sets of (trie node, edits so far), built as words need it.
   Most words leave it after two or three letters.
3. The words around each hit tell quotation from abuse: quotation marks on both sides, or a
   word of reporting, make it count as quoted.
4. A logistic regression on exact, misspelled, quoted and unquoted hits gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import labelled, table, written

#: Labelled documents of either kind from which lexicon and weights are learned.
SAMPLE = 1500
#: Toxic documents of the sample that must hold an entry, near copies counted once, as a number
#: and as a share of all; the least share of toxic ones among its documents; the most entries, most
#: frequent first, which bounds the lexicon that every task gets.
SUPPORT, SHARE, PURITY, ENTRIES = 5, 0.01, 0.95, 5000
#: Lengths of beginnings of words that may become entries.
STEMS = range(4, 9)
#: Letters from which one edit is allowed, for whole words and for beginnings.
EDIT_WORD, EDIT_STEM = 5, 6
#: Words on either side that are looked at.
CONTEXT = 6
_QUOTES = re.compile('["“”„«»‹›]')
#: Words that report what someone else said, in the languages at hand.
REPORTING = frozenset(
    "said says wrote quote quoted quotes called termed sagte schrieb zitat zitiert nannte dit écrit citation cité "
    "appelé dijo escribió cita citado llamó".split()
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Words that a worker remembers with their verdict.
CACHED = 400_000


def bare(word: str) -> str:
    """A word in lower case without the marks around it."""
    return _EDGE.sub("", word.lower())


class Automaton:
    """Trie of entries (a trailing * marks a beginning) crossed with at most one edit."""

    def __init__(self, entries: list[str]):
        self._next: list[dict[str, int]] = [{}]
        self._whole: list[bool] = [False]
        self._stem: list[bool] = [False]
        self._edits: list[int] = [0]  # edits that the longest entry through the node allows
        for entry in entries:
            stem, node = entry.endswith("*"), 0
            letters = entry.rstrip("*")
            allowed = int(len(letters) >= (EDIT_STEM if stem else EDIT_WORD))
            for c in letters:
                self._edits[node] = max(self._edits[node], allowed)
                if c not in self._next[node]:
                    self._next[node][c] = len(self._next)
                    self._next.append({})
                    self._whole.append(False)
                    self._stem.append(False)
                    self._edits.append(0)
                node = self._next[node][c]
            self._edits[node] = max(self._edits[node], allowed)
            if stem:
                self._stem[node] = True
            else:
                self._whole[node] = True
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._moves: list[dict[str, int]] = []
        self._ends: list[int] = []
        self._start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Number of the state for these pairs, with letters left out already followed."""
        closed = set(pairs)
        for node, edits in pairs:
            if edits == 0 and self._edits[node]:
                closed.update((child, 1) for child in self._next[node].values() if self._edits[child])
        key = frozenset(closed)
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._moves.append({})
            hits = [e for n, e in key if (self._whole[n] or self._stem[n]) and e <= self._edits[n]]
            self._ends.append(min(hits) + 1 if hits else 0)
        return self._ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self._sets[state]:
            if self._stem[node]:
                out.add((node, edits))
            child = self._next[node].get(c)
            if child is not None:
                out.add((child, edits))
            if edits == 0 and self._edits[node]:
                out.add((node, 1))
                out.update((other, 1) for other in self._next[node].values() if self._edits[other])
        new = self._state(out) if out else -1
        self._moves[state][c] = new
        return new

    def match(self, word: str) -> int:
        """0: no entry; 1: an entry as it is; 2: an entry with one edit."""
        state = self._start
        for c in word:
            new = self._moves[state].get(c)
            state = self._move(state, c) if new is None else new
            if state < 0:
                return 0
        return self._ends[state]


def learn_entries(sample: DataFrame) -> list[str]:
    """Words and beginnings (marked *) that tell toxic documents (grade 1) from others."""
    toxic_count = sample.agg(F.sum("grade")).head()[0] or 0
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    # Near copies mostly agree in the least hash of their words, so they count once.
    origin = F.array_min(F.transform("words", lambda w: F.xxhash64(w)))
    split = sample.select("grade", words.alias("words")).withColumn("origin", origin)
    long = F.filter("words", lambda w: F.length(w) >= STEMS.start)
    stems = F.flatten(
        F.transform(
            long,
            lambda w: F.transform(
                F.sequence(F.lit(STEMS.start), F.least(F.length(w), F.lit(STEMS.stop - 1))),
                lambda n: F.concat(F.substring(w, F.lit(1), n), F.lit("*")),
            ),
        )
    )
    whole = F.filter("words", lambda w: w != "")
    terms = split.select("grade", "origin", F.explode(F.array_distinct(F.concat(whole, stems))).alias("term"))
    often = (
        terms.filter("grade = 1")
        .groupBy("term", "origin")
        .agg(F.count("*").alias("n"))
        .groupBy("term")
        .agg(F.sum("n").alias("toxic"), F.count("*").alias("origins"))
        .filter(F.col("origins") >= max(SUPPORT, SHARE * toxic_count))
    )
    # At most the words of the sample over SUPPORT, so the broadcast is bounded.
    clean = terms.filter("grade = 0").join(F.broadcast(often.select("term")), "term").groupBy("term").count()
    found = (
        often.join(clean, "term", "left")
        .filter(F.col("toxic") >= PURITY * (F.col("toxic") + F.coalesce("count", F.lit(0))))
        .orderBy(F.desc("toxic"), "term")
        .limit(ENTRIES)
        .collect()
    )
    toxic = {r["term"]: r["toxic"] for r in found}
    chosen = []
    for term, count in toxic.items():
        stem = term.rstrip("*")
        if stem != term:
            # A beginning that nearly always goes on in one way is left to the longer entry.
            longer = [n for t, n in toxic.items() if t != term and t.startswith(stem) and len(t.rstrip("*")) <= len(stem) + 1]
            if any(n >= 0.9 * count for n in longer):
                continue
        chosen.append(term)
    stems = {t.rstrip("*") for t in chosen if t.endswith("*")}
    covered = lambda t: any(t.rstrip("*")[:n] in stems for n in range(1, len(t.rstrip("*")) + (not t.endswith("*"))))
    return sorted(t for t in chosen if not covered(t))


def _context(words: W.Words, i: int, a: int, b: int) -> float:
    """How far a hit at word i of the text from word a to b is a quotation: 0 to 1."""
    before = [words.text(j).decode("utf-8") for j in range(max(a, i - CONTEXT), i)]
    after = [words.text(j).decode("utf-8") for j in range(i + 1, min(b, i + 1 + CONTEXT))]
    own = words.text(i).decode("utf-8")
    head, tail = _EDGE.search(own), own[-1:]
    opened = any(map(_QUOTES.search, before)) or bool(head and head.start() == 0 and _QUOTES.search(head.group()))
    closed = any(map(_QUOTES.search, after)) or bool(_QUOTES.search(tail)) or bool(_QUOTES.search(own[-2:]))
    if opened and closed:
        return 1.0
    return 0.5 if any(bare(w) in REPORTING for w in (*before, *after)) else 0.0


_FEATURES = ["exact", "misspelled", "exact_quoted", "misspelled_quoted"]
_HITS = "doc_id BIGINT, " + ", ".join(f"{f} DOUBLE" for f in _FEATURES)


def count_hits(docs: DataFrame, entries: list[str]) -> DataFrame:
    """Per document, the hits of each kind, weighed by context; ``entries`` is bounded by ENTRIES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Automaton(entries), {}
        for batch in W.slices(batches):
            found = W.split(batch.column("text"))
            sums = np.zeros((4, batch.num_rows))
            _, sample, which = np.unique(W.word_hashes(found), return_index=True, return_inverse=True)
            kind = np.zeros(len(sample), np.int8)
            for k, i in enumerate(sample.tolist()):
                word = found.text(i)
                verdict = known.get(word)
                if verdict is None:
                    verdict = known[word] = automaton.match(bare(word.decode("utf-8")))
                kind[k] = verdict
            if len(known) > CACHED:
                known = {}
            hits = np.flatnonzero(kind[which]) if len(sample) else sample
            owner = np.searchsorted(found.first, hits, "right") - 1
            for i, d in zip(hits.tolist(), owner.tolist(), strict=True):
                quoted = _context(found, i, found.first[d], found.first[d + 1])
                row = kind[which[i]] - 1
                sums[row, d] += 1 - quoted
                sums[row + 2, d] += quoted
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, sums)], ["doc_id", *_FEATURES]
            )

    return docs.select("doc_id", "text").mapInArrow(run, _HITS)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method, with a small ridge; bias first."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), 0.5 * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on), and the hits of each kind.

    Learns from at most ``sample`` documents of either value of ``labels.toxic``, only from
    those whose crc32(doc_id) is not divisible by 5.  Without toxic labels every score is 0.
    ``text`` null counts as empty, which scores as a text without hits; other columns of
    ``docs`` do not count; repeated rows are scored each.
    """
    train = labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = written(labelled(docs, train, F.col("toxic"), sample))
    entries = learn_entries(known)
    marked = count_hits(known, entries).join(known.select("doc_id", "grade"), "doc_id").orderBy("doc_id").toPandas()
    y = marked["grade"].to_numpy(float)
    fitted = _fit(np.log1p(marked[_FEATURES].to_numpy(float)), y) if 0 < y.sum() < len(y) else None
    hits = count_hits(docs, entries)
    if fitted is None:
        score = F.lit(0.0)
    else:
        odds = sum((F.lit(float(w)) * F.log1p(c) for w, c in zip(fitted[1:], _FEATURES, strict=True)), F.lit(float(fitted[0])))
        score = 1 / (1 + F.exp(-odds))
    scored = hits.withColumn("score", score)
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *_FEATURES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    done = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return done.select("doc_id", held_out.alias("held_out"), "score", "predicted")
