"""BPE encoding and decoding with the files of a public word-level tokenizer.

Method: a contiguous rank array.  A word is a list of parts and a list of the ranks of
neighbouring parts; the least rank is looked for again and again, its boundary is deleted,
and the two ranks beside it are refreshed.  That is quadratic in a word's length, and the
fastest way for short words; longer runs of letters use a heap with the same result.

Each distinct unit of text (see ``units``) is encoded once a worker.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import table
from areaweave.llm.units import Encoder

#: Parts up to which a word is merged by scanning its rank array.
SHORT = 96
#: Units as in ``units.CACHED``; fewer, because in a pipeline a worker keeps them beside other stages' memory.
CACHED = 150_000
_NONE = 1 << 60
#: Fixed value: the tokenizer's split pattern, for lower-case ASCII.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """Ids of text by a vocabulary file whose words end in ``</w>``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Beyond ASCII, classes of letters depend on the Unicode version; there the library's own
        # normalizer and splitter cut the words that are merged here.
        library = Tokenizer.from_file(path)
        self._normal, self._cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self._split = re.compile(_PATTERN)
        self._special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self._marks = re.compile("(" + "|".join(map(re.escape, self._special)) + ")")
        letters = _byte_letters()
        self._byte = {c: b for b, c in enumerate(letters)}
        self._inner = [vocabulary[c] for c in letters]
        self._last = [vocabulary[c + end] for c in letters]
        pairs = [tuple(m) for m in model["model"]["merges"]]
        self._rank = {(vocabulary[a], vocabulary[b]): i for i, (a, b) in enumerate(pairs)}
        self._made = [vocabulary[a + b] for a, b in pairs]
        tokens = {**vocabulary, **self._special}
        names: list[bytes] = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            names[i] = token.encode("utf-8") + b" "
        self._name = np.frombuffer(b"".join(names), np.uint8)
        self._size = np.fromiter(map(len, names), np.int64, len(names))
        self._begin = np.cumsum(self._size) - self._size

    def word(self, data: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self._inner[b] for b in data]
        parts[-1] = self._last[data[-1]]
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank = self._rank.get
        ranks = [rank(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = self._made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := self._rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or self._rank.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = self._made[r], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (fresh := self._rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (fresh, a))
        return [p for p in parts if p is not None]

    def unit(self, data: bytes) -> bytes:
        """Ids, as 32-bit numbers, of text without inner white space."""
        out: list[int] = []
        for piece in self._marks.split(data.decode("utf-8")):
            if piece in self._special:
                out.append(self._special[piece])
                continue
            if piece.isascii():
                words = [w.encode() for w in self._split.findall(piece.lower())]
            else:
                words = [bytes(map(self._byte.get, w)) for w, _ in self._cut(self._normal(piece))]
            for word in words:
                out += self.word(word)
        return array("I", out).tobytes()

    def units(self, many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has."""
        made = [self.unit(u) for u in many]
        return np.frombuffer(b"".join(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made)) // 4

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The tokens of each text, joined by a space; ``first`` has where each text begins in ``ids``."""
        size = self._size[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(ids) else 0
        data = self._name[np.arange(total) + np.repeat(self._begin[ids] - stop + size, size)].tobytes()
        cut = np.concatenate([[0], stop])[first].tolist()
        return [data[a : max(a, b - 1)].decode("utf-8") for a, b in zip(cut, cut[1:])]


_MODELS: dict[str, tuple[WordBpe, Encoder]] = {}


def _model(path: str) -> tuple[WordBpe, Encoder]:
    """The model of a file and its cache, one a worker."""
    if path not in _MODELS:
        model = WordBpe(path)
        _MODELS[path] = (model, Encoder(model.units, CACHED))
    return _MODELS[path]


def _columns(batch: pa.RecordBatch, drop: str, **new: pa.Array) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c != drop]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new.values()], [*kept, *new])


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every document's ids: doc_id, n_tokens, and ``ids`` as little-endian 32-bit numbers.

    ``text`` may be null or empty (no ids) and of any length; other columns do not count;
    repeated rows are encoded each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer)[1]
        for batch in W.slices(batches, most=1 << 20):
            ids, first = model.ids(batch.column("text"))
            data, cut = ids.astype("<u4").tobytes(), (4 * first).tolist()
            packed = [data[a:b] for a, b in zip(cut, cut[1:])]
            yield _columns(batch, "text", n_tokens=pa.array(np.diff(first)), ids=pa.array(packed, pa.binary()))
        model.rest()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, n_tokens BIGINT, ids BINARY")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds ``decoded``, the text of column ``ids`` (null: empty), to the columns of ``encoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer)[0]
        for batch in W.slices(batches, "ids", 1 << 20):
            packed = [p or b"" for p in batch.column("ids").to_pylist()]
            first = np.cumsum([0, *(len(p) // 4 for p in packed)])
            texts = model.decode(np.frombuffer(b"".join(packed), "<u4").astype(np.int64), first)
            yield _columns(batch, "decoded", decoded=pa.array(texts, pa.string()))

    kept = [f for f in encoded.schema if f.name != "decoded"]
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return encoded.select(*[f.name for f in kept]).mapInArrow(run, ", ".join([*names, "decoded STRING"]))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """As ``decode(encode(docs, tokenizer), tokenizer)``, in one pass: one Python worker a task instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, encoder = _model(tokenizer)
        for batch in W.slices(batches, most=1 << 20):
            ids, first = encoder.ids(batch.column("text"))
            data, cut = ids.astype("<u4").tobytes(), (4 * first).tolist()
            packed = pa.array([data[a:b] for a, b in zip(cut, cut[1:])], pa.binary())
            decoded = pa.array(model.decode(ids.astype(np.int64), first), pa.string())
            yield _columns(batch, "text", n_tokens=pa.array(np.diff(first)), ids=packed, decoded=decoded)
        encoder.rest()

    schema = "doc_id BIGINT, n_tokens BIGINT, ids BINARY, decoded STRING"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and return doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    done = round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digests(table(spark, sf_dir, "documents"))
