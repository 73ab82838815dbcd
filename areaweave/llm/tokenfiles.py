"""Token-ID files: patched frame-of-reference blocks, written and read by Spark.

A file is a row of segments, each followed by one line feed.  A segment holds whole
documents, so it can be read alone; all numbers are little-endian:

    head     b"PFR1", then 32-bit: shard, bytes of the whole segment, documents, ids, blocks
    docs     each document's doc_id (64-bit; the least number stands for null)
    sizes    each document's number of ids (32-bit)
    index    where each block starts, counted from the first block (32-bit)
    blocks   of 128 ids (the last one shorter): minimum (32-bit), bit width, number of
             exceptions (8-bit each), the ids less the minimum packed at that width,
             then place (8-bit) and value less the minimum (32-bit) of each exception

The width is the least that fits 90 % of a block; what does not fit is an exception.

Documents are range-partitioned by doc_id, one file a partition, so the files in order are
the corpus in order.  Spark's text writer moves the bytes: its commit protocol makes a lost
executor's files vanish, and any file system that Spark knows will do.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaweave.llm import words as W
from areaweave.llm.common import shared_folder, table, text_bytes, written
from areaweave.llm.units import Encoder

BLOCK, PERCENTILE = 128, 90
#: Ids after which a segment ends with its document, and bytes of text for each file.
SEGMENT_IDS, FILE_BYTES = 1 << 16, 24 << 20
#: Units that go to the library as one text.
JOINED = 4096
_HEAD = struct.Struct("<4s5I")
_NULL = -(2**63)
#: First bytes of white space beyond ASCII.
_BLANK = (0xC2, 0xE1, 0xE2, 0xE3)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each number below 2 ** 32 takes."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _holding(width: int) -> np.dtype:
    """The least whole type that holds ``width`` bits, up to 32."""
    return np.dtype("u1" if width <= 8 else "<u2" if width <= 16 else "<u4")


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Start of each block, and all blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint32), b""
    # The short last block is filled up with its last id while widths are chosen.
    grid = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], np.uint32)]).reshape(blocks, BLOCK)
    low = grid.min(1)
    grid = grid - low[:, None]
    bits = _widths(grid)
    width = np.partition(bits, PERCENTILE * BLOCK // 100, axis=1)[:, PERCENTILE * BLOCK // 100]
    odd = bits > width[:, None]
    if blocks * BLOCK > n:
        odd[-1, n - (blocks - 1) * BLOCK :] = False
    counts = odd.sum(1)
    held = np.full(blocks, BLOCK)
    held[-1] = n - (blocks - 1) * BLOCK
    after = 6 + -(-held * width // 8)
    size = after + 5 * counts
    start = np.cumsum(size) - size
    after += start
    # The short last block is written as if it were full, so there is room behind it.
    out = np.zeros(int(start[-1] + size[-1]) + 4 * BLOCK, np.uint8)
    head = np.zeros(blocks, [("low", "<u4"), ("width", "u1"), ("odd", "u1")])
    head["low"], head["width"], head["odd"] = low, width, counts
    out[start[:, None] + np.arange(6)] = head.view(np.uint8).reshape(blocks, 6)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        plain = np.where(odd[rows], 0, grid[rows])
        # A number is read as the least whole type that holds the width; its first bits are kept.
        type_ = _holding(w)
        each = np.unpackbits(plain.astype(type_).view(np.uint8).ravel(), bitorder="little")
        each = each.reshape(len(rows), BLOCK, 8 * type_.itemsize)[:, :, :w]
        packed = np.packbits(each.reshape(len(rows), BLOCK * w), axis=1, bitorder="little")
        out[start[rows][:, None] + 6 + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(odd)
    rank = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    out[after[row] + rank] = place
    out[(after[row] + counts[row] + 4 * rank)[:, None] + np.arange(4)] = grid[odd].astype("<u4").view(np.uint8).reshape(-1, 4)
    return start.astype("<u4"), out[: int(start[-1] + size[-1])].tobytes()


def unpack_blocks(data: bytes, start: np.ndarray, n: int) -> np.ndarray:
    """The ids of all blocks; with part of ``start``, of the blocks that begin there."""
    raw = np.frombuffer(data, np.uint8)
    blocks = len(start)
    if not blocks:
        return np.zeros(0, np.uint32)
    start = start.astype(np.int64)
    low = sum(raw[start + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
    width, odd = raw[start + 4].astype(np.int64), raw[start + 5].astype(np.int64)
    held = np.full(blocks, BLOCK)
    held[-1] = n - (blocks - 1) * BLOCK
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        for rows in (np.flatnonzero((width == w) & (held == BLOCK)), np.flatnonzero((width == w) & (held < BLOCK))):
            if not len(rows):
                continue
            size = int(held[rows[0]])
            packed = raw[start[rows][:, None] + 6 + np.arange(-(-size * w // 8))]
            each = np.unpackbits(packed, axis=1, count=size * w, bitorder="little").reshape(len(rows), size, w)
            type_ = _holding(int(w))
            whole = np.zeros((len(rows), size, 8 * type_.itemsize), np.uint8)
            whole[:, :, :w] = each
            grid[rows, :size] = np.packbits(whole.ravel(), bitorder="little").view(type_).reshape(len(rows), size)
    after = start + 6 + -(-held * width // 8)
    for i in np.flatnonzero(odd):
        a, k = after[i], odd[i]
        grid[i, raw[a : a + k]] = np.frombuffer(data, "<u4", k, a + k)
    return (grid + low[:, None]).ravel()[:n]


def _segment(shard: int, docs: list[int], sizes: list[int], ids: np.ndarray) -> bytes:
    start, blocks = pack_blocks(ids)
    parts = [np.array(docs, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), start.tobytes(), blocks]
    size = _HEAD.size + sum(map(len, parts)) + 1
    return _HEAD.pack(b"PFR1", shard, size, len(docs), len(ids), len(start)) + b"".join(parts)


def segments(data: bytes) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """Shard, documents, their numbers of ids, and all ids, of each segment of a file."""
    at = 0
    while at < len(data):
        mark, shard, size, docs, n, blocks = _HEAD.unpack_from(data, at)
        if mark != b"PFR1":
            raise ValueError(f"no segment at byte {at}")
        a = at + _HEAD.size
        ids, sizes = np.frombuffer(data, "<i8", docs, a), np.frombuffer(data, "<u4", docs, a + 8 * docs)
        a += 12 * docs
        start = np.frombuffer(data, "<u4", blocks, a)
        yield shard, ids.tolist(), sizes, unpack_blocks(data[a + 4 * blocks : at + size - 1], start, n)
        at += size


_ENCODERS: dict[str, Encoder] = {}


def library_encoder(path: str, whole: list[bytes] = (b"<|endoftext|>",)):
    """Ids of texts by the tokenizers library, each distinct unit once; one a worker.

    Texts with a special token's string go to the library whole.
    """
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()

        size = np.zeros(model.get_vocab_size(), np.int64)  # a token is written with a letter for each of its bytes
        for token, i in model.get_vocab().items():
            size[i] = len(token)

        def alone(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in model.encode_batch_fast([u.decode("utf-8") for u in units], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # In one text the library is called once.  A unit that begins with a space is a piece of
            # its own there; before any other stands a line feed, which no token of a unit holds.
            odd = [i for i, u in enumerate(units) if u.isspace() or (u[0] in _BLANK and u.decode("utf-8").isspace())]
            blank = np.zeros(len(units), bool)
            blank[odd] = True
            if odd:
                split = [[units[i] for i in np.flatnonzero(mask).tolist()] for mask in (~blank, blank)]
                ids, count = (np.concatenate(x) for x in zip(encode(split[0]), alone(split[1]), strict=True))
                order = np.argsort(np.argsort(blank, kind="stable"))
                begin, count = (np.cumsum(count) - count)[order], count[order]
                return ids[np.arange(len(ids)) + np.repeat(begin - np.cumsum(count) + count, count)], count
            all_ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            length = np.fromiter(map(len, units), np.int64, len(units))
            data, begin = np.frombuffer(b"".join(units), np.uint8), np.cumsum(length) - length
            feed = data[begin] != 32
            data = np.insert(data, begin[feed], 10)
            length += feed
            begin = np.cumsum(length) - length
            for a in range(0, len(units), JOINED):
                part = slice(a, a + JOINED)
                text = data[begin[a] : begin[part][-1] + length[part][-1]]
                found = model.encode_batch_fast([text.tobytes().decode("utf-8")], add_special_tokens=False)[0]
                ids = np.array(found.ids, np.uint32)
                first = np.searchsorted(np.cumsum(size[ids]), begin[part] - begin[a], "right")
                count = np.diff(first, append=len(ids))
                keep = np.ones(len(ids), bool)
                keep[first[feed[part]]] = False
                all_ids.append(ids[keep])
                counts.append(count - feed[part])
            return np.concatenate(all_ids), np.concatenate(counts)

        _ENCODERS[path] = (Encoder(encode, classes=True), alone)
    cached, alone = _ENCODERS[path]

    def ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        special = np.zeros(len(texts), bool)
        for mark in whole:
            found = pa.compute.match_substring(texts, mark.decode())
            special |= pa.compute.fill_null(found, False).to_numpy(zero_copy_only=False)
        if not special.any():
            return cached.ids(texts)
        parts = []
        for i, odd in enumerate(special):
            one = texts.slice(i, 1)
            parts.append(alone([one[0].as_py().encode()])[0] if odd else cached.ids(one)[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    return ids


def _write(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(tokenizer)
        shard, docs, sizes, parts, held = 0, [], [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([_segment(shard, docs, sizes, np.concatenate(parts))], pa.binary())], ["segment"]
            )

        for batch in W.slices(batches, most=2 << 20):
            ids, first = encode(batch.column("text"))
            shard = batch.column("shard")[0].as_py()
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(end)).astype(np.uint32)
                docs.append(_NULL if doc is None else doc)
                sizes.append(len(own))
                parts.append(own)
                held += len(own)
                if held >= SEGMENT_IDS:
                    yield done()
                    docs, sizes, parts, held = [], [], [], 0
        if docs:
            yield done()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end: int = 0, file_bytes: int = FILE_BYTES
) -> None:
    """Write the ids of every text, ``end`` after each, in ascending doc_id order to ``path``.

    ``doc_id`` BIGINT (null: first of all), ``text`` (null: empty); other columns do not
    count.  Rows that share a doc_id are ordered by a hash of their text; repeated rows are
    written each.  An empty table gives no segment.
    """
    files = max(1, -(-text_bytes(docs) // file_bytes))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_copy"))
    ordered = rows.repartitionByRange(files, F.asc_nulls_first("doc_id"), "_copy").sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "_copy"
    )
    made = ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(_write(tokenizer, end), "segment BINARY")
    # The text writer puts out a string's bytes unchecked, and one line feed after each.
    made.select(F.col("segment").cast("string").alias("value")).write.text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            place = 0
            for shard, docs, sizes, ids in segments(content.as_py()):
                stop = np.cumsum(sizes.astype(np.int64))
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), sizes.tolist(), strict=True)]
                columns = [
                    pa.array([shard] * len(docs), pa.int32()),
                    pa.array([None if d == _NULL else d for d in docs], pa.int64()),
                    pa.array(stop - sizes + place, pa.int64()),
                    pa.array(sizes.astype(np.int64), pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                place += len(ids)
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "place", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    Only one number for each file is summed across files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    each = written(
        files.mapInArrow(_read, "shard INT, doc_id BIGINT, place BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
    )
    total = each.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = total.select(
        "shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before")
    )
    joined = each.join(before, "shard")
    return joined.select("doc_id", (F.col("place") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document as the files hold them."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
