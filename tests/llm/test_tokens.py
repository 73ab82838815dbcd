import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from areaweave.llm import bpe, tokenfiles as T, units
from tests.llm.conftest import frame, prose

WORD_FILE, BYTE_FILE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "", None, " ", "  ", "a  b", "a \n b", "\n\nx", "x\n\n", "a b　c  d", "it's THEY'RE O'Σ ΣΑΣ", "\t\tx \t y",
    "<|endoftext|> a  <|endoftext|><|startoftext|>b", "a\x1cb \x1d c", "x\u0085\u0085 y", "é é", "日本語 テスト", "İstanbul",
    "a\r\n\r\nb", "a" * 400, "ab" * 300 + " c", "12345 ½ ²", "ǅ ﬀ ẞ", "​ ﻿ x", "𝔸 𝟘 Ɤ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_FILE), Tokenizer.from_file(BYTE_FILE)


def test_ids_and_text_are_the_librarys(library):
    model, encoder = bpe._model(WORD_FILE)
    texts = ODD + [prose(k, 200) for k in range(5)] + ["".join(random.Random(k).choices("theandou", k=1500)) for k in range(2)]
    ids, first = encoder.ids(pa.array(texts))
    decoded = model.decode(ids.astype(np.int64), first)
    for i, text in enumerate(texts):
        want = library[0].encode(text or "", add_special_tokens=False).ids
        assert ids[first[i] : first[i + 1]].tolist() == want
        assert decoded[i] == library[0].decode(want, skip_special_tokens=False)


def test_scan_and_heap_agree():
    model = bpe._model(WORD_FILE)[0]
    r = random.Random(2)
    for _ in range(500):
        word = "".join(r.choices("theandouring", k=r.randint(1, 90))).encode()
        parts = [model._inner[b] for b in word]
        assert model._scan(parts[:]) == model._heap(parts[:])


def test_bpe_digests(spark, awkward, library):
    rows, df = awkward
    got = sorted(map(tuple, bpe.digests(df).collect()), key=repr)
    want = []
    for i, text in rows:
        ids = library[0].encode(text or "", add_special_tokens=False).ids
        decoded = library[0].decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), decoded.encode())]
        want.append((i, len(ids), *digest))
    assert got == sorted(want, key=repr)


def test_one_pass_equals_two(spark, awkward):
    _, df = awkward
    one = bpe.round_trip(df, WORD_FILE).collect()
    two = bpe.decode(bpe.encode(df, WORD_FILE), WORD_FILE).select("doc_id", "n_tokens", "ids", "decoded").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    if n > 10:
        ids[5] = 2**32 - 1  # an outlier
    start, data = T.pack_blocks(ids)
    assert (T.unpack_blocks(data, start, n) == ids).all()
    if len(start) > 1:  # one block alone, by the index
        assert (T.unpack_blocks(data, start[:1], T.BLOCK) == ids[: T.BLOCK]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(128, 7, np.uint32)
    plain = len(T.pack_blocks(ids)[1])
    ids[3] = 4_000_000_000
    assert len(T.pack_blocks(ids)[1]) == plain + 5


def test_files_hold_the_corpus(spark, awkward, library, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_IDS", 300)
    rows, df = awkward
    rows = rows + [(20 + k, t) for k, t in enumerate(ODD)]
    path = str(tmp_path / "files")
    T.write_token_files(frame(spark, rows), path, BYTE_FILE, file_bytes=4000)
    got = T.read_token_files(spark, path).orderBy("start").collect()
    sizes = {}
    for i, text in rows:
        ids = np.array(library[1].encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        sizes.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    place, seen = 0, []
    for row in got:
        assert row.start == place and (row.n_tokens, row.ids_crc32) in sizes[row.doc_id]
        place += row.n_tokens
        seen.append(-1 if row.doc_id is None else row.doc_id)
    assert seen == sorted(seen) and len(got) == len(rows)


def test_no_documents_no_segments(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    T.write_token_files(empty, path, BYTE_FILE)
    assert T.read_token_files(spark, path).collect() == []


@pytest.mark.parametrize("width", range(33))
def test_bits_are_read_as_the_least_type_that_holds_them(width):
    type_ = T._holding(width)
    assert type_.itemsize * 8 >= width and (type_.itemsize == 1 or type_.itemsize * 4 < width)
    ids = np.random.default_rng(width).integers(0, 2**width, 1000, dtype=np.uint64).astype(np.uint32)
    start, blocks = T.pack_blocks(ids)
    bits = "".join(f"{x - ids[:128].min():032b}"[::-1][: blocks[4]] for x in ids[:128])
    if not blocks[5]:  # no exceptions in the first block: its bits, one number after the other, lowest first
        assert blocks[6 : 6 + len(bits) // 8] == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert T.unpack_blocks(blocks, start, len(ids)).tolist() == ids.tolist()


def test_known_units_are_looked_up_once_a_batch(monkeypatch):
    looked = []
    find = units._Store.find
    monkeypatch.setattr(units._Store, "find", lambda self, asked: looked.append(len(asked)) or find(self, asked))
    encoder = T.Encoder(lambda new: (np.arange(len(new), dtype=np.uint32), np.ones(len(new), np.int64)))
    encoder.ids(pa.array([" ".join(f"w{k}" for k in range(1000))]))
    looked.clear()
    ids, _ = encoder.ids(pa.array([" ".join(f"w{k}" for k in range(1001))]))
    assert len(ids) == 1001 and sum(looked) <= 1001 + 3
