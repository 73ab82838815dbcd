import re

import numpy as np
import pyarrow as pa

from areaweave.llm import words as W
from tests.llm.conftest import prose, thue_morse

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_are_those_of_the_pattern():
    texts = ["", None, " a  b\x0bc ", "x", "one\x85two three　four", "end ", prose(1, 500)]
    found = W.split(pa.array(texts))
    for i, text in enumerate(texts):
        own = [found.text(k).decode() for k in range(found.first[i], found.first[i + 1])]
        assert own == WORD.findall(text or "")


def test_only_ascii_letters_are_lowered():
    found = W.split(pa.array(["ABC É"]), lower=True)
    assert [found.text(0), found.text(1).decode()] == [b"abc", "É"]


def test_hashes_depend_on_the_words_alone():
    texts = pa.array([prose(2, 300), prose(2, 300), prose(3, 300), "x" * 70 + " y" + " x" * 3 + "x" * 69])
    whole = W.word_hashes(W.split(texts))
    alone = np.concatenate([W.word_hashes(W.split(texts.slice(i, 1))) for i in range(4)])
    assert (alone == whole).all()
    a, b = (W.window_hashes(whole[k * 300 : (k + 1) * 300], 20, W.ROLL_A) for k in (0, 1))
    assert (a == b).all() and len(np.unique(a)) == len(a)


def test_hashes_tell_words_apart_as_bytes_do():
    texts = [*thue_morse(1024), *thue_morse(2048), *thue_morse(32), "a", "aa", "ab", "é", "x" * 63, "x" * 64, "x" * 65]
    found = W.split(pa.array(texts + texts))
    hashes = W.word_hashes(found)
    n = len(texts)
    assert len(set(hashes[:n].tolist())) == n and (hashes[:n] == hashes[n:]).all()
    i, j = (x.ravel() for x in np.indices((n, n)))
    assert (W.differ(found, i, j + n) == (i != j)).all()


def test_window_hash_is_the_polynomial_modulo_the_prime():
    values = np.random.default_rng(5).integers(0, 2**64, 200, np.uint64)
    base = W.ROLL_A % W.PRIME
    own = [sum(int(v) * pow(base, k, W.PRIME) for k, v in enumerate(values[i : i + 20])) % W.PRIME for i in range(181)]
    assert (W.window_hashes(values, 20, W.ROLL_A) == W.mix(np.array(own, np.uint64))).all()


def test_windows_stay_within_their_text():
    found = W.split(pa.array(["a b c", "d e", "", "f g h i"]))
    assert W.window_starts(found, 3).tolist() == [0, 5, 6]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 30, 2, 2)])], ["text"])
    parts = list(W.slices(iter([batch]), most=8))
    assert sum(p.num_rows for p in parts) == 5 and max(p.num_rows for p in parts) < 5
