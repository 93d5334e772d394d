import re

import numpy as np
import pyarrow as pa

from stocklens.llm import text as T

CASES = ["", " ", "a", "A b\tc", "é É ÉÉ x", "x" * 3000 + " y", "Ab ab aB", "a b", "１ ２"]


def test_words_are_told_apart_as_by_the_patterns():
    for table, pattern, lower in ((T.VISIBLE, "[^\x20\x09-\x0D]+", False),
                                  (T.LETTERS, "[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        hasher = T.Hasher(table, lower)
        seen = {}
        for text in CASES:
            low = re.sub("[A-Z]", lambda m: m.group().lower(), text) if lower else text
            words = re.findall(pattern, low)
            hashes = hasher.words(np.frombuffer(text.encode(), np.uint8)).tolist()
            assert len(hashes) == len(words)
            for word, h in zip(words, hashes):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = T.Hasher(T.VISIBLE, False).words(data)
    monkeypatch.setattr(T, "PIECE", 64)
    assert (T.Hasher(T.VISIBLE, False).words(data) == whole).all()


def test_sliding_argmin_and_covered():
    values = np.array([5, 3, 3, 9, 1, 7], np.uint64)
    assert T.sliding_argmin(values, 3).tolist() == [2, 2, 4, 4]
    assert T.covered(np.array([1, 4]), 2, 6).tolist() == [False, True, True, False, True, True]


def test_rows_of_a_sliced_column():
    column = pa.array(["a", None, "bc", "", "d"]).slice(1, 3)
    assert [r.tobytes() for r in T.byte_rows(column)] == [b"", b"bc", b""]
