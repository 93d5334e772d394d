import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from stocklens.llm import token_counts as T
from stocklens.llm.queries import tokenizer_file

from .helpers import rows_by_id

FILE = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def expected(library, items):
    return [(i, len((t or "").encode()), library(t), library(t) > T.LIMIT) for i, t in items]


def test_lengths_hold_any_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([
        np.arange(200, dtype=np.uint64), rng.integers(0, 1 << 64, 5000, np.uint64),
        np.uint64(1 << 63) + np.arange(300, dtype=np.uint64)]))[1:]
    table = T.Lengths(8)
    for part in np.array_split(rng.permutation(keys), 7):
        table.add(part, (part % np.uint64(1000)).astype(np.int32))
    assert (table.get(keys) == (keys % np.uint64(1000)).astype(np.int32)).all()
    assert (table.get(keys ^ np.uint64(0x5555 << 40)) < 0).sum() > 5000 and table.n == len(keys)


def test_a_summary_keeps_what_is_frequent():
    """A pre-token with more than one in ``room`` of all stays, through trims and folds."""
    rng = np.random.default_rng(2)
    one, two = T.Summary(20), T.Summary(20)
    for i in range(200):
        keys = np.unique(np.append(rng.integers(10, 1 << 40, 30, np.uint64), np.uint64(i % 3)))
        counts = np.where(keys < 10, 8, 1)
        data = np.repeat((keys % np.uint64(200)).astype(np.uint8), 2)
        (one, two)[i % 2].add(keys, counts, np.full(len(keys), 2), data)
    one.fold(*(c[0].as_py() for c in two.row(0).columns[1:]))
    one.trim()
    assert len(one.keys) <= 20 and {0, 1, 2} <= set(one.keys.tolist())
    at = one.keys.tolist().index(2)
    assert one.bytes[2 * at:2 * at + 2].tolist() == [2, 2]


@pytest.mark.parametrize("frequent,cached", [(1 << 16, 1 << 20), (1, 10), (50, 0)])
def test_counts_are_the_library_s(spark, documents, corpus, library, frequent, cached):
    """Whatever the tiers hold; with ties, repeated rows, null ids, nulls and empty texts."""
    odd = ["word <|endoftext|> more", "<|endoftext|>" * 1100, "ñandú　x\n\n\ny  z ", "x" * 5000,
           "tab\t\tend\r\n", "a" + "\u0085 " * 50, "naïve'll I'm 1234567 !!!"]
    items = [*corpus.items(), *((200 + i, t) for i, t in enumerate(odd)),
             (3, "again"), (3, "again"), (None, "no id")]
    frame = documents(items, extra=True).repartition(5)
    found = T.count_tokens(frame, FILE, most_frequent=frequent, most_cached=cached).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected(library, items), key=str)


def test_long_texts(spark, documents, library, monkeypatch):
    """A text beyond a group's bytes, with and without places to cut it."""
    rng = random.Random(5)
    words = " ".join(str(rng.random()) for _ in range(150_000))
    assert len(words) > T.GROUP
    texts = {1: words, 2: "short", 3: "ab" * 50_000}
    found = rows_by_id(T.count_tokens(documents(texts), FILE), "n_tokens")
    assert found == {i: library(t) for i, t in texts.items()}


def test_empty_table(spark, documents):
    out = T.count_tokens(documents([]), FILE)
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_no_pre_token_is_shuffled(spark, documents, corpus):
    plan = T.count_tokens(documents(corpus), FILE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
