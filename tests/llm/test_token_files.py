import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stocklens.llm import token_files as T
from stocklens.llm.queries import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_pieces_encode_as_the_whole_text(plain):
    rng = random.Random(3)
    letters = "ab é, .\n\t …'s1×!? 　\u0085\x1c\0"
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(3000)]
    texts += ["", "word word, Word. word\nword", "<|endoftext|> x", "x" * 5000]
    ids, counts = T.Encoder(FILE)([np.frombuffer(t.encode(), np.uint8) for t in texts], 2)
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == plain(text), text


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_spelled_out_special_tokens(spark, documents, library, tmp_path):
    """<|endoftext|> beside spaces, letters, marks and line ends is one id, as in the library."""
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "a", "é",
             "Word", ".", ",", "!?", "…", "'s", "\u00a0", "\u3000", "1", "<|", "|>"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)]
    texts += ["word <|endoftext|> more", "<|endoftext|>" * 50, "<|ENDOFTEXT|>"]
    assert library("word <|endoftext|> more") == [4775, 220, 50256, 517, 2]
    ids, counts = T.Encoder(FILE, special=True)(
        [np.frombuffer(t.encode(), np.uint8) for t in texts], 2)
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == library(text), text
    T.write_tokens(documents(list(enumerate(texts[-300:]))), str(tmp_path / "t"), FILE, 2)
    start = 0
    for row in T.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect():
        expected = library(texts[-300:][row.doc_id])
        assert (row.start, row.ids) == (start, expected)
        start += len(expected)


def test_round_trip(spark, documents, corpus, plain, tmp_path):
    items = [*corpus.items(), (5, "again"), (None, "no id"), (5, "again")]
    T.write_tokens(documents(items, extra=True), str(tmp_path / "t"), FILE, 2)
    rows = T.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    expected = sorted(items, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start = 0
    for row, (doc_id, text) in zip(rows, expected, strict=True):
        ids = plain(text or "")
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        start += len(ids)


def test_selective_reads(spark, documents, corpus, plain, tmp_path):
    path = str(tmp_path / "t")
    T.write_tokens(documents(corpus), path, FILE, 2)
    some = T.read_tokens(spark, path, 10, 12).collect()
    assert sorted(r.doc_id for r in some) == [10, 11, 12]
    counts = T.read_tokens(spark, path, ids=False)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    crc = {r.doc_id: r.ids_crc32 for r in T.checksums(T.read_tokens(spark, path)).collect()}
    assert crc[3] == zlib.crc32(np.array(plain(corpus[3]), "<u4").tobytes())


def test_empty_table(spark, documents, tmp_path):
    T.write_tokens(documents([]), str(tmp_path / "t"), FILE, 2)
    assert T.checksums(T.read_tokens(spark, str(tmp_path / "t"))).count() == 0
