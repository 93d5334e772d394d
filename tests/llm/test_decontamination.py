import re

import pytest

from stocklens.llm import decontamination as D
from .helpers import LOWER, rows_by_id

PATTERN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(texts, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(name))
    out = {}
    for doc, text in texts.items():
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out[doc] = (len(w), len(hit), sorted(found))
    return out


@pytest.fixture(scope="module")
def items(corpus):
    long = words(corpus[97])
    return [(1, corpus[98]), (2, " ".join(long[50:60])), (3, " ".join(long[5:9])), (4, None),
            (5, "..."), (6, corpus[98]), (7, "one"), (7, "ONE two"), (8, " ".join(long[:2500]))]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 40])
def test_against_brute_force(monkeypatch, documents, corpus, items, benchmark, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    found = D.contamination(documents(corpus, extra=True), benchmark)
    rows = rows_by_id(found, "n_words", D.hit_words().alias("n"), "item_ids")
    assert rows == brute(corpus, items)


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 40])
def test_repeated_rows_stay_apart(monkeypatch, documents, benchmark, corpus, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs = documents([(1, "one"), (1, "one"), (1, corpus[98]), (None, None)])
    rows = D.contamination(docs, benchmark).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted(
        [(0, 0), (1, 1), (1, 1), (1, len(words(corpus[98])))])


def test_clean_documents(documents, corpus, items, benchmark):
    kept = D.clean_documents(documents(corpus, extra=True), benchmark)
    assert kept.columns == documents(corpus, extra=True).columns
    assert {r.doc_id for r in kept.collect()} == {
        d for d, (_, n, _) in brute(corpus, items).items() if not n}


def test_empty_tables(spark, documents, benchmark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(documents([]), benchmark).count() == 0
    assert D.contamination(documents({1: "x"}), none).first().n_words == 1
    assert D.clean_documents(documents({1: "x"}), none).count() == 1


def test_items_without_an_id(spark, documents):
    """Their passages are found and their documents go; they are the item of the empty id."""
    passage = " ".join(f"word{i}" for i in range(12))
    docs = documents({1: f"before {passage} after", 2: "nothing of it"})
    items = spark.createDataFrame([(None, passage), ("b", None), (None, None)], "item_id string, text string")
    found = D.contamination(docs, items).orderBy("doc_id").collect()
    assert [(r.item_ids, len(r.hits)) for r in found] == [([""], 1), ([], 0)]
    assert [r.doc_id for r in D.clean_documents(docs, items).collect()] == [2]
