import hashlib

import pytest
from pyspark.sql import functions as F

from stocklens.llm import fingerprints as P

from .helpers import rows_by_id


def successors(items):
    """Rows in the order of ids, largest first, equal ids by text, null ids last."""
    order = sorted(items, key=lambda x: (x[0] is None, -(x[0] or 0), x[1] or ""))
    return list(zip(order, [*order[1:], *order[:1]]))


@pytest.mark.parametrize("cell_rows", [500, 7, 1])
def test_edited_texts(monkeypatch, documents, corpus, cell_rows):
    monkeypatch.setattr(P, "CELL_ROWS", cell_rows)
    items = [*corpus.items(), (50, "twice"), (50, "the third of fifty"), (None, "no id")]
    rows = P.compare_with_next(documents(items, extra=True)).collect()
    expected = []
    for (doc, text), (_, after) in successors(items):
        text, half = text or "", len(text or "") // 2
        edited = text[:len(text) - half] + (after or "")[:half]
        expected.append((doc or -1, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in rows) == sorted(expected)
    prints = {}
    texts = {i: t or "" for i, t in corpus.items()}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 50:
            assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_signatures_follow_common_words(spark):
    rows = spark.createDataFrame(
        [(1, "The quick, brown fox of the Forest"), (2, "no. quick brown the fox the forest"),
         (3, "alpha beta"), (4, ""), (5, "alpha  beta!"), (6, "THE quick brown")],
        "doc_id long, text string")
    sets = rows_by_id(rows.select("doc_id", P.signatures(F.col("text")).alias("s")), "s")

    def h(*parts):
        return spark.range(1).select(F.hash(*[F.lit(p) for p in parts])).first()[0]

    assert set(sets[1]) == {h("the", "quick brown"), h("of", "forest"), h("the", "forest")}
    assert set(sets[6]) == {h("the", "quick brown")}
    assert sets[3] == sets[5] == [h("alpha beta")] and sets[4] == [h("")]
    assert len(sets[2]) == 3


def test_near_pairs_against_brute_force(documents, corpus):
    sets = documents(corpus).select(
        "doc_id", P.signatures(F.coalesce("text", F.lit(""))).alias("signatures"))
    each = {k: frozenset(v) for k, v in rows_by_id(sets, "signatures").items()}
    firsts = {}
    for doc in sorted(each):
        firsts.setdefault(each[doc], doc)
    expected = {}
    for a, i in firsts.items():
        for b, j in firsts.items():
            if i < j and len(a & b) >= 0.8 * len(a | b):
                expected[i, j] = len(a & b) / len(a | b)
    found = {tuple(sorted((r.left, r.right))): r.likeness for r in P.near_pairs(sets).collect()}
    assert expected and found == pytest.approx(expected)


def test_small_tables(documents):
    assert P.compare_with_next(documents([])).count() == 0
    (row,) = P.compare_with_next(documents({3: "abcd"})).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
