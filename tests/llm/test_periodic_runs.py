import hashlib
import random
import zlib

import numpy as np
import pytest

from stocklens.llm import periodic_runs as P
from stocklens.llm import queries

from .helpers import rows_by_id


def brute(words, shortest=0):
    """start, length and period of every run, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= shortest)


def runs_of(words):
    return sorted((s, e - s, q) for s, e, q in P.find_runs(np.array(words, np.int64)).tolist())


def sequences():
    rng = random.Random(11)
    a, b = [0], [0, 1]
    while len(b) < 500:
        a, b = b, b + a
    yield b  # Fibonacci word
    yield [bin(i).count("1") & 1 for i in range(512)]  # Thue-Morse word
    yield from ([], [1], [1, 1], [1] * 300, [1, 2] * 100 + [1] + [1, 2] * 100)
    for _ in range(300):
        n = rng.randrange(1, 160)
        yield [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(n)]
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        yield (root * 6)[:rng.randrange(1, 6 * len(root) + 1)] + root + root[:-1] + root
        # A period that is highly periodic itself, and edits.
        root = [0, 1] * rng.randrange(9, 25) + [0] * rng.randrange(3)
        words = root * rng.randrange(2, 5)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.randrange(3)
        yield words
        # Two runs of one period that meet out of step: squares of many lengths around one place.
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        run = root * rng.randrange(9, 16) + root[:rng.randrange(len(root))]
        yield run + run[rng.randrange(len(root)):]
        doubled = [0]
        while len(doubled) < n:
            doubled = doubled + doubled[:rng.randrange(1, len(doubled) + 1)] + [rng.randrange(4)]
        yield doubled


def test_every_run_against_brute_force():
    for words in sequences():
        assert runs_of(words) == brute(words), words


def test_the_second_source_of_periods_is_needed(monkeypatch):
    """Without meeting runs some are lost: they come from there, not by chance from elsewhere."""
    words = [7] + [0, 1] * 20 + [0] + [0, 1] * 20 + [0, 9]
    expected = brute(words)
    assert runs_of(words) == expected
    monkeypatch.setattr(P, "_meeting_runs", lambda *a: None)
    assert len(runs_of(words)) < len(expected)


def test_synchronising_sets_are_sparse_and_consistent():
    rng = random.Random(2)
    root = [rng.randrange(20) for _ in range(900)]
    words = np.array(root * 4, np.int64)
    names = P.Names(words)
    for level in (2, 4, 6):
        t = 1 << level
        members = P.synchronising_set(names, level, P.Runs())
        inside = set(members.tolist())
        assert len(members) < 6 * len(words) / t
        for i in members[members < 2000].tolist():
            assert i + 900 in inside
        assert max(np.diff(members)) <= t


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_documents(spark, documents, corpus):
    rng = random.Random(4)
    texts = dict(corpus)
    texts |= {200: "la " * 40, 201: "a b c\n" * 9 + "end", 202: " ".join("xy" * 6), 203: "A a " * 7,
              204: " ".join(rng.choice("ab") for _ in range(4000)), 205: "é ü " * 6 + "é"}
    items = [*texts.items(), (5, "x " * 20), (5, "x " * 20), (None, "y " * 20)]
    found = P.periodic_runs(documents(items, extra=True)).collect()
    expected = []
    for i, t in items:
        words = (t or "").split()
        runs = brute(words, P.SHORTEST)
        expected.append((i, len(words), runs, collapsed(words, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert any(runs for _, _, runs, _ in expected)


def test_texts_of_one_group_do_not_mix():
    """Copies side by side: nothing is periodic across them."""
    text = np.frombuffer(b"one two three four five six seven " * 1, np.uint8)
    assert [len(r) for r in P.text_runs([text] * 50)] == [0] * 50


def planted(text, doc_id):
    words = (text or "").split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_the_query_against_brute_force(spark, documents, corpus, tmp_path):
    rng = random.Random(9)
    texts = {i: t for i, t in corpus.items() if len(t or "") < 2000}
    texts |= {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 120)))
              for i in range(1000, 1300)}
    documents(texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    got = rows_by_id(found, *found.columns[1:])
    for i, t in texts.items():
        words = planted(t, i)
        runs = brute(words, 12)
        most = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        best = (*most, 1000 * most[1] // most[2]) if most else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs))]
        assert got[i] == (len(runs), *best, *digests), i
    assert sum(r[0] > 0 for r in got.values()) > 20


@pytest.mark.parametrize("size", [0, 1])
def test_small_tables(spark, documents, size):
    out = P.periodic_runs(documents([(1, None)] * size))
    assert [tuple(r) for r in out.collect()] == [(1, 0, [], "")] * size
