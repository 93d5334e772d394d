import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.llm import components as C
from stocklens.llm import ngram_join as J
from stocklens.llm import substring_dedup as S

from .helpers import LOWER, rows_by_id

WORD = re.compile("[^\x20\x09-\x0D]+")


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)],
    [(i, i * 7 % 101) for i in range(101)], [(40 - i, 41 - i) for i in range(0, 40, 2)],
])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "u long, v long")
    groups = Groups({n for e in edges for n in e})
    for a, b in edges:
        groups.tie(a, b)
    expected = {n: groups.find(n) for n in groups.up if groups.find(n) != n}
    assert {r.node: r.root for r in C.components(frame).collect()} == expected


def shingle_sets(items, k):
    out = []
    for _, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        out.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k
                   else frozenset([tuple(w)] if w else []))
    return out


def brute(items, k, percent):
    sets = shingle_sets(items, k)
    groups = Groups(range(len(items)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                groups.tie(i, j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(items):
        least[groups.find(i)].append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in least.items()}
    return [(doc, len(s), least[groups.find(i)]) for i, ((doc, _), s) in enumerate(zip(items, sets))]


@pytest.mark.parametrize(("k", "percent", "hubs"), [(4, 85, 3), (5, 80, 0), (2, 60, 1)])
def test_join_against_brute_force(documents, corpus, k, percent, hubs):
    items = [*corpus.items(), (5, corpus[20]), (None, corpus[20] + " more"), (None, "alone"),
             (7, corpus[7])]
    found = J.ngram_components(documents(items, extra=True), k, percent, hubs)
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]
    order = lambda r: tuple(x if x is not None else -1 for x in r)
    assert sorted(rows, key=order) == sorted(brute(items, k, percent), key=order)


def test_a_chain_of_near_copies(documents):
    """Each text is like its neighbours only; all are one component."""
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(words[3 * i:3 * i + 100]) for i in range(60)}
    rows = rows_by_id(J.ngram_components(documents(texts), 4, 85), "component_id")
    assert set(rows.values()) == {0}


def test_prefixes_hold_a_shared_shingle():
    rng = np.random.default_rng(0)
    levels = rng.integers(0, 200, 1 << J.COUNTER_BITS).astype(np.uint8)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, max(1, n // 8) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 85 * (len(a) + len(b) - both):
            for p, q in zip(J.prefixes(a, levels, 85), J.prefixes(b, levels, 85)):
                assert len(np.intersect1d(p, q)) >= 1


def test_one_of_each_group(documents, corpus):
    docs = documents([*corpus.items(), (None, "alone"), (3, corpus[20])], extra=True)
    kept = J.one_of_each_group(docs, 4, 85)
    assert kept.columns == docs.columns
    expected = brute([*corpus.items(), (None, "alone"), (3, corpus[20])], 4, 85)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(d) for d, _, c in expected if d == c)


def test_one_row_of_each_group_stays(documents):
    """Repeated rows, near copies of one id, and near copies without ids."""
    def near(name):
        words = [f"{name}{i}" for i in range(60)]
        return [" ".join([*words[:-j], *["edited"] * j]) if j else " ".join(words) for j in range(3)]

    same, shared, without = near("a"), near("b"), near("c")
    items = [(1, same[0])] * 50 + [(2, same[0]), (9, same[1])] + [(4, t) for t in shared]
    items += [(None, t) for t in without] + [(None, without[0])] * 20 + [(4, "other"), (7, ""), (8, None)]
    kept = [(r.doc_id, r.text) for r in J.one_of_each_group(documents(items, extra=True)).collect()]
    assert sorted(d for d, t in kept if d is not None) == [1, 4, 4, 7, 8]
    assert (1, same[0]) in kept and (4, "other") in kept
    assert [d for d, t in kept if t in shared] == [4]
    assert [d for d, t in kept if t in without] == [None]


def test_join_of_empty_tables(documents):
    assert J.ngram_components(documents([])).count() == 0
    rows = J.ngram_components(documents({1: None, 2: "", 3: "a"})).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(1, 0, 1), (2, 0, 2), (3, 1, 3)}


def cut(items, n):
    first = {}
    for doc, text in items:
        w = WORD.findall(text or "")
        for i in range(len(w) - n + 1):
            if doc is not None:
                key = tuple(w[i:i + n])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in items:
        w, gone = WORD.findall(text or ""), set()
        for i in range(len(w) - n + 1):
            if doc is not None and first[tuple(w[i:i + n])] < doc:
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize(("phrase", "bucket", "shard"), [(13, 4 << 20, 20_000), (13, 2000, 7), (6, 500, 50)])
def test_passages_against_brute_force(monkeypatch, documents, corpus, phrase, bucket, shard):
    monkeypatch.setattr(S, "BUCKET_BYTES", bucket)
    items = [*corpus.items(), (5, corpus[20]), (99, corpus[98]), (None, corpus[98]), (7, corpus[7])]
    out = S.remove_repeats(documents(items, extra=True), phrase)
    rows = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()]
    assert sorted(rows, key=str) == sorted(cut(items, phrase), key=str)
    spans = out.withColumn("n", F.aggregate(
        "removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    assert spans.where("n != n_removed").count() == 0


def test_passages_of_empty_tables(documents):
    assert S.remove_repeats(documents([])).count() == 0
    rows = S.remove_repeats(documents({1: None, 2: ""})).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows} == {(1, 0, 0, ""), (2, 0, 0, "")}


def test_one_of_each_group_with_columns_of_its_own_names(documents):
    docs = documents([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y z u v w"), (3, "x y z u v w")])
    for name in ("_id", "_key", "_Repeats"):
        docs = docs.selectExpr("*", f"'own' AS {name}")
    kept = J.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_overlaps_of_sets():
    rng = np.random.default_rng(3)
    sets = [rng.choice(400, rng.integers(0, 90), replace=False) for _ in range(50)] + [np.arange(5000)] * 20
    found = J.overlaps(np.array([len(s) for s in sets]), np.concatenate(sets).astype(np.int64))
    for i, a in enumerate(sets):
        assert [int(x) for j, x in enumerate(found[i]) if j != i] == [
            len(np.intersect1d(a, b)) for j, b in enumerate(sets) if j != i]


@pytest.mark.parametrize("block", [1024, 24])
def test_a_crowd_just_below_the_threshold(monkeypatch, documents, block):
    """Its links are all found, and the pairs compared one by one do not grow with its square."""
    rng = np.random.default_rng(5)
    words, texts = [f"w{i}" for i in range(150)], {}
    for i in range(240):
        own = list(words)
        for at in rng.choice(150, rng.integers(2, 9), replace=False):
            own[at] = f"x{i}y{at}"
        texts[i] = " ".join(own)
    monkeypatch.setattr(J, "BLOCK", block)
    seen, links = [], J._Join.links
    monkeypatch.setattr(J._Join, "links", lambda self, pairs: (
        seen.append(pairs.count()), links(self, pairs))[1])
    found = J.ngram_components(documents(texts), 4, 85, 0)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert rows == sorted(brute([*texts.items()], 4, 85))
    assert sum(seen) <= J.CROWDED * len(texts)


def test_repeated_words_are_held_as_marks():
    """Occurrences are not kept: what a phrase met many times leaves does not grow with them."""
    import tracemalloc

    numbers, digits = S._spelt(np.zeros(60_000, np.int64))
    phrases = np.array([[0, 0, length, 1] for length in range(13, 33)])
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    sequence = tuple(numbers[:3_000].tolist())
    found = S._repeated([sequence] * 20, [2] * 20, phrases, digits)
    grown = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert all(f.all() and len(f) == 3_000 for f in found) and grown < 1_000_000


def test_tasks_of_op10_take_one_python_worker(documents, corpus, monkeypatch):
    table, top = S.bit_table, []

    def spy(rows, *hashes_of):
        top.append(rows._jdf.queryExecution().optimizedPlan().nodeName())
        return table(rows, *hashes_of)

    monkeypatch.setattr(S, "bit_table", spy)
    S.remove_repeats(documents(corpus)).collect()
    # A Python step right before that of the table would be a second worker in the same task.
    assert len(top) == 3 and "MapInArrow" not in top


@pytest.mark.parametrize("edges", [[], [(i, 0) for i in range(1, 30)], [(2, 7), (1, 1), (7, 2), (3, 9)]])
def test_settled_components_take_no_round(spark, monkeypatch, edges):
    written, write = [], C.materialized
    monkeypatch.setattr(C, "materialized", lambda df, label: (written.append(label), write(df, label))[1])
    found = C.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.root for r in found.collect()} == {
        max(e): min(e) for e in edges if e[0] != e[1]}
    assert len(written) == 1
