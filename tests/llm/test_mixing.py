import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stocklens.llm import mixing as M

from .helpers import rows_by_id


def topic(text):
    for mark, name in (("icensed under", "legal"), (" | ", "table"), ("!!", "shouting")):
        if mark in text:
            return name
    return "prose"


def brute(rows, targets, budget):
    """Rakes until it stands still, then cuts chances at 1."""
    n = {}
    for doc, text, lang, source in rows:
        cell = (source or "", lang or "", topic(text or ""))
        n.setdefault(cell, 0)
        n[cell] += len(re.findall("[^\x20\x09-\x0D]+", text or ""))
    total = sum(n.values())
    goal = []
    for i, margin in enumerate(M.MARGINS):
        sums = Counter()
        for cell, tokens in n.items():
            sums[cell[i]] += tokens
        given = targets.get(margin)
        part = {v: ((given.get(v, 0.0) if s else 0.0) if given is not None
                    else s ** M.FLATTEN[margin]) for v, s in sums.items()}
        goal.append({v: p / sum(part.values()) for v, p in part.items()})
    weight = {c: t / total for c, t in n.items()}
    for _ in range(M.ROUNDS):
        for i in range(3):
            sums = Counter()
            for cell, w in weight.items():
                sums[cell[i]] += w
            weight = {c: w * goal[i][c[i]] / sums[c[i]] if sums[c[i]] else w
                      for c, w in weight.items()}
    factor = {c: weight[c] * total / t if t else 1.0 for c, t in n.items()}
    scale = budget
    for _ in range(M.CUT_ROUNDS):
        full = sum(t for c, t in n.items() if factor[c] * scale >= 1)
        rest = sum(t * factor[c] for c, t in n.items() if factor[c] * scale < 1)
        new = (budget * total - full) / rest if rest else scale
        if new <= scale:
            break
        scale = new
    return {c: (f, min(f * scale, 1.0)) for c, f in factor.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    marks = ("", "", " | ", "!!", "Licensed under")
    out = [(i, "word " * rng.randrange(60) + rng.choice(marks),
            rng.choice(("en", "en", "fr", None)), "hot" if i % 3 else rng.choice("abc"))
           for i in range(300)]
    return [*out, (300, None, "en", "empty"), (301, "", None, None), (5, "twice", "en", "a"),
            (None, "no id", "fr", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("targets", [{}, {"source": {"hot": 0.2, "a": 0.5, "b": 0.3}}])
def test_against_brute_force(docs, rows, targets):
    cells = brute(rows, targets, 0.6)
    found = M.mixture(docs, targets, budget=0.6, seed=3).collect()
    assert len(found) == len(rows)
    for row in found:
        factor, chance = cells[row.source, row.lang, row.topic]
        assert (row.factor, row.probability) == pytest.approx((factor, chance), abs=2e-6)
        digest = hashlib.md5(f"3:{'null' if row.doc_id is None else row.doc_id}".encode())
        draw = int(digest.hexdigest()[:12], 16) / 16**12
        assert row.sampled == (draw < row.probability)


def test_margins_and_budget_hold(docs):
    out = M.mixture(docs, {"source": {"hot": 0.4, "a": 0.3, "b": 0.2, "c": 0.1}}, budget=0.3)
    shares = out.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("factor")).alias("w")).collect()
    total = sum(r.w for r in shares)
    assert {r.source: round(r.w / total, 2) for r in shares if r.w} == {
        "hot": 0.4, "a": 0.3, "b": 0.2, "c": 0.1}
    expected, every = out.agg(
        F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens")).first()
    assert expected / every == pytest.approx(0.3, abs=1e-3)


def test_the_sample_keeps_columns_and_rows(docs):
    taken = M.sample_mixture(docs.withColumn("topic", F.lit("own")).withColumn("weight", F.lit(1)))
    assert taken.columns == [*docs.columns, "topic", "weight"]
    mixed = M.mixture(docs.withColumn("topic", F.lit("own")))
    assert rows_by_id(taken, "doc_id").keys() == {
        r.doc_id for r in mixed.where("sampled").collect()}


def test_empty_tables(docs):
    assert M.mixture(docs.limit(0)).count() == 0
    assert M.sample_mixture(docs.limit(0)).count() == 0
    assert M.mixture(docs.where("text = ''")).count() > 0


def test_small_chances_are_drawn_from(spark):
    """A chance far below a millionth is kept as it is: no row is out of reach."""
    rows = [(i, "word " * 50, "en", "large") for i in range(50)] + [(99, "word", "en", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = M.mixture(docs, {"source": {"large": 1 - 1e-12, "small": 1e-12}}, budget=1e-3)
    (small,) = out.where("source = 'small'").collect()
    assert 0 < small.probability < 1e-8
    for name in ("_mix_source", "_MIX_chance"):
        docs = docs.withColumn(name, F.lit("own"))
    assert M.sample_mixture(docs).columns == docs.columns


def test_a_round_reads_its_cells_once(docs, monkeypatch):
    """The plan of a raking round does not double with each margin."""
    leaves, write = [], M.materialized

    def spy(df, label):
        leaves.append((label, df._jdf.queryExecution().optimizedPlan().collectLeaves().size()))
        return write(df, label)

    monkeypatch.setattr(M, "materialized", spy)
    M.mixture(docs).collect()
    rounds = [n for label, n in leaves if label == "rake"]
    assert len(rounds) > 1 and set(rounds[1:]) == {1}
