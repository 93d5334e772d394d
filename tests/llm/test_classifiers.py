import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.llm import boosting, linear, quality, toxicity
from stocklens.llm.labelled import held_out, labelled_texts
from stocklens.llm.text import LETTERS, VISIBLE, Hasher

from .helpers import rows_by_id


def crc(doc):
    return zlib.crc32(str(doc).encode())


@pytest.fixture(scope="module")
def marked(spark):
    """Texts, a third junk and a fifth toxic, some of which name groups."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "te", "nu") for c in ("s", "", "n")]
    bad = ("vilest", "rottenest", "scummy")
    rows = []
    for i in range(900):
        text = " ".join(rng.choices(words, k=rng.randrange(5, 60)))
        junk, toxic = i % 3 == 0, i % 5 == 0
        if i % 4 == 0 or (toxic and rng.random() < 0.5):
            text += " women " + rng.choice(words)
        if toxic:
            text += " " + rng.choice(bad) + " " + rng.choice(bad)
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, int(not junk), int(toxic)))
    rows += [(900, None, None, None), (901, "", 1, 0), (902, "x" * 50_000, 1, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return frame.select("doc_id", "text"), frame.drop("text").where("doc_id < 900 or doc_id = 901")


def test_held_out_rows(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"))
    out = rows_by_id(rows.withColumn("h", held_out(5, 0)), "h")
    assert out == {i: crc(i) % 5 == 0 for i in range(200)}
    null = spark.createDataFrame([(None,)], "doc_id long")
    assert null.select(held_out(5, 0)).first()[0] is False


def test_labelled_texts_are_bounded_and_joined(spark, marked):
    docs, labels = marked
    assert labelled_texts(docs, labels, "toxic", ~held_out(4, 2), 50).count() == 50
    twice = labels.where("doc_id = 5").select("doc_id", F.lit(0).alias("toxic"))
    some = labels.select("doc_id", "toxic").union(twice).where("doc_id = 5")
    assert labelled_texts(docs, some, "toxic", F.lit(True), 9).first().label == 1


def test_quality_on_held_out_rows(marked):
    docs, labels = marked
    forest = quality.train(docs, labels, ~held_out(5, 0))
    scored = quality.score(docs.withColumn("score", F.lit("old")).withColumn("label", F.lit(1)), forest)
    assert scored.columns == ["doc_id", "text", "label", "score"]
    rows = rows_by_id(scored, "score")
    assert len(rows) == 903 and all(0 <= s <= 1 for s in rows.values())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    tested = [i for i in truth if crc(i) % 5 == 0]
    right = [(rows[i] >= quality.LIMIT) == truth[i] for i in tested]
    assert np.mean(right) > 0.97
    kept = {r.doc_id for r in quality.keep_good(docs, forest).collect()}
    assert kept == {i for i, s in rows.items() if s >= quality.LIMIT}


def test_toxicity_on_held_out_rows(marked):
    docs, labels = marked
    model = toxicity.train(docs, labels, ~held_out(4, 2))
    rows = rows_by_id(toxicity.score(docs, model), "score")
    assert len(rows) == 903 and all(0 <= s <= 1 for s in rows.values())
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    tested = [i for i in truth if crc(i) % 4 == 2]
    assert np.mean([(rows[i] >= toxicity.LIMIT) == truth[i] for i in tested]) > 0.97


def test_group_names_carry_no_weight(marked):
    """Half of the toxic texts name a group; the penalty takes the name's weight away."""
    docs, labels = marked
    hasher = Hasher(LETTERS, lower=True)

    def change(steady):
        model = toxicity.train(docs, labels, F.lit(True), steady=steady)
        said = [np.frombuffer(f"lora {w} mite".encode(), np.uint8) for w in ("women", "men")]
        return abs(model.score(said[0], hasher) - model.score(said[1], hasher))

    assert change(50.0) < 0.5 * change(0.0)


def test_the_mention_of_a_group_carries_no_weight(marked):
    """Names are compared with a neutral word too, so that what they have in common goes."""
    docs, labels = marked
    hasher = Hasher(LETTERS, lower=True)

    def lift(steady, word):
        model = toxicity.train(docs, labels, F.lit(True), steady=steady)
        assert model.twins > 0
        plain, named = (np.frombuffer(f"lora {w} mite".encode(), np.uint8) for w in ("people", word))
        return model.score(named, hasher) - model.score(plain, hasher)

    before, after = lift(0.0, "women"), lift(50.0, "women")
    assert before > 0 and after < 0.5 * before


def test_every_text_has_twins():
    hasher = Hasher(LETTERS, lower=True)
    names = toxicity.Names.of(toxicity.IDENTITY_TERMS, hasher)

    def twins(text):
        return names.twins(hasher.words(np.frombuffer(text.encode(), np.uint8)))

    def feature(word):
        return toxicity.features(np.frombuffer(word.encode(), np.uint8), hasher)[0]

    swapped, neutral = twins("The Muslims and the women")
    assert [feature("muslims") in h for h, sign in swapped if sign == 1] == [True, False]
    assert any(feature("christians") in h for h, sign in swapped if sign == -1)
    assert any(feature("people") in h for h, sign in neutral if sign == -1)
    for text in ("no name at all", "", "étrangers"):
        assert len(twins(text)) == 2
    assert all(sign == -1 for twin in twins("no name at all") for _, sign in twin)
    assert toxicity.neutral_word("faiths de") == "leute" and toxicity.neutral_word("love") == "person"
    assert toxicity.Names.of({}, hasher).twins(hasher.words(np.zeros(0, np.uint8))) == []


def test_without_labels(documents, marked):
    docs, labels = marked
    forest = quality.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, forest).collect()} == {0.5}
    model = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert quality.score(documents([]), forest).count() == 0
    assert toxicity.score(documents([]), model).count() == 0


def test_forest_learns_and_walks_like_a_tree():
    rng = np.random.default_rng(1)
    values = rng.normal(size=(3000, 5))
    labels = ((values[:, 0] > 0.3) ^ (values[:, 3] < -0.2)).astype(float)
    forest = boosting.fit(values[:2000], labels[:2000])
    assert ((forest.scores(values[2000:]) > 0.5) == labels[2000:]).mean() > 0.95
    for row in values[:20]:
        total = forest.start
        for feature, limit, leaf in zip(forest.features, forest.limits, forest.leaves):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        assert forest.scores(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert forest.scores(values[:0]).shape == (0,)
    one = boosting.fit(values[:50], np.ones(50))
    assert one.scores(values[:5]).min() > 0.9


def test_linear_fit_is_the_minimum():
    rng = np.random.default_rng(2)
    dense = rng.normal(size=(200, 4))
    labels = (dense @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=200) > 0).astype(float)
    at = np.indices(dense.shape)
    rows = linear.Rows(200, at[0].ravel(), at[1].ravel(), dense.ravel())
    none = linear.Rows(0, np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    weights, intercept = linear.fit(rows, labels, none, 4, ridge=0.01, steps=5000)
    error = 1 / (1 + np.exp(-(dense @ weights + intercept))) - labels
    assert np.abs(dense.T @ error / 200 + 0.02 * weights).max() < 1e-4
    assert abs(error.mean()) < 1e-4


def test_statistics():
    hasher = Hasher(VISIBLE, lower=False)

    def stats(text):
        values = quality.statistics(np.frombuffer(text.encode(), np.uint8), hasher)
        return dict(zip(quality.STATISTICS, values))

    assert not any(stats("").values())
    some = stats("AB ab ab ab\nx, y")
    assert some["distinct_words"] == pytest.approx(4 / 6) or some["distinct_words"] == pytest.approx(5 / 6)
    assert some["repeats_before"] == pytest.approx(2 / 5) and some["upper_words"] == pytest.approx(1 / 6)
    assert stats("a\na\nb")["distinct_lines"] == pytest.approx(2 / 3)
    assert stats("   ")["log_words"] == 0
