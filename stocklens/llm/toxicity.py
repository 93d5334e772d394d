"""Operator 7: a toxicity classifier that does not react to group names.

A logistic regression over words and word beginnings is fitted on a bounded
sample of labelled documents. Each of these gets counterfactual twins: where it
names a group, with another group of the same kind and with a neutral word in
its place; where it names none, with a name put in. A change of the score between
a document and its twin is penalised, so that neither one name more than
another nor the mention of any carries weight.

Features are counted in the tasks and added up by Spark; a bounded number of
them, those that tell most about the label, becomes the vocabulary. Scoring is
one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stocklens.llm.labelled import labelled_texts
from stocklens.llm.linear import Rows, fit
from stocklens.llm.text import LETTERS, Hasher, byte_rows, mix
from stocklens.sources.scratch import materialized

#: Labelled documents to learn from, at most, and the share of them that may be toxic.
SAMPLE, TOXIC_SHARE = 12_000, 0.4
#: Features of the model.
VOCABULARY = 6_000
#: Word beginnings that count as features, in bytes.
STEMS = (4, 5, 6, 7, 8, 9)
#: Scores from here on are class 1.
LIMIT = 0.3

#: Group names that may stand for each other: per kind, language and number in one order.
IDENTITY_TERMS: Mapping[str, Sequence[str]] = {
    "faith": ("muslim", "christian", "jew", "hindu", "buddhist", "atheist"),
    "faiths": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    "faith adjective": ("islamic", "catholic", "jewish", "protestant"),
    "faiths fr": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    "faith fr": ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    "faiths de": ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    "faiths es": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    "faith es": ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    "gender": ("woman", "man", "girl", "boy"),
    "genders": ("women", "men", "girls", "boys"),
    "genders fr": ("femmes", "hommes", "filles", "garçons"),
    "genders de": ("frauen", "männer", "mädchen", "jungen"),
    "genders es": ("mujeres", "hombres", "chicas", "chicos"),
    "origin": ("african", "asian", "european", "american", "immigrant", "refugee", "foreigner"),
    "origins": ("africans", "asians", "europeans", "americans", "immigrants", "refugees", "foreigners"),
    "origins fr": ("africains", "asiatiques", "européens", "américains", "immigrés", "réfugiés", "étrangers"),
    "origins de": ("afrikaner", "asiaten", "europäer", "amerikaner", "einwanderer", "flüchtlinge", "ausländer"),
    "origins es": ("africanos", "asiáticos", "europeos", "americanos", "inmigrantes", "refugiados", "extranjeros"),
    "love": ("gay", "lesbian", "straight", "bisexual", "homosexual", "transgender"),
    "loves fr": ("gays", "lesbiennes", "hétérosexuels", "bisexuels", "homosexuels"),
    "loves de": ("schwule", "lesben", "heterosexuelle", "bisexuelle", "homosexuelle"),
    "loves es": ("gays", "lesbianas", "heterosexuales", "bisexuales", "homosexuales"),
    "age": ("child", "adult", "teenager", "pensioner"),
    "ages": ("children", "adults", "teenagers", "elderly", "pensioners"),
    "ages fr": ("enfants", "adultes", "adolescents", "retraités"),
    "ages de": ("kinder", "erwachsene", "jugendliche", "rentner"),
    "ages es": ("niños", "adultos", "adolescentes", "jubilados"),
}
#: What names nobody in particular, by the language at the end of a kind and by number.
NEUTRAL = {"": "person", "s": "people", "s fr": "gens", " fr": "individu", "s de": "leute",
           "s es": "gente", " es": "persona"}


def neutral_word(kind: str) -> str:
    """The neutral word for names of a kind."""
    ends = [e for e in NEUTRAL if kind.endswith(e)]
    return NEUTRAL[max(ends, key=len)]


def features(data: np.ndarray, hasher: Hasher) -> np.ndarray:
    """Hashes of a text's words and of the beginnings of longer words."""
    starts, ends = hasher.spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = [hasher.hashes(data, starts, ends)]
    for k in STEMS:
        long = ends - starts > k
        if long.any():
            stems = hasher.hashes(data, starts[long], starts[long] + k)
            out.append(mix(stems + np.uint64(k)))
    return np.concatenate(out)


@dataclass(frozen=True)
class Names:
    """Words that name a group, by hash: their features, those of another name, and of a neutral word."""

    hashes: np.ndarray
    own: list[np.ndarray]
    other: list[np.ndarray]
    neutral: list[np.ndarray]

    @classmethod
    def of(cls, groups: Mapping[str, Sequence[str]], hasher: Hasher) -> Names:
        def encoded(word: str) -> np.ndarray:
            return np.frombuffer(word.encode(), np.uint8)

        rows: dict[int, tuple] = {}
        for kind, words in groups.items():
            each = [np.unique(features(encoded(w), hasher)) for w in words]
            plain = np.unique(features(encoded(neutral_word(kind)), hasher))
            for i, word in enumerate(words):
                name = int(hasher.words(encoded(word))[0])
                rows.setdefault(name, (each[i], each[(i + 1) % len(words)], plain))
        order = sorted(rows)
        return cls(np.array(order, np.uint64), *([rows[n][i] for n in order] for i in range(3)))

    def twins(self, words: np.ndarray) -> list[list[tuple[np.ndarray, int]]]:
        """Counterfactual twins of a text: the features that each has less (1) and more (-1).

        A text that names groups has one with other names and one with neutral
        words in their place. One that names none has two with a name put in,
        which the text's own words choose.
        """
        if not len(self.hashes):
            return []
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        at = at[self.hashes[at] == words] if len(words) else at
        if len(at):
            return [[c for i in at for c in ((self.own[i], 1), (side[i], -1))]
                    for side in (self.other, self.neutral)]
        chosen = int(words.sum(dtype=np.uint64)) % len(self.hashes)
        return [[(side[chosen], -1)] for side in (self.own, self.other)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a feature, added up per batch."""
    hasher = Hasher(LETTERS, lower=True)
    for batch in batches:
        labels = batch.column(2).to_numpy()
        held = [np.unique(features(data, hasher)) for data in byte_rows(batch.column(1))]
        every = np.concatenate(held) if held else np.zeros(0, np.uint64)
        found, place = np.unique(every, return_inverse=True)
        toxic = np.repeat(labels, [len(h) for h in held])
        ones = np.bincount(place, toxic, len(found)).astype(np.int64)
        total = np.bincount(place, minlength=len(found))
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(ones), pa.array(total - ones)],
            ["feature", "ones", "zeros"],
        )


def _vocabulary(sample: DataFrame, ones: int, zeros: int, size: int) -> np.ndarray:
    """The features with the largest log-likelihood ratio of class and presence."""
    counts = sample.mapInArrow(_counted, "feature long, ones long, zeros long")
    counts = counts.groupBy("feature").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
    a, b, n = F.col("a"), F.col("b"), ones + zeros

    def part(seen: Column, row: Column, column: float) -> Column:
        expected = row * column / n
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = (
        part(a, a + b, ones) + part(b, a + b, zeros)
        + part(ones - a, n - a - b, ones) + part(zeros - b, n - a - b, zeros)
    )
    best = (
        counts.where(a + b >= 3).withColumn("ratio", ratio)
        .orderBy(F.desc("ratio"), "feature").limit(size).select("feature")
    )
    return np.array([r[0] for r in best.collect()], np.int64).view(np.uint64)


class Table:
    """Places of hashes in a sorted vocabulary, with a quick test for strangers."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes & np.uint64((1 << 20) - 1)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        maybe = hashes[self.seen[hashes & np.uint64((1 << 20) - 1)]]
        if not len(maybe):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, maybe), len(self.hashes) - 1)
        return at[self.hashes[at] == maybe]


def _row(data: np.ndarray, hasher: Hasher, table: Table) -> tuple[np.ndarray, np.ndarray]:
    columns, counts = np.unique(table.places(features(data, hasher)), return_counts=True)
    return columns, np.log1p(counts)


def _encoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, groups = shared.value
        hasher = Hasher(LETTERS, lower=True)
        names = Names.of(groups, hasher)
        for batch in batches:
            out = []
            for data in byte_rows(batch.column(1)):
                columns, values = _row(data, hasher, table)
                words = hasher.words(data)
                changes = []
                for twin in names.twins(words):
                    change: dict[int, float] = {}
                    for hashes, sign in twin:
                        for place in table.places(hashes).tolist():
                            change[place] = change.get(place, 0.0) + sign
                    changes.append({p: c for p, c in change.items() if c})
                first, second = [*changes, {}, {}][:2]
                out.append((columns.tolist(), values.tolist(), list(first), list(first.values()),
                            list(second), list(second.values())))
            names_out = ["columns", "values", "changed", "change", "changed_too", "change_too"]
            kinds = [pa.int64(), pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), *(pa.array([o[i] for o in out], pa.list_(k))
                                    for i, k in enumerate(kinds))],
                ["label", *names_out],
            )

    return run


def _rows(table: pa.Table, columns: str, values: str) -> Rows:
    lists = table.column(columns).combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    return Rows(
        len(lists), np.repeat(np.arange(len(lists)), sizes),
        np.asarray(lists.flatten(), np.int64),
        np.asarray(table.column(values).combine_chunks().flatten(), float),
    )


def _together(one: Rows, two: Rows) -> Rows:
    """The rows of both that have entries."""
    rows = np.concatenate([one.rows, one.count + two.rows])
    _, rows = np.unique(rows, return_inverse=True)
    return Rows(int(rows.max(initial=-1)) + 1, rows, np.concatenate([one.columns, two.columns]),
                np.concatenate([one.values, two.values]))


@dataclass(frozen=True)
class Model:
    table: Table
    weights: np.ndarray
    intercept: float
    #: Counterfactual twins that took part in the fit.
    twins: int = 0

    def score(self, data: np.ndarray, hasher: Hasher) -> float:
        columns, values = _row(data, hasher, self.table)
        return float(1 / (1 + np.exp(-(self.intercept + self.weights[columns] @ values))))


def train(
    docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic",
    sample: int = SAMPLE, vocabulary: int = VOCABULARY,
    identity_terms: Mapping[str, Sequence[str]] = IDENTITY_TERMS, steady: float = 1.0,
) -> Model:
    """Fit the model on at most ``sample`` labelled documents.

    Toxic documents are rare, so they may make up a larger share of the sample
    than of the labels; the intercept is set back to the share in the labels.
    Without labels every score is 0.5, with one class only close to that class.
    """
    spark = docs.sparkSession
    known = labels.where(train_rows & F.col(label).isNotNull())
    row = known.agg(F.count_if(F.col(label) == 1).alias("ones"),
                    F.count_if(F.col(label) == 0).alias("zeros")).first()
    most = int(sample * TOXIC_SHARE)
    parts = [labelled_texts(docs, known.where(F.col(label) == value), label, F.lit(True), bound)
             for value, bound in ((1, most), (0, sample - min(most, row["ones"])))]
    texts = materialized(parts[0].unionByName(parts[1]), "toxicity-sample")
    size = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    ones, zeros = size.get(1, 0), size.get(0, 0)
    hasher = Hasher(LETTERS, lower=True)
    names = Names.of(identity_terms, hasher)
    terms = [*names.own, *names.other, *names.neutral]
    chosen = _vocabulary(texts, ones, zeros, vocabulary) if ones and zeros else []
    table = Table(np.unique(np.concatenate([np.array(chosen, np.uint64), *terms])))
    shared = spark.sparkContext.broadcast((table, identity_terms))
    encoded = texts.mapInArrow(
        _encoded(shared),
        "label int, columns array<long>, values array<double>, changed array<long>, "
        "change array<double>, changed_too array<long>, change_too array<double>",
    ).toArrow()
    rows = _rows(encoded, "columns", "values")
    changes = _together(_rows(encoded, "changed", "change"),
                        _rows(encoded, "changed_too", "change_too"))
    weights, intercept = fit(rows, np.asarray(encoded.column("label"), float), changes,
                             len(table.hashes), steady=steady)
    if ones and zeros and row["ones"] and row["zeros"]:
        intercept += float(np.log(row["ones"] / row["zeros"]) - np.log(ones / zeros))
    return Model(table, weights, intercept, changes.count)


def _scored(shared, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, Hasher(LETTERS, lower=True)
        for batch in batches:
            scores = [model.score(data, hasher) for data in byte_rows(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with a ``score`` column: the probability of label 1.

    Whole texts are read; null and empty texts have no feature and get the
    intercept's score. An existing ``score`` column is replaced; other extra
    columns stay as they are.
    """
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(shared, docs.columns.index("text")), schema)
