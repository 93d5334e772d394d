"""Operator 1: mix sources to target weights by raking.

Documents are added up to cells of equal source, language and topic. Iterative
proportional fitting scales the cells' token weights to the target share of
each source, then of each language, then of each topic, and again until all
hold. A document's chance to be taken follows its cell's weight; chances above
1 are cut and the others raised, so that the expected number of tokens is as
asked. The margins are not fitted again after the cut: ``factor`` holds the
targets, the sample misses them where chances are cut.

Only cells take part in the rounds. Their number is that of the combinations
that occur; they stay a distributed table, whose sums are added up before they
are shuffled, and one number per round reaches the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.cuts import free_names
from stocklens.sources.scratch import materialized

MARGINS = ("source", "lang", "topic")
#: Exponent of a value's share of the tokens where no target is given: below 1
#: rare sources, languages and topics gain.
FLATTEN: Mapping[str, float] = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Share of all tokens that the sample is to hold.
BUDGET = 0.8
#: Rounds of fitting at most, and the largest relative change that ends them.
ROUNDS, TOLERANCE = 20, 1e-10
#: Rounds in which chances are cut at 1, at most; each but the last cuts more cells.
CUT_ROUNDS = 12

WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A topic for tables without one, from marks that a text contains."""
    return (
        F.when(F.contains(text, F.lit("icensed under")), "legal")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!!")), "shouting")
        .otherwise("prose")
    )


def _margins(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    given = {m: F.col(m).cast("string") for m in MARGINS if m in docs.columns}
    topic = given.get("topic", topic_of(text))
    return {m: F.coalesce({**given, "topic": topic}.get(m, F.lit("")), F.lit(""))
            for m in MARGINS}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the margins and n_tokens (words) of each document."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", *[c.alias(m) for m, c in _margins(docs).items()],
                       words.alias("n_tokens"))


def _targets(cells: DataFrame, margin: str, given: Mapping[str, float] | None) -> DataFrame:
    """Each value of a margin with its share; shares of the values that occur add up to 1."""
    values = cells.groupBy(margin).agg(F.sum("n_tokens").alias("n"))
    if given is None:
        share = F.pow(F.col("n").cast("double"), F.lit(FLATTEN[margin]))
    else:
        pairs = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
        share = F.when(F.col("n") > 0, F.coalesce(F.try_element_at(pairs, margin), F.lit(0.0)))
    values = values.select(margin, F.coalesce(share, F.lit(0.0)).alias("part"))
    total = values.agg(F.sum("part")).first()[0] or 1.0
    return values.select(margin, (F.col("part") / total).alias(f"{margin}_share"))


def rake(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
    rounds: int = ROUNDS, tolerance: float = TOLERANCE,
) -> DataFrame:
    """The cells with a ``weight``: their share of the tokens once the margins hold."""
    total = cells.agg(F.sum("n_tokens")).first()[0] or 1
    for margin in MARGINS:
        cells = cells.join(_targets(cells, margin, (targets or {}).get(margin)), margin)
    cells = cells.withColumn("weight", F.col("n_tokens") / F.lit(float(total)))
    shares, largest = [f"{m}_share" for m in MARGINS], None
    for _ in range(rounds):
        before = F.col("weight").alias("before")
        step = cells.withColumn("before", before)
        for margin in MARGINS:
            # A join with the sums would hold the plan so far twice, and eight times after all margins.
            sums = F.sum("weight").over(Window.partitionBy(margin))
            scale = F.when(F.col("sum") > 0, F.col(f"{margin}_share") / F.col("sum"))
            step = step.withColumn("sum", sums).withColumn(
                "weight", F.col("weight") * F.coalesce(scale, F.lit(1.0))).drop("sum")
        done = materialized(step, "rake")
        change = F.abs(F.col("weight") - F.col("before")) / F.greatest(
            F.col("before"), F.lit(1e-300))
        largest = done.agg(F.max(change)).first()[0]
        cells = done.drop("before")
        if largest is None or largest <= tolerance:
            break
    else:
        warnings.warn(f"margins still change by {largest} of a weight after {rounds} rounds")
    return cells.drop(*shares)


def calibrate(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The raked cells with ``factor`` and ``probability``.

    ``factor`` is the weight over the cell's share of the tokens; a cell
    without tokens has 1.
    """
    total = float(cells.agg(F.sum("n_tokens")).first()[0] or 0)
    factor = F.when(F.col("n_tokens") > 0, F.col("weight") * total / F.col("n_tokens"))
    cells = cells.withColumn("factor", F.coalesce(factor, F.lit(1.0)))
    tokens, scale = F.col("n_tokens").cast("double"), float(budget)
    for _ in range(CUT_ROUNDS):
        cut = F.col("factor") * F.lit(scale) >= 1
        full, rest = cells.agg(
            F.sum(F.when(cut, tokens).otherwise(0.0)),
            F.sum(F.when(cut, 0.0).otherwise(tokens * F.col("factor"))),
        ).first()
        new = (budget * total - full) / rest if rest else scale
        if new <= scale:
            break
        scale = new
    else:
        warnings.warn(f"chances are not settled after {CUT_ROUNDS} rounds; the budget is not met")
    return cells.withColumn("probability", F.least(F.col("factor") * F.lit(scale), F.lit(1.0)))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")
    return digits / F.lit(float(16**12))


def _cells(rows: DataFrame, targets, budget: float) -> DataFrame:
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens"))
    raked = rake(materialized(cells, "cells"), targets)
    return calibrate(raked, budget).select(*MARGINS, "factor", "probability")


def mixture(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET, seed: int = 0,
) -> DataFrame:
    """doc_id, margins, n_tokens, factor, probability and sampled of every document.

    ``targets`` gives shares per margin and value; values without one get
    none, margins without targets are flattened (``FLATTEN``). A null margin is
    the empty name, and so is one the table lacks; without a ``topic`` column
    the topic is taken from the text. Documents without words follow their
    cell. Rows with equal ids are drawn alike. An empty table gives no rows.
    """
    rows = materialized(measured(docs), "measured")
    cells = _cells(rows, targets, budget)
    out = rows.join(cells, list(MARGINS))
    return out.select(
        "doc_id", *MARGINS, "n_tokens", "factor", "probability",
        (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def sample_mixture(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET, seed: int = 0,
) -> DataFrame:
    """The sampled documents with their columns."""
    rows = measured(docs)
    cells = _cells(rows, targets, budget)
    *own, chance = free_names(docs, *[f"_mix_{m}" for m in MARGINS], "_mix_chance")
    names = dict(zip(MARGINS, own))
    keyed = docs.withColumns({names[m]: c for m, c in _margins(docs).items()})
    cells = cells.select(*[F.col(m).alias(names[m]) for m in MARGINS],
                         F.col("probability").alias(chance))
    taken = keyed.join(cells, list(names.values())).where(
        draw(F.col("doc_id"), seed) < F.col(chance))
    return taken.select(*docs.columns)
