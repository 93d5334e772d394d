import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stocklens.llm import mixing, quality
from stocklens.llm.queries import ORACLE, QUERIES
from stocklens.sources.scratch import materialized

from .test_decontamination import brute as contaminated
from .test_joins import brute as grouped

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialized(stage(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [name for name, _, after in stages if after.columns == columns] == [
        "quality", "near_duplicates", "decontamination", "mixing"]


def test_stages_against_brute_force(spark, stages):
    by_name = {name: (before, after) for name, before, after in stages}

    def ids(frame):
        return {r[0] for r in frame.select("doc_id").collect()}

    before, after = by_name["quality"]
    forest = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    assert ids(after) == ids(quality.score(before, forest).where("score >= 0.3"))
    before, after = by_name["near_duplicates"]
    items = [(r.doc_id, r.text) for r in before.collect()]
    assert ids(after) == {d for d, _, c in grouped(items, 5, 80) if d == c}
    before, after = by_name["decontamination"]
    benchmark = [(r.item_id, r.text) for r in
                 spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = contaminated({r.doc_id: r.text for r in before.collect()}, benchmark)
    assert ids(after) == {d for d, (_, hit, _) in found.items() if not hit}
    before, after = by_name["mixing"]
    assert ids(after) == ids(mixing.mixture(before).where("sampled"))
    before, after = by_name["token_files"]
    assert ids(after) == ids(before)


def test_stages_take_extra_columns_and_odd_rows(spark, documents, corpus):
    docs = documents([*corpus.items(), (None, "no id"), (3, "again"), (3, "again")], extra=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_files":
            assert out.columns == docs.columns
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLE) <= set(QUERIES)


def test_written_stages_give_their_shuffles_up(spark, monkeypatch):
    from stocklens.sources import scratch

    calls = []
    monkeypatch.setattr(scratch, "shuffles_released", calls.append)
    assert scratch.materialized(spark.range(9).repartition(3), "t").count() == 9
    assert calls == [spark]
