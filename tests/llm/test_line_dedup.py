import hashlib

import pytest
from pyspark.sql import functions as F

from stocklens.llm import line_dedup as D
from stocklens.sources.scratch import run_path

from .helpers import LOWER, rows_by_id

WHITE = "\t\n\v\f\r "


def key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(rows, least_docs=3, least_chars=20):
    """doc and text -> (lines, dropped, kept); null ids are smaller than all others."""
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(held[key(x)]) < least_docs
                or doc == max(held[key(x)], key=lambda d: (d is not None, d or 0))]
        out.setdefault((doc, text or ""), (len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = [
    (1, "A line that is long enough\nshort\n\na LINE that is long enough  "),
    (2, "x\n\ta line that is long enough\v\nÉté: a line that is long enough"),
    (3, "a line that is long enough\nété: a line that is long enough"),
    (4, "Été: a line that is long enough\nété: a line that is long enough"),
    (5, "Été: a line that is long enough\nété: a line that is long enough\n"),
    (6, None), (7, ""), (8, "\n"), (9, "exactly twenty chars"), (10, "exactly twenty chars"),
    (11, "EXACTLY TWENTY CHARS\nexactly nineteen ch"), (12, "exactly nineteen ch"),
    (13, "exactly nineteen ch"), (None, "a line that is long enough"), (13, "a second row of 13"),
    (9, "exactly twenty chars"),
]


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (3, 2), (6, 3)])
def test_against_brute_force(documents, corpus, batches, fan):
    many = [(100 + i, t) for i, t in corpus.items()] + LINES
    hot = "this very common line is in most of the documents"
    many += [(1000 + i, f"own line {i}\n{hot}\n{'more ' * (i % 7)}") for i in range(60)]
    docs = documents(many, extra=True)
    out = D.drop_repeated_lines(docs, batches=batches, fan=fan)
    assert set(docs.columns) <= set(out.columns)
    expected = brute(many)
    rows = out.select("doc_id", "n_lines", "n_dropped", "text").collect()
    found = sorted(((r.doc_id or -1, r.n_lines, r.n_dropped, r.text) for r in rows))
    assert found == sorted(
        (doc or -1, *expected[doc, text or ""]) for doc, text in many)


def test_runs_are_merged_by_level(spark):
    runs = D.LineRuns(spark, run_path(spark, "runs"), fan=2)
    for i in range(5):
        batch = spark.range(i, i + 3).select(
            F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"),
            F.lit(1).cast("long").alias("n_docs"))
        new = {r.h1 for r in runs.new_keys(batch).collect()}
        assert new == ({0, 1, 2} if i == 0 else {i + 2})
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.h1: r.n_docs for r in runs.counts().collect()} == {
        0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 2, 6: 1}
    files = runs.runs()[0]
    assert files.select("h1").collect() == sorted(files.select("h1").collect())


def test_empty_table(documents):
    assert D.drop_repeated_lines(documents([])).count() == 0


def test_digest(documents):
    out = D.drop_repeated_lines(documents({1: "a\nb"})).select(
        "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    assert rows_by_id(out, "d") == {1: hashlib.sha256(b"a\nb").hexdigest()}


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_frequent_lines_either_way(documents, monkeypatch, hot):
    """Looked up or joined, the same lines go; with columns of the names used inside."""
    monkeypatch.setattr(D, "HOT", hot)
    line = "this very common line is in most of the documents"
    rows = [(i, f"own line {i % 40} of the many\n{line}" if i % 3 else f"{line}\n" * 3) for i in range(200)]
    docs = documents(rows, extra=True)
    for name in ("_id", "_KEY", "_places", "holder", "hot", "n_docs", "h1"):
        docs = docs.withColumn(name, F.lit("own"))
    out = D.drop_repeated_lines(docs)
    assert [c for c in docs.columns if c != "n_lines"] == [c for c in out.columns if c in docs.columns and c != "n_lines"]
    expected = brute(rows)
    for r in out.collect():
        assert (r.n_lines, r.n_dropped, r.text) == expected[r.doc_id, dict(rows)[r.doc_id]]
        assert r._id == r._KEY == r.holder == "own"
