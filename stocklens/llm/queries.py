"""The registered queries of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm import decontamination, divergence, fingerprints, line_dedup, mixing, ngram_join, oracle, periodic_runs, quality, secret_scan, substring_dedup, token_counts, token_files, toxicity
from stocklens.llm.labelled import held_out
from stocklens.sources.scratch import SETTING, run_path

END_ID = 2


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; on a cluster each node has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes of an Arrow batch: a Python worker holds a few arrays of that size, whatever texts it gets.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def shared(spark: SparkSession) -> None:
    """Bound Arrow batches, and name a folder for intermediate files where a local session has none.

    A smaller bound that the session sets already stays.
    """
    if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    unset = spark.conf.get(SETTING, None) is None and context.getCheckpointDir() is None
    if unset and context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stocklens-"))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_mixing(spark: SparkSession, directory: str) -> DataFrame:
    shared(spark)
    mixed = mixing.mixture(table(spark, directory, "documents"))
    # To the digits that do not depend on the order of adding; the draw goes by the chance itself.
    return mixed.withColumns({c: F.round(c, 6) for c in ("factor", "probability")})


def op2_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    items = F.array_join("item_ids", ",")
    return found.select(
        "doc_id", "n_words", decontamination.hit_words().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op3_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    shared(spark)
    documents = table(spark, directory, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(documents).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op4_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    shared(spark)
    found = secret_scan.scan_secrets(table(spark, directory, "documents"))
    base = secret_scan.span_list(secret_scan.KINDS[:3])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS[:3]],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_list(secret_scan.KINDS).alias("spans"),
    )


def op5_quality(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    test = held_out(5, 0)
    forest = quality.train(documents, table(spark, directory, "labels"), ~test)
    scored = quality.score(documents.select("doc_id", "text"), forest)
    return scored.select(
        "doc_id", test.alias("held_out"), "score",
        (F.col("score") >= quality.LIMIT).cast("int").alias("predicted"),
    )


def op6_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, directory, "documents"))


def op7_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    shared(spark)
    documents = table(spark, directory, "documents")
    test = held_out(4, 2)
    model = toxicity.train(documents, table(spark, directory, "labels"), ~test)
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", test.alias("held_out"), "score",
        (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"),
    )


def op8_token_files(spark: SparkSession, directory: str) -> DataFrame:
    shared(spark)
    path = run_path(spark, "tokens")
    documents = table(spark, directory, "documents")
    token_files.write_tokens(documents, path, tokenizer_file("byte_bpe_50k.json"), END_ID)
    return token_files.checksums(token_files.read_tokens(spark, path))


def op9_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    shared(spark)
    found = ngram_join.ngram_components(table(spark, directory, "documents"), k=4, percent=85)
    return found.drop("text_key")


def op10_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    shared(spark)
    return substring_dedup.remove_repeats(
        table(spark, directory, "documents"), value=lambda kept: F.sha2(kept.cast("binary"), 256),
    ).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, directory, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    text = periodic_runs.with_periodic_tails(F.col("text"), F.col("doc_id"))
    found = periodic_runs.periodic_runs(documents.select("doc_id", text.alias("text")))
    longest = found.withColumn("_most", periodic_runs.longest())
    length, period = F.col("_most.length"), -F.col("_most.faster")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_most.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_source_divergence(spark: SparkSession, directory: str) -> DataFrame:
    shared(spark)
    return divergence.audit(table(spark, directory, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_ngram_join": op9_ngram_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE: dict[str, str] = oracle.ORACLE
